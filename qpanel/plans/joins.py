"""Join helpers that keep broadcasts behind an explicit size check."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def estimated_bytes(df: DataFrame) -> int:
    """Optimizer's size estimate of ``df`` (no job is run).

    For a file scan this is the compressed on-disk size scaled to the
    selected columns: an estimate, not a bound, so callers compare it with
    the session's broadcast threshold, which leaves room for unpacking.
    """
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_limit(df: DataFrame) -> int:
    """The session's broadcast threshold in bytes (-1 disables)."""
    v = df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760")
    v = v.strip().lower()
    mult = {"b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    if v and v[-1] == "b" and v[-2:-1] in mult and v[-2:-1] != "b":
        v = v[:-1]
    if v and v[-1] in mult:
        return int(float(v[:-1]) * mult[v[-1]])
    return int(v)


def fixed_small(df: DataFrame) -> DataFrame:
    """Broadcast a side whose size is fixed by construction (region,
    nation, a calendar of quarters, a horizon or fold table)."""
    return F.broadcast(df)


def broadcast_bounded(df: DataFrame, max_rows: int = 1_000_000) -> DataFrame:
    """For small derived tables (group means, per-period statistics):
    materialise once into the checkpoint folder, count, and broadcast only
    when the count proves it small; above the bound the plain (already
    computed) table is returned and the join shuffles as usual."""
    from qpanel.plans.ordered import cut_lineage
    m = cut_lineage(df)
    return F.broadcast(m) if m.count() <= max_rows else m


def lookup_join(big: DataFrame, small: DataFrame, big_key: str, small_key: str,
                probe: DataFrame | None = None) -> DataFrame:
    """Join a large table to a key -> attributes table (unique on its key).

    Broadcast when the optimizer's estimate of ``probe`` (the small side's
    base scan) is under the session threshold; otherwise a sort-merge join
    with nothing between it and its two shuffles, so that adaptive execution
    can split a hot key's partition by the sizes it has measured (no sample
    of the input is taken, and no row is read twice)."""
    limit = broadcast_limit(small)
    side = F.broadcast(small) if 0 <= limit and estimated_bytes(probe if probe is not None else small) <= limit else small
    return big.join(side, F.col(big_key) == F.col(small_key))
