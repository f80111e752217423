"""Statistics that need one global order: exact quantiles and ECDFs.

A window ``OVER (ORDER BY x)`` without a partition runs in one task, so it
is never used on data that grows.  Instead (H2):

1. pre-aggregate to distinct values with counts (partial aggregation, so
   repeated values and hot keys collapse before any shuffle);
2. range-partition the distinct values and sort within partitions;
3. checkpoint, so partition ids are fixed for both passes;
4. per-partition totals (one row per partition, bounded by the partition
   count, not the data) give each partition its offset;
5. a window partitioned by the partition id adds local running sums.

Each task holds one range partition, about n_distinct / partitions rows.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from qpanel.session import ensure_checkpoint_dir


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared ``spark.checkpoint.dir``."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def global_cumulative(df: DataFrame, order_col: str, weights: list[str],
                      partitions: int | None = None, group: str | None = None) -> DataFrame:
    """Adds ``cum_<w>`` (inclusive running sum of each weight in ascending
    ``order_col`` order) and ``next_value`` (the following value, NULL for
    the last).  With ``group`` the sums restart per group (the group must
    be small in number, e.g. a method name); (group, order_col) must be
    distinct."""
    spark: SparkSession = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = ([group] if group else []) + [order_col]
    srt = (df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
           .withColumn("_pid", F.spark_partition_id()))
    srt = cut_lineage(srt)
    gcols = [group] if group else []
    tot = srt.groupBy("_pid", *gcols).agg(*[F.sum(w).alias(f"_t_{w}") for w in weights],
                                          F.min(order_col).alias("_first"))
    # one row per (partition, group): windows here are bounded by that count
    wp = Window.partitionBy(*gcols).orderBy("_pid")
    before = wp.rowsBetween(Window.unboundedPreceding, -1)
    after = wp.rowsBetween(1, Window.unboundedFollowing)
    off = tot.select("_pid", *gcols,
                     *[F.coalesce(F.sum(f"_t_{w}").over(before), F.lit(0)).alias(f"_o_{w}")
                       for w in weights],
                     F.first("_first", ignorenulls=True).over(after).alias("_next_first"))
    wl = Window.partitionBy("_pid", *gcols).orderBy(order_col)
    local = srt.select("*", *[F.sum(w).over(wl.rowsBetween(Window.unboundedPreceding, 0))
                              .alias(f"_l_{w}") for w in weights],
                       F.lead(order_col).over(wl).alias("_lead"))
    out = local.join(F.broadcast(off), ["_pid", *gcols])
    return out.select(*df.columns,
                      *[(F.col(f"_o_{w}") + F.col(f"_l_{w}")).alias(f"cum_{w}") for w in weights],
                      F.coalesce("_lead", "_next_first").alias("next_value"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Distinct non-null values with their counts (``_n``)."""
    return df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_n"))


def exact_quantile(df: DataFrame, col: str, q: float) -> float | None:
    """Exact quantile with linear interpolation between closest ranks (the
    rule of pandas ``quantile`` and DuckDB ``quantile_cont``)."""
    vc = value_counts(df, col)
    cum = global_cumulative(vc, col, ["_n"])
    total = cum.agg(F.sum("_n")).first()[0]
    if not total:
        return None
    pos = (total - 1) * q
    lo, hi = int(pos // 1), int(-(-pos // 1))
    start = F.col("cum__n") - F.col("_n")
    pick = cum.filter(((start <= lo) & (F.col("cum__n") > lo)) |
                      ((start <= hi) & (F.col("cum__n") > hi)))
    rows = pick.select(col, "cum__n", "_n").collect()  # at most 2 rows
    def at(k):
        for r in rows:
            if r["cum__n"] - r["_n"] <= k < r["cum__n"]:
                return float(r[col])
        raise RuntimeError("rank not found")
    v_lo, v_hi = at(lo), at(hi)
    return v_lo + (v_hi - v_lo) * (pos - lo)


def ecdf_distances(a: DataFrame, b: DataFrame, col: str,
                   n1: float | None = None, n2: float | None = None) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic and 1-Wasserstein distance
    between the values of ``col`` in ``a`` and ``b`` (I8, I9).

    One row: (ks, wasserstein).  Both come from the merged ECDF table:
    KS = max |F1 - F2|, W1 = sum |F1 - F2| * (next value - value).
    """
    both = (a.select(F.col(col).alias("v"), F.lit(1).alias("_a"), F.lit(0).alias("_b"))
            .unionByName(b.select(F.col(col).alias("v"), F.lit(0).alias("_a"), F.lit(1).alias("_b")))
            .filter(F.col("v").isNotNull() & ~F.isnan("v"))
            .groupBy("v").agg(F.sum("_a").alias("n1"), F.sum("_b").alias("n2")))
    if n1 is None or n2 is None:
        tot = both.agg(F.sum("n1"), F.sum("n2")).first()
        n1, n2 = float(tot[0] or 0), float(tot[1] or 0)
    cum = global_cumulative(both, "v", ["n1", "n2"])
    d = F.abs(F.col("cum_n1") / F.lit(n1) - F.col("cum_n2") / F.lit(n2))
    return cum.agg(F.max(d).alias("ks"),
                   F.coalesce(F.sum(d * (F.col("next_value") - F.col("v"))), F.lit(0.0))
                   .alias("wasserstein"))


def global_rank(df: DataFrame, col: str) -> DataFrame:
    """Dense rank (1-based) of each distinct ``col`` value, distributed."""
    vals = df.select(col).distinct().withColumn("_one", F.lit(1))
    cum = global_cumulative(vals, col, ["_one"])
    return cum.select(col, F.col("cum__one").alias("rank"))


def ecdf_distances_by(df: DataFrame, group: str, a: str, b: str, totals: dict) -> DataFrame:
    """KS and W1 between columns ``a`` and ``b`` of ``df`` for every value of
    ``group`` in one pass; ``totals`` maps group -> (n_a, n_b).  One row per
    group: (group, ks, wasserstein)."""
    both = (df.select(group, F.col(a).alias("v"), F.lit(1).alias("_a"), F.lit(0).alias("_b"))
            .unionByName(df.select(group, F.col(b).alias("v"), F.lit(0).alias("_a"), F.lit(1).alias("_b")))
            .filter(F.col("v").isNotNull() & ~F.isnan("v"))
            .groupBy(group, "v").agg(F.sum("_a").alias("n1"), F.sum("_b").alias("n2")))
    cum = global_cumulative(both, "v", ["n1", "n2"], group=group)
    tot = df.sparkSession.createDataFrame(
        [(g, float(x), float(y)) for g, (x, y) in totals.items()], f"{group} string, _N1 double, _N2 double")
    d = F.abs(F.col("cum_n1") / F.col("_N1") - F.col("cum_n2") / F.col("_N2"))
    return (cum.join(F.broadcast(tot), group)
            .groupBy(group).agg(F.max(d).alias("ks"),
                                F.coalesce(F.sum(d * (F.col("next_value") - F.col("v"))), F.lit(0.0))
                                .alias("wasserstein")))


def approx_quantile(df: DataFrame, col: str, q: float, accuracy: int = 100_000) -> float | None:
    """A16 at scale: ``percentile_approx`` (a mergeable sketch per task, one
    small merge), rank error about 1/accuracy of the row count."""
    return df.agg(F.percentile_approx(col, q, accuracy)).first()[0]
