"""Gap filling on the long panel and its scoring.

The panel is first densified (every series x every calendar quarter).  The
calendar is generated per series with ``sequence`` from two scalar bounds,
so no cross join is planned; a left join then brings the known values.

Row-wise fills of the reference (along the quarter columns of one series)
become frames of one per-series window: one exchange on the series key,
one sort, bounded partitions (one row per quarter).  The cubic fill needs
a least-squares fit per series and runs as ``applyInPandas`` over that
same partitioning, one series per group.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qpanel import schema as S
from qpanel.functions.dates import quarter_index, quarter_label
from qpanel.plans.ordered import cut_lineage, ecdf_distances, ecdf_distances_by


def calendar_bounds(panel: DataFrame, ds: str = S.DS):
    """(first, last) quarter end of the panel: one scalar aggregate."""
    row = panel.agg(F.min(ds), F.max(ds)).first()
    return row[0], row[1]


def densify(panel: DataFrame, keys=(S.UID,), start=None, end=None,
            ds: str = S.DS, value: str = S.Y) -> DataFrame:
    """All series x all quarters in [start, end]; gaps become NULL rows.

    ``keys`` are the columns identifying a series (all are carried).  One
    aggregate per series gathers its known (quarter -> value) pairs (at
    most one per calendar quarter, so bounded) and a generator emits the
    full calendar: one shuffle, no join, no cross join.

    The calendar comes from the data; a stated ``start`` or ``end`` may widen
    it, but one that would leave known cells out raises ``ValueError``.
    """
    keys = list(keys)
    s0, e0 = calendar_bounds(panel, ds)
    if s0 is not None and (start is not None and str(start) > str(s0) or end is not None and str(end) < str(e0)):
        raise ValueError(f"known cells from {s0} to {e0} lie outside {start} to {end}")
    start, end = start or s0, end or e0
    if start is None:
        raise ValueError("an empty panel has no calendar: state start and end")
    start_c = F.to_date(F.lit(str(start)))
    n = (int(str(end)[:4]) * 4 + (int(str(end)[5:7]) - 1) // 3) - \
        (int(str(start)[:4]) * 4 + (int(str(start)[5:7]) - 1) // 3) + 1
    q0 = quarter_index(start_c)
    per = (panel.groupBy(*keys)
           .agg(F.map_from_entries(F.collect_list(F.struct(
               (quarter_index(ds) - q0).cast("int"), F.col(value)))).alias("_known")))
    cal = per.select(*keys, F.posexplode(F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda i: F.struct(F.last_day(F.add_months(start_c, i * 3)).alias(ds),
                           F.col("_known")[i].alias(value)))).alias("_i", "_c"))
    return cal.select(*keys, F.col(f"_c.{ds}").alias(ds), F.col(f"_c.{value}").alias(value))


def _w(key=S.UID, ds=S.DS):
    return Window.partitionBy(key).orderBy(ds)


def impute_zeros(df: DataFrame, value: str = S.Y) -> DataFrame:
    """I1."""
    return df.withColumn(value, F.coalesce(F.col(value), F.lit(0.0)))


def impute_ffill(df: DataFrame, value: str = S.Y, key: str = S.UID,
                 ds: str = S.DS) -> DataFrame:
    """Forward fill, then back fill the leading gap."""
    w = _w(key, ds)
    prev = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    nxt = F.first(value, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return df.withColumn(value, F.coalesce(prev, nxt))


def impute_linear(df: DataFrame, value: str = S.Y, key: str = S.UID,
                  ds: str = S.DS) -> DataFrame:
    """Straight line between the nearest known quarters on each side
    (by quarter position); the ends take the nearest known value."""
    w = _w(key, ds)
    qi = quarter_index(ds)
    known_q = F.when(F.col(value).isNotNull(), qi)
    back = w.rowsBetween(Window.unboundedPreceding, 0)
    fwd = w.rowsBetween(0, Window.unboundedFollowing)
    v0 = F.last(value, ignorenulls=True).over(back)
    q0 = F.last(known_q, ignorenulls=True).over(back)
    v1 = F.first(value, ignorenulls=True).over(fwd)
    q1 = F.first(known_q, ignorenulls=True).over(fwd)
    df = df.select("*", v0.alias("_v0"), q0.alias("_q0"), v1.alias("_v1"), q1.alias("_q1"))
    line = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * (qi - F.col("_q0")) / (F.col("_q1") - F.col("_q0"))
    filled = (F.when(F.col(value).isNotNull(), F.col(value))
              .when(F.col("_q0").isNotNull() & F.col("_q1").isNotNull(), line)
              .otherwise(F.coalesce("_v0", "_v1")))
    return df.withColumn(value, filled).drop("_v0", "_q0", "_v1", "_q1")


def impute_poly(df: DataFrame, order: int = 3, value: str = S.Y, key: str = S.UID,
                ds: str = S.DS) -> DataFrame:
    """I4: per-series least-squares polynomial through the known quarters
    (>= order+1 known), else linear; a series with no value becomes 0.

    The fit is written in the polynomials that are orthogonal on the known
    quarters, p_0 = 1 and p_{k+1} = (u - a_k) p_k - b_k p_{k-1}, where u is the
    centred and scaled place of the quarter in its series; then each coefficient
    is one quotient of sums, and nothing has to be inverted.  All sums are window
    aggregates over the same partitioning: one shuffle, no Python.
    """
    own = Window.partitionBy(key)
    y, known = F.col("_y"), F.col("_y").isNotNull()
    line = impute_linear(df.withColumn("_line", F.when(~F.isnan(F.col(value).cast("double")), F.col(value))), "_line", key, ds)
    rows = line.withColumns({"_y": F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double")),
                             "_x": F.row_number().over(own.orderBy(ds)).cast("double")})

    def total(c: Column) -> Column:
        return F.sum(F.when(known, c)).over(own)

    rows = rows.withColumns({"_n": F.count(y).over(own), "_mean": F.avg(F.when(known, F.col("_x"))).over(own),
                             "_width": F.greatest(F.stddev_pop(F.when(known, F.col("_x"))).over(own), F.lit(1.0)), "_p0": F.lit(1.0)})
    rows = rows.withColumn("_u", (F.col("_x") - F.col("_mean")) / F.col("_width"))
    u, fit = F.col("_u"), None
    for k in range(order + 1):
        if k:
            step = (u - F.col(f"_a{k - 1}")) * F.col(f"_p{k - 1}")
            rows = rows.withColumn(f"_p{k}", step if k == 1 else step - F.try_divide(f"_q{k - 1}", f"_q{k - 2}") * F.col(f"_p{k - 2}"))
        p = F.col(f"_p{k}")
        rows = rows.withColumns({f"_q{k}": total(p * p), f"_t{k}": total(y * p), f"_m{k}": total(u * p * p)})
        rows = rows.withColumn(f"_a{k}", F.try_divide(f"_m{k}", f"_q{k}"))
        term = F.try_divide(f"_t{k}", f"_q{k}") * p
        fit = term if fit is None else fit + term
    filled = (F.when(known, y).when(F.col("_n") == 0, 0.0).when(F.col("_n") >= order + 1, fit).otherwise(F.col("_line")))
    return rows.withColumn(value, filled).select(*df.columns)


def _knn(k):
    def run(df, value=S.Y):
        from qpanel.operators.knn import impute_knn
        cols = [c for c in df.columns if c not in (S.UID, S.DS, value)]
        filled = impute_knn(df.select(S.UID, S.DS, value), k=k, value=value)
        return df.drop(value).join(filled, [S.UID, S.DS]).select(*df.columns) if cols else filled
    return run


METHODS = {
    "zeros": impute_zeros,
    "ffill": impute_ffill,
    "linear": impute_linear,
    "poly": impute_poly,
    **{f"knn_{k}": _knn(k) for k in (1, 3, 5, 7, 9)},
}


def mask_rule(key: str = S.UID, ds: str = S.DS, threshold: str = "1a") -> Column:
    """Deterministic ~10 % cell sample: first two hex digits of
    md5(unique_id || '|' || 'YYYY-Qn') below ``threshold``."""
    h = F.md5(F.concat_ws("|", F.col(key), quarter_label(ds)))
    return F.substring(h, 1, 2) < F.lit(threshold)


def mask_cells(dense: DataFrame, value: str = S.Y, key: str = S.UID,
               ds: str = S.DS) -> DataFrame:
    """Adds ``hidden`` (known cell chosen by the rule) and ``truth``; the
    hidden cells' values are set to NULL."""
    hid = F.col(value).isNotNull() & mask_rule(key, ds)
    return (dense.withColumn("hidden", hid)
            .withColumn("truth", F.col(value))
            .withColumn(value, F.when(F.col("hidden"), F.lit(None)).otherwise(F.col(value))))


def score_method(filled: DataFrame, method: str, value: str = S.Y) -> DataFrame:
    """I7-I9 for one method: MAE and RMSE on hidden cells, KS and
    Wasserstein distance between the original known values and the
    filled panel's values.

    The filled panel is checkpointed once (it feeds two jobs); error
    statistics and both sample sizes come from one aggregate.
    """
    f = cut_lineage(filled.select("hidden", "truth",
                                  F.when(~F.isnan(value), F.col(value)).alias("v")))
    hid = F.col("hidden") & F.col("v").isNotNull()
    e = F.col("v") - F.col("truth")
    st = f.agg(F.avg(F.when(hid, F.abs(e))).alias("mae"),
               F.sqrt(F.avg(F.when(hid, F.pow(e, 2)))).alias("rmse"),
               F.count_if(hid).alias("n_hidden"),
               F.count("truth").alias("n1"), F.count("v").alias("n2")).first()
    dist = ecdf_distances(f.select(F.col("truth").alias("x")),
                          f.select(F.col("v").alias("x")), "x",
                          float(st["n1"]), float(st["n2"]))
    return dist.select(F.lit(method).alias("method"),
                       F.lit(st["mae"]).cast("double").alias("mae"),
                       F.lit(st["rmse"]).cast("double").alias("rmse"),
                       F.lit(st["n_hidden"]).cast("long").alias("n_hidden"),
                       "ks", "wasserstein")


def compare_imputers(dense_masked: DataFrame, methods=("zeros", "ffill", "linear"),
                     value: str = S.Y, timed: bool = False) -> DataFrame:
    """One score row per method on the same masked panel, which is
    checkpointed once and shared by every method.

    Untimed, all methods are filled, stacked and checkpointed together and
    scored in one pass (one error aggregate, one grouped ECDF).  ``timed``
    scores method by method and adds ``time_sec``: the wall time of
    filling, materialising and scoring that method.
    """
    import time
    base = cut_lineage(dense_masked)
    if timed:
        out = None
        for m in methods:
            t0 = time.perf_counter()
            s = cut_lineage(score_method(METHODS[m](base, value=value), m, value))
            s = s.withColumn("time_sec", F.lit(round(time.perf_counter() - t0, 3)))
            out = s if out is None else out.unionByName(s)
        return out
    stacked = None
    for m in methods:
        f = METHODS[m](base, value=value).select(
            F.lit(m).alias("method"), "hidden", "truth",
            F.when(~F.isnan(value), F.col(value)).alias("v"))
        stacked = f if stacked is None else stacked.unionByName(f)
    stacked = cut_lineage(stacked)
    hid = F.col("hidden") & F.col("v").isNotNull()
    e = F.col("v") - F.col("truth")
    st = {r["method"]: r for r in stacked.groupBy("method").agg(
        F.avg(F.when(hid, F.abs(e))).alias("mae"),
        F.sqrt(F.avg(F.when(hid, F.pow(e, 2)))).alias("rmse"),
        F.count_if(hid).alias("n_hidden"),
        F.count("truth").alias("n1"), F.count("v").alias("n2")).collect()}  # one row per method
    dist = ecdf_distances_by(stacked, "method", "truth", "v",
                             {m: (r["n1"], r["n2"]) for m, r in st.items()})
    errs = stacked.sparkSession.createDataFrame(
        [(m, r["mae"], r["rmse"], int(r["n_hidden"])) for m, r in st.items()],
        "method string, mae double, rmse double, n_hidden long")
    return errs.join(dist, "method").select("method", "mae", "rmse", "n_hidden", "ks", "wasserstein")
