"""Exact k-nearest-neighbour gap filling (I5) without a quadratic group.

Semantics (the reference's imputer with inverse-distance weights):
* each series is z-scored on its known quarters (population std, 0 -> 1);
* distance between two series = sqrt(T / c * sum of squared differences
  over the c quarters both know), T = calendar length (NaN-Euclidean);
* a missing cell (series i, quarter q) takes the k nearest series that
  know q; weights 1/d, and donors at distance 0 take all the weight;
* no donor -> the mean of the known z values of that quarter;
* the result is scaled back with the series' own mean and std.

Plan: series become one row each (their z vector, bounded by T).  Series
are cut into rank-based blocks of at most ``block`` series.  For every
pair of blocks (tb <= db; distances are symmetric) a grouped map computes
the tile's distances once in NumPy and emits only each cell's k best
donors from the other block, in both directions; a final top-k per cell
merges tiles.  So a task holds at most
block x block pairs and the emitted rows are bounded by cells x k x
tiles, however the data is skewed: nothing is grouped by a data key.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qpanel import schema as S
from qpanel.functions.dates import quarter_index
from qpanel.plans.ordered import cut_lineage, global_rank

CAND_SCHEMA = T.StructType([
    T.StructField("target", T.StringType()), T.StructField("qpos", T.IntegerType()),
    T.StructField("donor", T.StringType()), T.StructField("dist", T.DoubleType()),
    T.StructField("dz", T.DoubleType())])


def _no_candidates() -> pd.DataFrame:
    """A tile without gaps.  The columns keep their types: of an untyped empty
    frame Arrow cannot build the string columns."""
    return pd.DataFrame({"target": np.empty(0, object), "qpos": np.empty(0, np.int32),
                         "donor": np.empty(0, object), "dist": np.empty(0), "dz": np.empty(0)})


def _nan_distances(za: np.ndarray, zb: np.ndarray, n_quarters: int) -> np.ndarray:
    """NaN-Euclidean distances between the rows of two z matrices
    (NaN where two series share no known quarter)."""
    pa, pb = ~np.isnan(za), ~np.isnan(zb)
    both = pa[:, None, :] & pb[None, :, :]
    diff = np.where(both, za[:, None, :] - zb[None, :, :], 0.0)
    ss = np.sum(diff * diff, axis=2)
    cnt = both.sum(axis=2)
    with np.errstate(divide="ignore", invalid="ignore"):
        dist = np.sqrt(n_quarters / cnt * ss)
    dist[cnt == 0] = np.nan
    return dist


def _select(tid, zt, did, zd, dist, k: int) -> pd.DataFrame:
    """Each missing cell of the targets (rows of ``zt``): its k nearest
    donors among ``zd`` that know the quarter; ties go to the smaller id."""
    pt, pdn = ~np.isnan(zt), ~np.isnan(zd)
    order = np.argsort(did, kind="stable")
    did, zd, pdn, dist = did[order], zd[order], pdn[order], dist[:, order]
    dist = np.where(np.isnan(dist), np.inf, dist)
    ii, qq = np.nonzero(~pt)
    if ii.size == 0 or len(did) == 0:
        return _no_candidates()
    sub = np.where(pdn.T[qq, :], dist[ii, :], np.inf)      # cells x donors
    kk = min(k, sub.shape[1])
    idx = np.argsort(sub, axis=1, kind="stable")[:, :kk]
    dsel = np.take_along_axis(sub, idx, axis=1)
    ok = np.isfinite(dsel)
    rows = np.repeat(np.arange(ii.size), kk).reshape(ii.size, kk)
    return pd.DataFrame({"target": tid[ii][rows][ok], "qpos": qq[rows][ok].astype(np.int32),
                         "donor": did[idx][ok], "dist": dsel[ok], "dz": zd[idx, qq[:, None]][ok]})


def _tile_candidates(k: int, n_quarters: int):
    """Tile (tb, db) with tb <= db: one distance matrix, candidates in both
    directions (targets of tb from donors of db and, off the diagonal,
    targets of db from donors of tb)."""
    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return _no_candidates()
        tb, db = key
        zl = np.array([np.asarray(v, dtype=float) for v in left["z"]])
        zr = np.array([np.asarray(v, dtype=float) for v in right["z"]])
        lid, rid = left["uid"].to_numpy(), right["uid"].to_numpy()
        dist = _nan_distances(zl, zr, n_quarters)
        out = [_select(lid, zl, rid, zr, dist, k)]
        if tb != db:
            out.append(_select(rid, zr, lid, zl, dist.T, k))
        return pd.concat(out, ignore_index=True)
    return run


def impute_knn(dense: DataFrame, k: int = 5, block: int = 256, key: str = S.UID,
               ds: str = S.DS, value: str = S.Y, weights: str = "distance",
               scale: bool = True) -> DataFrame:
    """I5 on a panel (key, ds, value); returns every series on the full
    calendar with its gaps filled.  ``weights``: donors count by inverse
    distance or alike (``uniform``); ``scale``: distances and fills on
    per-series z-scores or on the values as they are.

    Deterministic whatever the partitioning: each series' statistics are
    computed from its date-ordered value array, and each cell's donors are
    combined in (distance, donor id) order.
    """
    if weights not in ("distance", "uniform"):
        raise ValueError(f"unknown weights {weights!r}")
    dense = cut_lineage(dense.select(key, ds, value))  # read four times below
    d0, q0, q1, n_series = dense.agg(F.min(ds), F.min(quarter_index(ds)), F.max(quarter_index(ds)),
                                     F.countDistinct(key)).first()
    nq = q1 - q0 + 1
    start = F.to_date(F.lit(str(d0)))
    known = dense.filter(F.col(value).isNotNull()).select(
        key, (quarter_index(ds) - q0).cast("int").alias("qpos"), F.col(value).cast("double").alias("_y"))
    # one row per series: values on the calendar, mean and population std
    per = (dense.select(key).distinct()
           .join(known.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("qpos", "_y")))
                                        .alias("_m")), key, "left"))
    yv = F.transform(F.sequence(F.lit(0), F.lit(nq - 1)), lambda i: F.col("_m")[i])
    per = per.withColumn("yv", yv).withColumn("_k", F.filter("yv", lambda v: v.isNotNull()))
    n = F.size("_k").cast("double")
    mu = F.try_divide(F.aggregate("_k", F.lit(0.0), lambda a, v: a + v), n)
    per = per.withColumn("mu", mu)
    var = F.try_divide(F.aggregate("_k", F.lit(0.0),
                                   lambda a, v: a + (v - F.col("mu")) * (v - F.col("mu"))), n)
    if not scale:
        per = per.withColumn("mu", F.lit(0.0))
        var = F.lit(1.0)
    per = (per.withColumn("sd", F.when(var.isNull() | (var == 0), F.lit(1.0)).otherwise(F.sqrt(var)))
           .withColumn("z", F.transform("yv", lambda v: (v - F.col("mu")) / F.col("sd")))
           .select(F.col(key).alias("uid"), "yv", "mu", "sd", "z"))
    rk = global_rank(dense.select(F.col(key).alias("uid")), "uid")
    nb = max(1, int(-(-n_series // block)))
    vec = cut_lineage(per.join(rk, "uid").withColumn(
        "blk", F.floor((F.col("rank") - 1) / block).cast("int")).drop("rank"))
    # tiles (tb <= db): distances are symmetric, so each pair of blocks is
    # computed once and serves both directions
    left = vec.select("uid", "z", F.col("blk").alias("tb"),
                      F.explode(F.sequence(F.col("blk"), F.lit(nb - 1))).alias("db"))
    right = vec.select("uid", "z", F.col("blk").alias("db"),
                       F.explode(F.sequence(F.lit(0), F.col("blk"))).alias("tb"))
    cand = (left.groupBy("tb", "db").cogroup(right.groupBy("tb", "db"))
            .applyInPandas(_tile_candidates(k, nq), CAND_SCHEMA))
    w = Window.partitionBy("target", "qpos").orderBy("dist", "donor")
    top = cand.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k)
    # each cell's <= k donors, combined in (distance, id) order
    cells = (top.groupBy("target", "qpos")
             .agg(F.sort_array(F.collect_list(F.struct("dist", "donor", "dz"))).alias("c")))
    zero = F.filter("c", lambda x: x["dist"] == 0)
    inv = F.aggregate("c", F.struct(F.lit(0.0).alias("num"), F.lit(0.0).alias("den")),
                      lambda acc, x: F.struct((acc["num"] + F.try_divide(x["dz"], x["dist"])).alias("num"),
                                              (acc["den"] + F.try_divide(F.lit(1.0), x["dist"])).alias("den")),
                      lambda acc: F.try_divide(acc["num"], acc["den"]))
    exact = F.try_divide(F.aggregate(zero, F.lit(0.0), lambda a, x: a + x["dz"]), F.size(zero))
    mean = F.try_divide(F.aggregate("c", F.lit(0.0), lambda a, x: a + x["dz"]), F.size("c"))
    fill = mean if weights == "uniform" else F.when(F.size(zero) > 0, exact).otherwise(inv)
    cells = cells.select("target", "qpos", fill.alias("zf"))
    fills = cells.groupBy(F.col("target").alias("uid")).agg(
        F.map_from_entries(F.collect_list(F.struct("qpos", "zf"))).alias("_f"))
    # per-quarter mean of the known z values (cells without any donor): one
    # row per calendar quarter, so the broadcast is bounded by the calendar
    colmean = (vec.select(F.posexplode("z").alias("qpos", "zz")).filter(F.col("zz").isNotNull())
               .groupBy("qpos").agg(F.avg("zz").alias("zmean")))
    out = (vec.join(fills, "uid", "left")
           .select("uid", "mu", "sd", "_f", F.posexplode("yv").alias("qpos", "_yv"))
           .join(F.broadcast(colmean), "qpos", "left"))
    filled = F.coalesce(F.col("_yv"),
                        F.coalesce(F.col("_f")[F.col("qpos")], F.col("zmean")) * F.col("sd")
                        + F.col("mu"))
    return out.select(F.col("uid").alias(key),
                      F.last_day(F.add_months(start, F.col("qpos") * 3)).alias(ds),
                      filled.alias(value))
