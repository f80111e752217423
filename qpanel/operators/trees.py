"""Global boosted-tree forecaster on ``pyspark.ml``.

* features are lagged only (Q10: nothing from the quarter being
  predicted), forward-filled per series then 0 (P19 / Q22);
* ``GBTRegressor`` with ``validationIndicatorCol`` gives early stopping
  on the validation quarters (P13);
* the recursive forecast keeps a bounded state per series (its last
  ``STATE`` values as an array), so every step is a narrow map plus a
  model transform: no window over a growing history and no shuffle.  The
  state is checkpointed to the shared checkpoint folder every four steps.
* tuning loops on the driver over distributed fits; folds are by time,
  training strictly before the validation year (Q9).
"""
from __future__ import annotations

import itertools
import random

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qpanel import schema as S
from qpanel.functions.dates import quarter_index
from qpanel.functions.numeric import safe_div
from qpanel.plans.ordered import cut_lineage

LAGS = 4
STATE = 8
FEATURES = ["lag_1", "lag_2", "lag_3", "lag_4", "roll_mean_4", "roll_std_4",
            "lag_pct_1", "lag_pct_4", "q_sin", "q_cos"]


def _lag_features(lag: callable, qnum: Column) -> dict[str, Column]:
    """Features from a lag accessor ``lag(k)`` (k >= 1) and the quarter."""
    import math
    lags = [lag(k) for k in range(1, LAGS + 1)]
    vals = F.array(*lags)
    present = F.filter(vals, lambda v: v.isNotNull())
    n = F.size(present).cast("double")
    mean = F.aggregate(present, F.lit(0.0), lambda a, v: a + v) / n
    var = F.aggregate(present, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean)) / (n - 1)
    a = 2 * math.pi * (qnum - 1) / 4
    return {
        **{f"lag_{k}": lags[k - 1] for k in range(1, LAGS + 1)},
        "roll_mean_4": F.when(n >= 1, mean),
        "roll_std_4": F.when(n >= 2, F.sqrt(var)),
        "lag_pct_1": safe_div(lag(1) - lag(2), lag(2)),
        "lag_pct_4": safe_div(lag(1) - lag(5), lag(5)),
        "q_sin": F.sin(a), "q_cos": F.cos(a),
    }


def model_frame(prepared: DataFrame, target: str = "y_log", key: str = S.UID,
                ds: str = S.DS) -> DataFrame:
    """Per (series, quarter): the label and lagged features, NULLs filled
    by forward fill per series then 0 (one window spec)."""
    w = Window.partitionBy(key).orderBy(ds)
    feats = _lag_features(lambda k: F.lag(target, k).over(w), F.quarter(ds))
    df = prepared.select(key, ds, target, *[c.alias(n) for n, c in feats.items()])
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    return df.select(key, ds, target, *[
        F.coalesce(F.last(c, ignorenulls=True).over(upto), F.lit(0.0)).alias(c) for c in FEATURES])


def feature_columns(df: DataFrame, prefixes=("lag_", "roll_", "pct_", "stat_", "q_")) -> list[str]:
    """Feature columns chosen by name prefix (driver-side, on names)."""
    return [c for c in df.columns if c.startswith(tuple(prefixes))]


def assembler() -> VectorAssembler:
    return VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep")


def fit_gbt(frame: DataFrame, params: dict | None = None, label: str = "y_log",
            valid_flag: str | None = None, seed: int = 42):
    """GBT on the log target; early stopping when ``valid_flag``
    (a boolean column) marks validation rows."""
    p = {"maxIter": 40, "maxDepth": 4, "stepSize": 0.1, "subsamplingRate": 1.0,
         "featureSubsetStrategy": "all", **(params or {})}
    gbt = GBTRegressor(featuresCol="features", labelCol=label, seed=seed, **p)
    if valid_flag:
        gbt = gbt.setValidationIndicatorCol(valid_flag)
    return gbt.fit(assembler().transform(frame))


def predict_levels(model, frame: DataFrame, out: str = "forecast") -> DataFrame:
    """expm1 of the log prediction, one row per series-quarter."""
    return (model.transform(assembler().transform(frame))
            .withColumn(out, F.expm1("prediction")).drop("features", "prediction"))


def recursive_forecast(model, history: DataFrame, h: int, value: str = "y_log",
                       key: str = S.UID, ds: str = S.DS, checkpoint_every: int = 4,
                       cutoff: str | None = None) -> DataFrame:
    """predict a quarter, feed it back, next quarter; h steps from
    ``cutoff`` (default: the last quarter of the whole history).

    State per series: its values as an array (a calendar long at most; the
    last STATE are kept) and the last features, which fill a missing one as
    in training (forward, then 0).  A series that ends before the cutoff has
    its last value repeated up to it (P19) and the ``status``
    filled_to_cutoff, others ok.  History holds only training data and the
    model's own predictions (Q10).
    """
    from qpanel.operators.models import _quarter_end_of_index, cutoff_index
    end = cutoff_index(history, cutoff, ds)
    upto = history.filter(quarter_index(ds) <= F.lit(end))
    st = (upto.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(ds, value))).alias("_s"),
                                F.max(quarter_index(ds)).alias("_last"))
          .withColumn("_gap", F.lit(end) - F.col("_last"))
          .select(key, F.when(F.col("_gap") > 0, "filled_to_cutoff").otherwise("ok").alias("status"),
                  F.concat(F.col("_s")[value], F.array_repeat(F.element_at(F.col("_s")[value], -1), F.col("_gap"))).alias("_hist")))
    # features of the last known quarter, to fill forward from
    now = _lag_features(lambda k: F.try_element_at("_hist", F.lit(-k - 1)), F.quarter(_quarter_end_of_index(F.lit(end))))
    st = st.select(key, "status", F.slice("_hist", F.greatest(F.lit(1), F.size("_hist") - STATE + 1), F.lit(STATE)).alias("_hist"),
                   *[c.alias(f"_old_{n}") for n, c in now.items()])
    outs = None
    for step in range(1, h + 1):
        nxt = _quarter_end_of_index(F.lit(end + step) if end is not None else F.lit(None).cast("int"))
        feats = _lag_features(lambda k: F.try_element_at("_hist", F.lit(-k)), F.quarter(nxt))
        fr = st.select(key, "status", "_hist", nxt.alias(ds),
                       *[F.coalesce(c, F.col(f"_old_{n}"), F.lit(0.0)).alias(n) for n, c in feats.items()])
        pred = model.transform(assembler().transform(fr)).drop("features")
        st = pred.select(key, "status", ds, F.slice(F.concat(F.slice("_hist", F.greatest(F.lit(1), F.size("_hist") - STATE + 2), F.lit(STATE)),
                                                             F.array("prediction")), 1, STATE).alias("_hist"),
                         *[F.col(n).alias(f"_old_{n}") for n in FEATURES], F.lit(step).alias("step"), F.col("prediction"))
        if checkpoint_every and step % checkpoint_every == 0:
            st = cut_lineage(st)
        o = st.select(key, ds, "step", F.expm1("prediction").alias("forecast"), "status")
        outs = o if outs is None else outs.unionByName(o)
        st = st.drop("step", "prediction", ds)
    return outs


# ---------------------------------------------------------------------------
# Model selection.

def expanding_folds(frame: DataFrame, years, ds: str = S.DS):
    """M1 (time-correct, Q9): for each fold year, train on earlier years,
    validate on that year.  Yields (year, train, valid)."""
    for y in years:
        yield y, frame.filter(F.year(ds) < y), frame.filter(F.year(ds) == y)


def time_series_split(frame: DataFrame, n_splits: int = 5, ds: str = S.DS) -> DataFrame:
    """M2: ``ntile(n+1)`` over the distinct periods (a table as small as
    the calendar), joined back; fold k trains on tiles <= k, validates on
    k+1."""
    periods = frame.select(ds).distinct()
    tiles = periods.withColumn("tile", F.ntile(n_splits + 1).over(Window.orderBy(ds)))
    return frame.join(F.broadcast(tiles), ds)


# ---------------------------------------------------------------------------
# The reference's random-search space for its booster.
REFERENCE_SPACE = {
    "learning_rate": [0.01, 0.03, 0.05, 0.1],
    "num_leaves": [31, 63, 127],
    "colsample_bytree": [0.6, 0.8, 1.0],
    "subsample": [0.6, 0.8, 1.0],
    "subsample_freq": [5],
    "reg_alpha": [0, 1],
    "reg_lambda": [0, 1],
}
# ---------------------------------------------------------------------------


def to_gbt_params(c: dict, max_iter: int = 20) -> dict:
    """Map a booster candidate onto ``GBTRegressor`` parameters: learning
    rate -> stepSize, leaves -> depth (a full tree of 2^d leaves), column
    sampling -> featureSubsetStrategy, row sampling -> subsamplingRate.
    The L1/L2 penalties have no GBT counterpart and are dropped."""
    import math
    col = c.get("colsample_bytree", 1.0)
    return {"stepSize": float(c["learning_rate"]),
            "maxDepth": int(math.log2(c["num_leaves"] + 1)),
            "featureSubsetStrategy": "all" if col >= 1.0 else str(col),
            "subsamplingRate": float(c.get("subsample", 1.0)),
            "maxIter": max_iter}


def reference_candidates(n: int, seed: int = 42, max_iter: int = 20) -> list[dict]:
    """M3 on the reference's space: a seeded draw, mapped to GBT parameters,
    duplicates (candidates differing only in dropped keys) removed."""
    out, seen = [], set()
    for c in random_candidates(REFERENCE_SPACE, len(param_grid(REFERENCE_SPACE)), seed):
        g = to_gbt_params(c, max_iter)
        key = tuple(sorted(g.items()))
        if key not in seen:
            seen.add(key)
            out.append(g)
        if len(out) == n:
            break
    return out


def param_grid(space: dict) -> list[dict]:
    """M4: every combination of the search space (ParamGridBuilder-like)."""
    keys = sorted(space)
    return [dict(zip(keys, vals)) for vals in itertools.product(*[space[k] for k in keys])]


def random_candidates(space: dict, n: int, seed: int = 42) -> list[dict]:
    """M3: a seeded draw of ``n`` distinct candidates from the grid."""
    grid = param_grid(space)
    rnd = random.Random(seed)
    return rnd.sample(grid, min(n, len(grid)))


def cv_rmse(frame: DataFrame, candidates: list[dict], years, label: str = "y_log",
            seed: int = 42, parallelism: int = 4) -> DataFrame:
    """M5: per candidate and fold, RMSE on the level scale (expm1), and
    their mean.  Returns (candidate, fold, rmse) plus fold=NULL means.

    Fits are independent distributed jobs; up to ``parallelism`` of them
    are submitted at once from driver threads (like ``CrossValidator``'s
    ``parallelism``), which fills the cluster when one fit cannot.
    """
    from concurrent.futures import ThreadPoolExecutor
    spark = frame.sparkSession
    folds = list(expanding_folds(frame, years))

    def one(task):
        ci, params, y, tr, va = task
        m = fit_gbt(tr, params, label, seed=seed)
        r = predict_levels(m, va).agg(
            F.sqrt(F.avg(F.pow(F.col("forecast") - F.expm1(label), 2)))).first()[0]
        return ci, int(y), float(r) if r is not None else None

    tasks = [(ci, params, y, tr, va) for ci, params in enumerate(candidates) for y, tr, va in folds]
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        rows = list(pool.map(one, tasks))
    res = spark.createDataFrame(rows, "candidate int, fold int, rmse double")
    return res.groupingSets([["candidate", "fold"], ["candidate"]], "candidate", "fold") \
        .agg(F.avg("rmse").alias("rmse"))


def select_best(cv: DataFrame) -> int:
    """Arg-min of the mean CV RMSE (ties: lowest candidate index)."""
    return cv.filter(F.col("fold").isNull()).orderBy("rmse", "candidate").first()["candidate"]
