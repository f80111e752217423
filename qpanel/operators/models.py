"""Model-based forecasters and decomposition.

* decomposition and variability are window/aggregate plans (no Python);
* the per-series seasonal AR maps over hash partitions sorted by series
  (``plans.series_map``), the block VAR over one block of at most
  ``block_size`` series at a time;
* all forecasters count steps from one cutoff quarter, and return every
  series with a status;
* the global recursive linear model is fitted on the supervised windows of
  all series by one pass of covariances and a solve over columns
  (``functions.least_squares``) and forecast with one higher-order
  ``aggregate`` expression per series (no loop of jobs).
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qpanel import schema as S
from qpanel.functions.dates import quarter_index
from qpanel.functions.least_squares import least_squares
from qpanel.plans.ordered import global_rank
from qpanel.plans.series_map import map_series


# ---------------------------------------------------------------------------
# Additive decomposition with a 2x4 centred trend.

def seasonal_decompose(panel: DataFrame, m: int = 4, key: str = S.UID, ds: str = S.DS,
                       value: str = S.Y) -> DataFrame:
    """Adds trend, seasonal, resid.  Trend: centred 2 x m moving average
    (NULL within m/2 of either end); seasonal: mean detrended value of the
    season minus the mean of the m season means; resid: the rest.

    Everything is per series: the ordered window (trend) and the unordered
    one (season means) share the series partitioning, so there is one
    exchange and no join.
    """
    if m % 2:
        raise ValueError("even seasonal period expected")
    w = Window.partitionBy(key).orderBy(ds)
    wp = Window.partitionBy(key)
    x = F.col(value)
    half = m // 2
    terms = ([F.lag(x, half).over(w) / 2] + [F.lag(x, k).over(w) for k in range(half - 1, 0, -1)]
             + [x] + [F.lead(x, k).over(w) for k in range(1, half)] + [F.lead(x, half).over(w) / 2])
    trend = sum(terms[1:], terms[0]) / m
    d = (panel.withColumn("trend", trend)
         .withColumn("_season", F.pmod(quarter_index(ds), F.lit(m)))
         .withColumn("_detr", x - F.col("trend")))
    means = [F.avg(F.when(F.col("_season") == s, F.col("_detr"))).over(wp) for s in range(m)]
    d = d.select("*", *[c.alias(f"_sm{s}") for s, c in enumerate(means)])
    present = [F.col(f"_sm{s}") for s in range(m)]
    n_present = sum((c.isNotNull().cast("int") for c in present[1:]), present[0].isNotNull().cast("int"))
    total = sum((F.coalesce(c, F.lit(0.0)) for c in present[1:]), F.coalesce(present[0], F.lit(0.0)))
    mine = F.col("_sm0")
    for s in range(1, m):
        mine = F.when(F.col("_season") == s, F.col(f"_sm{s}")).otherwise(mine)
    seasonal = mine - F.try_divide(total, n_present)
    return (d.withColumn("seasonal", seasonal)
            .withColumn("resid", x - F.col("trend") - F.col("seasonal"))
            .drop("_season", "_detr", *[f"_sm{s}" for s in range(m)]))


def composite_variability(panel: DataFrame, cutoff: str, min_points: int = 8, m: int = 4,
                          key: str = S.UID, ds: str = S.DS, value: str = S.Y) -> DataFrame:
    """std(trend) + std(resid) (population, NULLs skipped) of the
    decomposition of each series' data at or before ``cutoff``; series
    with fewer than ``min_points`` such quarters are left out."""
    early = panel.filter(F.col(ds) <= F.to_date(F.lit(cutoff)))
    # the point count is a window over the same series partitioning as the
    # decomposition: no separate aggregate, shuffle or semi-join
    early = (early.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key)))
             .filter(F.col("_n") >= min_points).drop("_n"))
    dec = seasonal_decompose(early, m, key, ds, value)
    return dec.groupBy(key).agg(
        (F.stddev_pop("trend") + F.stddev_pop("resid")).alias("variability"))


def most_variable_series(variability: DataFrame, key: str = S.UID) -> DataFrame:
    """F8 / T4: the series with the largest score (ties: smallest id)."""
    order = F.struct(-F.col("variability"), F.col(key))
    return variability.agg(F.min_by(F.col(key), order).alias(key),
                           F.max("variability").alias("variability"))


def top_variable_decomposition(panel: DataFrame, cutoff: str, min_points: int = 8,
                               m: int = 4, key: str = S.UID) -> DataFrame:
    """F8: full decomposition of the most variable series (left semi join
    on the one-row winner)."""
    best = most_variable_series(composite_variability(panel, cutoff, min_points, m, key), key)
    return seasonal_decompose(panel.join(best.select(key), key, "left_semi"), m, key)


# ---------------------------------------------------------------------------
# Seasonal AR per series, grouped map.

def _fit_sar(y: np.ndarray, m: int, max_p: int):
    """Least-squares AR(p) with intercept on the lag-m differences, p by
    AICc.  Returns (p, coef) or raises ValueError when too short."""
    d = y[m:] - y[:-m]
    best = None
    for p in range(0, max_p + 1):
        n = len(d) - p
        k = p + 1
        if n - k - 2 <= 0:
            continue
        X = np.ones((n, k))
        for j in range(1, p + 1):
            X[:, j] = d[p - j:len(d) - j]
        coef, *_ = np.linalg.lstsq(X, d[p:], rcond=None)
        rss = float(np.sum((d[p:] - X @ coef) ** 2))
        s2 = max(rss / n, 1e-300)
        aicc = n * math.log(s2) + 2 * (k + 1) + 2 * (k + 1) * (k + 2) / (n - k - 2)
        if best is None or aicc < best[0]:
            best = (aicc, p, coef)
    if best is None:
        raise ValueError("series too short")
    return best[1], best[2]


def _sar_forecast(y: np.ndarray, m: int, p: int, coef: np.ndarray, h: int) -> np.ndarray:
    d = list(y[m:] - y[:-m])
    hist = list(y)
    out = []
    for _ in range(h):
        dn = coef[0] + sum(coef[j] * d[-j] for j in range(1, p + 1))
        yn = hist[-m] + dn
        d.append(dn)
        hist.append(yn)
        out.append(yn)
    return np.array(out)


AR_SCHEMA = T.StructType([
    T.StructField(S.UID, T.StringType()), T.StructField("step", T.IntegerType()),
    T.StructField("forecast", T.DoubleType()), T.StructField("order_p", T.IntegerType()),
    T.StructField("status", T.StringType()), T.StructField("error", T.StringType())])


def _quarter_end_of_index(qi):
    """Quarter-end date of a quarter index (year * 4 + quarter - 1)."""
    return F.last_day(F.make_date((qi / 4).cast("int"), (F.pmod(qi, F.lit(4)) + 1) * 3, F.lit(1)))


def cutoff_index(train: DataFrame, cutoff: str | None, ds: str = S.DS) -> int | None:
    """Quarter index that forecast steps count from: of ``cutoff``, or of the
    last quarter any series has.  NULL for an empty table."""
    end = train.agg(F.max(ds).alias("d")) if cutoff is None else \
        train.sparkSession.range(1).select(F.to_date(F.lit(cutoff)).alias("d"))
    return end.select(quarter_index("d")).first()[0]


def ar_values(qi: np.ndarray, y: np.ndarray, end: int, h: int, m: int, max_p: int, min_points: int):
    """(forecasts or None, order, status, error) for the h quarters after ``end``
    from known values ``y`` at increasing quarters ``qi``."""
    if len(y) < min_points:
        return None, None, "too_short", None
    try:
        y = np.interp(np.arange(qi[0], qi[-1] + 1), qi, y)
        p, coef = _fit_sar(y, m, max_p)
        fc = _sar_forecast(y, m, p, coef, int(end - qi[-1]) + h)[-h:]
    except (ValueError, ArithmeticError, np.linalg.LinAlgError) as e:
        return None, None, "failed", str(e) or type(e).__name__
    if not np.all(np.isfinite(fc)):
        return None, None, "failed", "forecast is not finite"
    return fc, p, "ok", None


def forecast_ar_per_series(train: DataFrame, h: int, m: int = 4, max_p: int = 3,
                           min_points: int = 12, key: str = S.UID, ds: str = S.DS,
                           value: str = S.Y, cutoff: str | None = None) -> DataFrame:
    """one seasonal autoregression per series (lag-m differencing,
    AR(p <= max_p) by AICc), all series in parallel; each fit sees one
    whole series (per-series map, many series per Python call).  Interior
    gaps are filled linearly on the quarter axis.

    Steps count from ``cutoff`` (default: the last quarter of the whole
    table); a series that ends earlier is forecast across its missing
    quarters first, so step k has the same date for every series.
    Every series returns h rows; short or failing series carry a NULL
    forecast and their ``status`` (F6) instead of being dropped, a failed one
    its message in ``error``."""
    end = cutoff_index(train, cutoff, ds)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.dropna(subset=[value]).sort_values("_qi")
        fc, p, status, error = ar_values(rows["_qi"].to_numpy(), rows[value].to_numpy(dtype=float), end, h, m, max_p, min_points)
        return pd.DataFrame({key: pdf[key].iloc[0], "step": np.arange(1, h + 1, dtype=np.int32), "forecast": np.nan if fc is None else fc,
                             "order_p": p, "status": status, "error": error}).astype({"order_p": "Int32"})
    base = train.select(key, quarter_index(ds).alias("_qi"), F.col(value).cast("double").alias(value)) \
        .filter(F.col("_qi") <= F.lit(end))
    out = map_series(base, key, ["_qi"], fit, AR_SCHEMA)
    return (out.withColumn(ds, _quarter_end_of_index(F.lit(end) + F.col("step")))
            .withColumn("forecast", F.when(~F.isnan("forecast"), F.col("forecast"))))


def series_fit_report(forecasts: DataFrame, test: DataFrame, key: str = S.UID) -> DataFrame:
    """per series ok / too_short / failed / no_test_data."""
    st = forecasts.groupBy(key).agg(F.first("status").alias("status"))
    has_test = test.select(key).distinct().withColumn("_t", F.lit(True))
    j = st.join(has_test, key, "left")
    return j.select(key, F.when(F.col("status") != "ok", F.col("status"))
                    .when(F.col("_t").isNull(), "no_test_data").otherwise("ok").alias("status"))


# ---------------------------------------------------------------------------
# global linear autoregression on scaled windows, recursive forecast.

def fit_window_regression(windows: DataFrame, x: str = "x", target: str = "target",
                          reg: float = 0.0, n_steps: int | None = None):
    """Fit target ~ x[0..n_steps-1] over all windows: one distributed pass of
    covariances and a solve in column expressions (``least_squares``).
    ``n_steps``: by default the length of the longest window, read first.
    Returns (intercept, coefficients), the only values that reach the driver;
    (None, []) without windows."""
    if n_steps is None:
        n_steps = windows.agg(F.max(F.size(x))).first()[0] or 0
        if n_steps < 1:
            return None, []
    row = least_squares(windows, n_steps, x, target, reg).first()
    if not row["n"]:
        return None, []
    return row["intercept"], list(row["coefs"])


def recursive_linear_expr(history: Column, intercept: float, coefs: list[float], h: int | Column) -> Column:
    """The h recursive predictions of a linear AR model as one expression:
    ``aggregate(sequence(1, h), (window, out), step)`` — the window of the
    last n values slides by appending each prediction."""
    n = len(coefs)
    init = F.struct(F.slice(history, -n, n).alias("w"),
                    F.array().cast("array<double>").alias("out"))

    def step(acc, _):
        pred = F.lit(intercept)
        for i, c in enumerate(coefs):
            pred = pred + F.lit(c) * acc["w"][i]
        return F.struct(F.concat(F.slice(acc["w"], 2, n - 1), F.array(pred)).alias("w"),
                        F.concat(acc["out"], F.array(pred)).alias("out"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(h) if isinstance(h, int) else h), init, step, lambda acc: acc["out"])


def recursive_linear_forecast(train: DataFrame, h: int, n_steps: int = 4, key: str = S.UID,
                              ds: str = S.DS, value: str = S.Y, reg: float = 0.0,
                              warm_start: str = "train_tail", test: DataFrame | None = None,
                              cutoff: str | None = None):
    """scale each series on its training data (K6), fit one linear
    model on all windows of n_steps scaled values -> next value, then
    forecast by feeding predictions back.  Constant series (K7) repeat
    their value.

    ``warm_start`` (Q12): ``train_tail`` starts from the last n_steps
    training quarters and forecasts h quarters; ``test_head`` starts from
    the first n_steps quarters of ``test`` (scaled with the training
    scaler) and forecasts the h - n_steps test quarters after them.

    Steps count from ``cutoff`` (default: the last training quarter of the
    whole table; n_steps later for ``test_head``); a series whose seed ends
    earlier is first carried to it by its own predictions.  Every series of
    ``train`` returns all its steps: ``status`` is ok, too_short (fewer than
    n_steps seed values), late_seed (the seed ends after the cutoff) or no_model
    (no series has n_steps + 1 values to fit), the latter three with a NULL
    forecast.
    Returns (forecasts, (intercept, coefs))."""
    from qpanel.operators.features import supervised_windows
    # K6 as windows over the series partitioning the supervised windows use
    # too: no scaler table, no join
    wp = Window.partitionBy(key)
    sd = F.stddev_pop(value).over(wp)
    tr = (train.withColumn("mu", F.avg(value).over(wp))
          .withColumn("is_constant", sd < 1e-6)
          .withColumn("sigma", F.when(sd == 0, 1.0).otherwise(sd))
          .withColumn("z", (F.col(value) - F.col("mu")) / F.col("sigma")))
    win = supervised_windows(tr, n_steps, value="z", key=key, order=ds)
    b0, b = fit_window_regression(win, reg=reg, n_steps=n_steps)
    stats = ["mu", "sigma", "is_constant"]
    end = cutoff_index(train, cutoff, ds)
    sc = tr.groupBy(key).agg(*[F.first(c).alias(c) for c in stats])
    if warm_start == "train_tail":
        seed_rows, steps = tr.select(key, ds, "z"), h
    elif warm_start == "test_head":
        if test is None:
            raise ValueError("warm_start='test_head' needs the test rows")
        w = Window.partitionBy(key).orderBy(ds)
        seed_rows = (test.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n_steps)
                     .join(sc, key)
                     .select(key, ds, ((F.col(value) - F.col("mu")) / F.col("sigma")).alias("z")))
        steps = h - n_steps
        end = None if end is None else end + n_steps
    else:
        raise ValueError(f"unknown warm_start {warm_start!r}")
    seeds = seed_rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(ds, "z"))).alias("_s"),
                                       F.max(quarter_index(ds)).alias("_last"))
    hist = sc.join(seeds, key, "left").withColumn("_gap", F.lit(end) - F.col("_last"))
    hist = hist.withColumn("status", F.when(F.coalesce(F.size("_s"), F.lit(0)) < n_steps, "too_short")
                           .when(F.col("_gap") < 0, "late_seed").when(F.lit(b0 is None), "no_model").otherwise("ok"))
    pred = F.lit(None).cast("array<double>") if b0 is None else F.when(
        F.col("status") == "ok", recursive_linear_expr(F.col("_s")["z"], b0, b, F.greatest(F.col("_gap"), F.lit(0)) + steps))
    out = (hist.select(key, "status", *stats, F.greatest("_gap", F.lit(0)).alias("_gap"), pred.alias("_pred"))
           .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
           .withColumn("_z", F.try_element_at("_pred", F.col("_gap") + F.col("step")))
           .select(key, "step", _quarter_end_of_index(F.lit(end) + F.col("step")).alias(ds),
                   F.when(F.col("_z").isNull(), None).when(F.col("is_constant"), F.col("mu"))
                   .otherwise(F.col("_z") * F.col("sigma") + F.col("mu")).alias("forecast"), "status"))
    return out, (b0, b)


# ---------------------------------------------------------------------------
# K8 + F14: blocks of series, one ridge vector autoregression per block.

def series_blocks(panel: DataFrame, size: int, key: str = S.UID) -> DataFrame:
    """K8: block id = floor((rank - 1) / size) over the sorted series ids
    (ranks computed without a single-task window)."""
    rk = global_rank(panel.select(key), key)
    return rk.select(key, F.floor((F.col("rank") - 1) / size).cast("int").alias("block"))


def var_rows(pdf: pd.DataFrame, end: int, h: int, lags: int, ridge: float, key: str = S.UID) -> pd.DataFrame:
    """The h forecasts after quarter ``end`` of one block of series (key, _qi, _y)."""
    last_qi = pdf.dropna(subset=["_y"]).groupby(key)["_qi"].max()
    mat = pdf.pivot_table(index="_qi", columns=key, values="_y", aggfunc="first", dropna=False)
    mat = mat.reindex(np.arange(mat.index.min(), end + 1))
    mat = mat.interpolate(limit_direction="both").fillna(0.0)
    mu = mat.mean()
    sd = mat.std(ddof=0).replace(0.0, 1.0)
    z = ((mat - mu) / sd).to_numpy()
    t, k = z.shape
    steps = np.arange(1, h + 1, dtype=np.int32)
    cols = list(mat.columns)
    if t <= lags + 1:
        lev, status = np.full((h, k), np.nan), ["too_short"] * k
    else:
        X = np.hstack([z[lags - j - 1:t - j - 1] for j in range(lags)])
        X = np.hstack([np.ones((X.shape[0], 1)), X])
        Y = z[lags:]
        pen = ridge * np.eye(X.shape[1])
        pen[0, 0] = 0.0
        W = np.linalg.solve(X.T @ X + pen, X.T @ Y)
        hist = list(z[-lags:])
        for _ in range(h):
            xv = np.concatenate([[1.0]] + [hist[-j - 1] for j in range(lags)])
            hist.append(xv @ W)
        lev = np.array(hist[lags:]) * sd.to_numpy() + mu.to_numpy()
        status = ["ok" if last_qi.get(c, -1) == end else "filled_to_cutoff" for c in cols]
    return pd.DataFrame({key: np.repeat(cols, h), "step": np.tile(steps, k),
                         "forecast": lev.T.reshape(-1), "status": np.repeat(status, h)})


def forecast_blocks(train: DataFrame, h: int, block_size: int = 8, lags: int = 4,
                    ridge: float = 1.0, key: str = S.UID, ds: str = S.DS,
                    value: str = S.Y, cutoff: str | None = None) -> DataFrame:
    """per block, scale each series (K6), stack the block's series as
    one multivariate series up to ``cutoff`` (default: the last quarter of
    the whole table; missing cells are interpolated, ends repeated) and fit a
    ridge VAR(lags) in NumPy; forecast recursively h quarters from the cutoff
    and undo the scaling.  A Python call holds one block: at most
    ``block_size`` series x quarters.  Every series returns h rows with a
    ``status``: too_short (a block of lags + 1 quarters or fewer cannot be
    fitted, NULL forecast), filled_to_cutoff (the series ends earlier) or ok."""
    blocks = series_blocks(train, block_size, key)
    end = cutoff_index(train, cutoff, ds)
    data = train.join(blocks, key).select("block", key, quarter_index(ds).alias("_qi"),
                                          F.col(value).cast("double").alias("_y")).filter(F.col("_qi") <= F.lit(end))
    schema = T.StructType([T.StructField(key, T.StringType()), T.StructField("step", T.IntegerType()),
                           T.StructField("forecast", T.DoubleType()), T.StructField("status", T.StringType())])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        return var_rows(pdf, end, h, lags, ridge, key)
    out = data.groupBy("block").applyInPandas(fit, schema)
    return (out.withColumn(ds, _quarter_end_of_index(F.lit(end) + F.col("step")))
            .withColumn("forecast", F.when(~F.isnan("forecast"), F.col("forecast"))))
