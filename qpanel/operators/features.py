"""Per-series features.

Plan shape: every per-series feature uses ONE window spec (partition by
the series key, order by date), so Spark plans a single exchange and a
single sort for all of them.  A series holds at most one row per quarter,
so each window partition is bounded by the calendar length however large
the data grows.

Means over coarse groups (counterparty x quarter-of-year, period,
quarter label) are NOT windows: a window partitioned by a low-cardinality
key would send a hot counterparty to one task.  They are partial
aggregates joined back on the group key; the aggregate (groups, not rows)
is materialised, counted and broadcast when the count proves it small, so
the feature rows are not shuffled again by counterparty.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qpanel import schema as S
from qpanel.functions.dates import quarter_index
from qpanel.functions.numeric import clip, finite_or_null, safe_div
from qpanel.plans.joins import broadcast_bounded


def series_window(key: str = S.UID, order: str = S.DS):
    return Window.partitionBy(key).orderBy(order)


def prepare_log(panel: DataFrame, value: str = S.Y, out: str = "y_log",
                cap: Column | float | None = None) -> DataFrame:
    """K2 (and K1 with ``cap``): ±inf/NaN -> NULL, drop, cap, floor 0, log1p.

    Keeps the level in ``exposure``.  One defined order (Q5).
    """
    x = finite_or_null(value)
    df = panel.withColumn("exposure", x).filter(F.col("exposure").isNotNull())
    e = F.col("exposure")
    if cap is not None:
        e = clip(e, upper=cap)
    e = clip(e, lower=0.0)
    return df.withColumn("exposure", e).withColumn(out, F.log1p("exposure"))


def _rolling_moments(x: Column, frame) -> dict[str, Column]:
    n = F.count(x).over(frame)
    g1 = F.skewness(x).over(frame)
    g2 = F.kurtosis(x).over(frame)
    # bias-corrected (pandas) forms of Spark's population skewness/kurtosis
    skew = F.when(n >= 4, F.sqrt(n * (n - 1)) / (n - 2) * g1)
    kurt = F.when(n >= 4, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))
    return {"n": n, "skew": skew, "kurt": kurt}


# Features that read the quarter being described (Q10); lags, prior-window
# statistics and calendar terms only look backwards already.
CONTEMPORANEOUS = ["pct_gap_1", "prop_gap_1", "zero_flag", "nonzero_count",
                   "quarters_since_nonzero", "ctrpty_quarter_season", "ctrpty_quarter_anom",
                   "pct_change_1", "pct_change_4", "seasonal_anom", "ctrpty_avg",
                   "ratio_to_ctrpty_avg", "qoq_pct", "yoy_pct", "roll_slope_4", "miss_count_4",
                   "dev_from_period_mean"]


def shift_contemporaneous(df: DataFrame, key: str = S.UID, order: str = S.DS) -> DataFrame:
    """Q10 modelling mode: every feature that reads the current quarter is
    replaced by its value one quarter earlier in the same series, so a
    row's own value never enters its features (one window pass).  Note:
    the counterparty x season mean is a full-sample statistic in both
    modes (as in the reference); use the lag features for strict
    past-only inputs."""
    w = series_window(key, order)
    cols = [c for c in CONTEMPORANEOUS if c in df.columns]
    return df.select(*[F.lag(c, 1).over(w).alias(c) if c in cols else F.col(c) for c in df.columns])


def panel_features(df: DataFrame, value: str = "exposure", lags=(1, 2, 3, 4, 8),
                   win: int = 8, key: str = S.UID, cp: str = S.CP,
                   order: str = S.DS, contemporaneous: bool = True) -> DataFrame:
    """K3 (+ W6): lags, prior-window mean/std/skew/kurt/min/max, change ratios, zero flags,
    non-zero counters, counterparty x quarter seasonality, cyclic quarter.

    Windows are per series (Q3: the reference's rolled across series).
    """
    x = F.col(value)
    w = series_window(key, order)
    prior = w.rowsBetween(-win, -1)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mom = _rolling_moments(x, prior)
    qi = quarter_index(order)
    last_nz = F.last(F.when(x != 0, qi), ignorenulls=True).over(upto)
    cols = {f"lag_{k}": F.lag(x, k).over(w) for k in lags}
    cols.update({
        f"roll_mean_{win}": F.avg(x).over(prior),
        f"roll_std_{win}": F.stddev_samp(x).over(prior),
        f"roll_skew_{win}": mom["skew"],
        f"roll_kurt_{win}": mom["kurt"],
        f"roll_min_{win}": F.min(x).over(prior),   # W6
        f"roll_max_{win}": F.max(x).over(prior),
        "pct_gap_1": safe_div(x - F.lag(x, 1).over(w), F.lag(x, 1).over(w)),
        "prop_gap_1": safe_div(x - F.lag(x, 1).over(w), F.lag(x, 1).over(w)),
        "zero_flag": (x == 0).cast("int"),
        # the reference names this time_since_nonzero; it counts non-zero
        # quarters so far (Q4).  quarters_since_nonzero is the true gap.
        "nonzero_count": F.sum((x != 0).cast("int")).over(upto),
        "quarters_since_nonzero": qi - last_nz,
        "qnum": F.quarter(order),
    })
    out = df.select("*", *[c.alias(n) for n, c in cols.items()])
    out = cyclic_quarter(out, "qnum")
    season = broadcast_bounded(df.groupBy(cp, F.quarter(order).alias("qnum"))
                               .agg(F.avg(value).alias("ctrpty_quarter_season")))
    out = out.join(season, [cp, "qnum"], "left")
    out = out.withColumn("ctrpty_quarter_anom", x - F.col("ctrpty_quarter_season"))
    return out if contemporaneous else shift_contemporaneous(out, key, order)


def cyclic_quarter(df: DataFrame, qnum: str = "qnum") -> DataFrame:
    """Sin / cos of the quarter on the unit circle."""
    a = 2 * math.pi * (F.col(qnum) - 1) / 4
    return df.withColumn("q_sin", F.sin(a)).withColumn("q_cos", F.cos(a))


def panel_features_short(df: DataFrame, value: str = "exposure", lags=(1, 2, 3, 4),
                         win: int = 4, key: str = S.UID, cp: str = S.CP,
                         order: str = S.DS) -> DataFrame:
    """K4: lags, prior-4 mean/std, 1- and 4-step change, deviation from the
    same-period mean, counterparty x period mean and ratio, cyclic quarter."""
    x = F.col(value)
    w = series_window(key, order)
    prior = w.rowsBetween(-win, -1)
    cols = {f"lag_{k}": F.lag(x, k).over(w) for k in lags}
    cols.update({
        f"roll_mean_{win}": F.avg(x).over(prior),
        f"roll_std_{win}": F.stddev_samp(x).over(prior),
        "pct_change_1": safe_div(x - F.lag(x, 1).over(w), F.lag(x, 1).over(w)),
        "pct_change_4": safe_div(x - F.lag(x, 4).over(w), F.lag(x, 4).over(w)),
        "qnum": F.quarter(order),
    })
    out = cyclic_quarter(df.select("*", *[c.alias(n) for n, c in cols.items()]))
    per_period = broadcast_bounded(df.groupBy(order).agg(F.avg(value).alias("_period_mean")))
    per_cp = broadcast_bounded(df.groupBy(cp, order).agg(F.avg(value).alias("ctrpty_avg")))
    out = out.join(per_period, order, "left").join(per_cp, [cp, order], "left")
    # The quarter label holds the year, so its mean is the period mean
    return (out.withColumn("seasonal_anom", x - F.col("_period_mean"))
            .withColumn("ratio_to_ctrpty_avg", safe_div(x, F.col("ctrpty_avg")))
            .drop("_period_mean"))


def panel_features_more(df: DataFrame, value: str = "exposure", win: int = 4,
                        key: str = S.UID, order: str = S.DS) -> DataFrame:
    """K5: q/q and y/y change, slope of the last 4 (full windows only),
    missing count of the last 4, deviation from the period mean."""
    x = F.col(value)
    w = series_window(key, order)
    last = w.rowsBetween(-(win - 1), 0)
    t = F.row_number().over(w).cast("double")
    df1 = df.withColumn("_t", t)
    n = F.count(F.lit(1)).over(last)
    cols = {
        "qoq_pct": safe_div(x - F.lag(x, 1).over(w), F.lag(x, 1).over(w)),
        "yoy_pct": safe_div(x - F.lag(x, 4).over(w), F.lag(x, 4).over(w)),
        f"roll_slope_{win}": F.when((n == win) & (F.count(x).over(last) == win),
                                    F.regr_slope(x, F.col("_t")).over(last)),
        f"miss_count_{win}": F.sum(x.isNull().cast("int")).over(last),
    }
    out = df1.select("*", *[c.alias(k) for k, c in cols.items()]).drop("_t")
    per_period = broadcast_bounded(df.groupBy(order).agg(F.avg(value).alias("_pm")))
    return (out.join(per_period, order, "left")
            .withColumn("dev_from_period_mean", x - F.col("_pm")).drop("_pm"))


def static_stats(train: DataFrame, value: str = "y_log", key: str = S.UID) -> DataFrame:
    """Per-series mean / sample std / min / max of the training data."""
    return train.groupBy(key).agg(F.avg(value).alias("stat_mean"),
                                  F.stddev_samp(value).alias("stat_std"),
                                  F.min(value).alias("stat_min"),
                                  F.max(value).alias("stat_max"))


def with_static_stats(train: DataFrame, other: DataFrame, value: str = "y_log",
                      key: str = S.UID):
    """Train-only stats joined (inner) onto train and another split."""
    st = static_stats(train, value, key)
    return train.join(st, key), other.join(st, key)


def forward_fill_features(df: DataFrame, cols, key: str = S.UID,
                          order: str = S.DS) -> DataFrame:
    """Forward fill per series, then 0."""
    upto = series_window(key, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.select(*[c for c in df.columns if c not in cols],
                     *[F.coalesce(F.last(c, ignorenulls=True).over(upto), F.lit(0.0)).alias(c)
                       for c in cols])


def supervised_windows(df: DataFrame, n_steps: int, value: str = S.Y,
                       key: str = S.UID, order: str = S.DS) -> DataFrame:
    """(x = previous n_steps values, target = current) per series row;
    rows without a full history are dropped."""
    w = series_window(key, order)
    hist = F.collect_list(value).over(w.rowsBetween(-n_steps, -1))
    return (df.select(key, order, F.col(value).alias("target"), hist.alias("x"))
            .filter(F.size("x") == n_steps))


def centred_moving_average(df: DataFrame, value: str = S.Y, key: str = S.UID,
                           order: str = S.DS) -> DataFrame:
    """2x4 centred moving average (the trend of a quarterly
    decomposition); NULL within two quarters of either end."""
    w = series_window(key, order)
    x = F.col(value)
    trend = (F.lag(x, 2).over(w) / 2 + F.lag(x, 1).over(w) + x
             + F.lead(x, 1).over(w) + F.lead(x, 2).over(w) / 2) / 4
    return df.withColumn("trend", trend)


def scale_series(train: DataFrame, other: DataFrame | None = None,
                 value: str = S.Y, key: str = S.UID):
    """K6: per-series z-score fitted on train (population std, 0 -> 1).

    Returns (scaler, train_scaled, other_scaled); ``unscale`` inverts it.
    """
    sc = train.groupBy(key).agg(F.avg(value).alias("mu"),
                                F.stddev_pop(value).alias("_sd"))
    sc = sc.select(key, "mu", F.when(F.col("_sd") == 0, 1.0).otherwise(F.col("_sd"))
                   .alias("sigma"), (F.col("_sd") < 1e-6).alias("is_constant"))
    z = (F.col(value) - F.col("mu")) / F.col("sigma")
    tr = train.join(sc, key).withColumn("z", z)
    ot = other.join(sc, key).withColumn("z", z) if other is not None else None
    return sc, tr, ot


def unscale(df: DataFrame, col: str = "z_hat", out: str = "y_hat") -> DataFrame:
    """Inverse of K6 (needs mu, sigma columns)."""
    return df.withColumn(out, F.col(col) * F.col("sigma") + F.col("mu"))


def constant_series(df: DataFrame, value: str = S.Y, key: str = S.UID,
                    tol: float = 1e-6) -> DataFrame:
    """K7: series whose population std is below ``tol``."""
    return (df.groupBy(key).agg(F.stddev_pop(value).alias("std_pop"))
            .withColumn("is_constant", F.col("std_pop") < tol))
