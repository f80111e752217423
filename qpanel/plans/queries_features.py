"""Registered queries: per-series features, static stats, windows."""
from __future__ import annotations

from pyspark.sql import functions as F

from qpanel import schema as S
from qpanel.operators import features as FE
from qpanel.plans import panels as P
from qpanel.plans.catalog import register
from qpanel.plans.output import round_doubles
from qpanel.plans.sql import panel_sql, qidx
from qpanel.plans.sql import r as _r

# Means of 2-decimal sums have exact values with up to 5 decimals; rounding
# at 6 digits can never land on a tie, so both engines agree.
D = 6


# Sample standard deviations of ~1e6 values differ between the engines'
# moment algorithms around 1e-13 relative: compare them at cents.
STD_COLS = {"roll_std_8": 2, "roll_std_4": 2, "stat_std": 2, "sigma": 2}


def r(expr: str, name: str | None = None) -> str:
    return _r(expr, STD_COLS.get(name, D))

_PREP = f"""WITH panel AS ({panel_sql('region')}),
b AS (SELECT unique_id, rep, cp, basis, ds, greatest(y, 0) AS exposure,
             ln(1 + greatest(y, 0)) AS y_log
      FROM panel WHERE y IS NOT NULL AND NOT isnan(y) AND NOT isinf(y))"""

_W = "PARTITION BY unique_id ORDER BY ds"


def _prepared(spark, sf_dir):
    return FE.prepare_log(P.shared(P.coarse_panel(spark, sf_dir))).drop(S.Y)


def features_full(spark, sf_dir):
    """K3 on the coarse panel (exposure level, log target kept)."""
    f = FE.panel_features(_prepared(spark, sf_dir))
    return round_doubles(f, D, STD_COLS)


def _moment_sql(x: str, win: int) -> str:
    fr = f"OVER ({_W} ROWS BETWEEN {win} PRECEDING AND 1 PRECEDING)"
    n = f"count({x}) {fr}"
    return (f"CASE WHEN {n} >= 4 THEN skewness({x}) {fr} END AS roll_skew_{win}, "
            f"CASE WHEN {n} >= 4 THEN kurtosis({x}) {fr} END AS roll_kurt_{win}")


_FULL_COLS = (["unique_id", "rep", "cp", "basis", "ds"],
              ["exposure", "y_log", "lag_1", "lag_2", "lag_3", "lag_4", "lag_8",
               "roll_mean_8", "roll_std_8", "roll_skew_8", "roll_kurt_8", "roll_min_8", "roll_max_8",
               "pct_gap_1",
               "prop_gap_1", "q_sin", "q_cos", "ctrpty_quarter_season", "ctrpty_quarter_anom"],
              ["zero_flag", "nonzero_count", "quarters_since_nonzero", "qnum"])


def _final(cols, src="f"):
    keys, dbl, ints = cols
    return "SELECT " + ", ".join(
        [f'"{k}"' for k in keys] + [f'{r(chr(34) + d + chr(34), d)} AS "{d}"' for d in dbl]
        + [f'"{i}"' for i in ints]) + f" FROM {src}"


register("features_full", _PREP + f""",
f AS (SELECT *,
  lag(exposure, 1) OVER ({_W}) AS lag_1, lag(exposure, 2) OVER ({_W}) AS lag_2,
  lag(exposure, 3) OVER ({_W}) AS lag_3, lag(exposure, 4) OVER ({_W}) AS lag_4,
  lag(exposure, 8) OVER ({_W}) AS lag_8,
  avg(exposure) OVER ({_W} ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS roll_mean_8,
  stddev_samp(exposure) OVER ({_W} ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS roll_std_8,
  {_moment_sql('exposure', 8)},
  min(exposure) OVER ({_W} ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS roll_min_8,
  max(exposure) OVER ({_W} ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS roll_max_8,
  (exposure - lag(exposure, 1) OVER ({_W})) / nullif(lag(exposure, 1) OVER ({_W}), 0) AS pct_gap_1,
  (exposure - lag(exposure, 1) OVER ({_W})) / nullif(lag(exposure, 1) OVER ({_W}), 0) AS prop_gap_1,
  CAST(exposure = 0 AS INTEGER) AS zero_flag,
  CAST(sum(CASE WHEN exposure <> 0 THEN 1 ELSE 0 END) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS nonzero_count,
  CAST({qidx('ds')} - last(CASE WHEN exposure <> 0 THEN {qidx('ds')} END IGNORE NULLS)
       OVER ({_W} ROWS UNBOUNDED PRECEDING) AS INTEGER) AS quarters_since_nonzero,
  CAST(quarter(ds) AS INTEGER) AS qnum,
  sin(2 * pi() * (quarter(ds) - 1) / 4) AS q_sin, cos(2 * pi() * (quarter(ds) - 1) / 4) AS q_cos,
  avg(exposure) OVER (PARTITION BY cp, quarter(ds)) AS ctrpty_quarter_season,
  exposure - avg(exposure) OVER (PARTITION BY cp, quarter(ds)) AS ctrpty_quarter_anom
FROM b)
{_final(_FULL_COLS)}""")(features_full)


def features_short(spark, sf_dir):
    """K4 + K5 on the coarse panel."""
    f = FE.panel_features_more(FE.panel_features_short(_prepared(spark, sf_dir)))
    return round_doubles(f, D, STD_COLS)


_SHORT_COLS = (["unique_id", "rep", "cp", "basis", "ds"],
               ["exposure", "y_log", "lag_1", "lag_2", "lag_3", "lag_4", "roll_mean_4",
                "roll_std_4", "pct_change_1", "pct_change_4", "q_sin", "q_cos", "ctrpty_avg",
                "seasonal_anom", "ratio_to_ctrpty_avg", "qoq_pct", "yoy_pct", "roll_slope_4",
                "dev_from_period_mean"],
               ["qnum", "miss_count_4"])

register("features_short", _PREP + f""",
f AS (SELECT *,
  lag(exposure, 1) OVER ({_W}) AS lag_1, lag(exposure, 2) OVER ({_W}) AS lag_2,
  lag(exposure, 3) OVER ({_W}) AS lag_3, lag(exposure, 4) OVER ({_W}) AS lag_4,
  avg(exposure) OVER ({_W} ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS roll_mean_4,
  stddev_samp(exposure) OVER ({_W} ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS roll_std_4,
  (exposure - lag(exposure, 1) OVER ({_W})) / nullif(lag(exposure, 1) OVER ({_W}), 0) AS pct_change_1,
  (exposure - lag(exposure, 4) OVER ({_W})) / nullif(lag(exposure, 4) OVER ({_W}), 0) AS pct_change_4,
  CAST(quarter(ds) AS INTEGER) AS qnum,
  sin(2 * pi() * (quarter(ds) - 1) / 4) AS q_sin, cos(2 * pi() * (quarter(ds) - 1) / 4) AS q_cos,
  avg(exposure) OVER (PARTITION BY cp, ds) AS ctrpty_avg,
  exposure - avg(exposure) OVER (PARTITION BY ds) AS seasonal_anom,
  exposure / nullif(avg(exposure) OVER (PARTITION BY cp, ds), 0) AS ratio_to_ctrpty_avg,
  (exposure - lag(exposure, 1) OVER ({_W})) / nullif(lag(exposure, 1) OVER ({_W}), 0) AS qoq_pct,
  (exposure - lag(exposure, 4) OVER ({_W})) / nullif(lag(exposure, 4) OVER ({_W}), 0) AS yoy_pct,
  CASE WHEN count(*) OVER ({_W} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) = 4
       THEN regr_slope(exposure, t) OVER ({_W} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) END AS roll_slope_4,
  CAST(sum(CASE WHEN exposure IS NULL THEN 1 ELSE 0 END) OVER ({_W} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS BIGINT) AS miss_count_4,
  exposure - avg(exposure) OVER (PARTITION BY ds) AS dev_from_period_mean
FROM (SELECT *, CAST(row_number() OVER ({_W}) AS DOUBLE) AS t FROM b) b)
{_final(_SHORT_COLS)}""")(features_short)


def static_stats_join(spark, sf_dir):
    """A15 + J1: train-only per-series stats joined onto the test rows."""
    prep = _prepared(spark, sf_dir)
    train, test = P.split_train_test(prep)
    _, te = FE.with_static_stats(train, test)
    return round_doubles(te.select(S.UID, S.DS, "y_log", "stat_mean", "stat_std",
                                   "stat_min", "stat_max"), D, STD_COLS)


register("static_stats_join", _PREP + f""",
st AS (SELECT unique_id, avg(y_log) AS stat_mean, stddev_samp(y_log) AS stat_std,
              min(y_log) AS stat_min, max(y_log) AS stat_max
       FROM b WHERE ds <= DATE '1999-12-31' GROUP BY unique_id)
SELECT unique_id, ds, {r('y_log')} AS y_log, {r('stat_mean')} AS stat_mean, {r('stat_std', 'stat_std')} AS stat_std,
       {r('stat_min')} AS stat_min, {r('stat_max')} AS stat_max
FROM b JOIN st USING (unique_id) WHERE ds BETWEEN DATE '2000-01-01' AND DATE '2001-12-31'""")(static_stats_join)


def supervised_windows_q(spark, sf_dir):
    """Windows of the previous 4 log values -> current value."""
    prep = _prepared(spark, sf_dir)
    sw = FE.supervised_windows(prep, 4, value="y_log")
    return sw.select(S.UID, S.DS, (F.round("target", D) + 0.0).alias("target"),
                     F.transform("x", lambda v: F.round(v, D) + F.lit(0.0)).alias("x"))


register("supervised_windows", _PREP + f"""
SELECT unique_id, ds, {r('y_log')} AS target, x FROM (
  SELECT unique_id, ds, y_log,
         list_transform(list(y_log) OVER ({_W} ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING),
                        lambda v: round(v, 6) + 0.0) AS x
  FROM b) WHERE len(x) = 4""")(supervised_windows_q)


def centred_trend(spark, sf_dir):
    """2x4 centred moving average per series."""
    t = FE.centred_moving_average(P.coarse_panel(spark, sf_dir))
    return round_doubles(t.select(S.UID, S.DS, S.Y, "trend"), D)


register("centred_trend", f"""WITH panel AS ({panel_sql('region')})
SELECT unique_id, ds, {r('y')} AS y, {r(f'''(lag(y, 2) OVER ({_W}) / 2 + lag(y, 1) OVER ({_W}) + y
  + lead(y, 1) OVER ({_W}) + lead(y, 2) OVER ({_W}) / 2) / 4''')} AS trend FROM panel""")(centred_trend)


def series_scaling(spark, sf_dir):
    """K6 + K7: per-series z-score fitted on train, applied to test."""
    train, test = P.split_train_test(P.shared(P.coarse_panel(spark, sf_dir)))
    sc, _, te = FE.scale_series(train, test)
    return round_doubles(te.select(S.UID, S.DS, "mu", "sigma", "is_constant", "z"), D, STD_COLS)


register("series_scaling", f"""WITH panel AS ({panel_sql('region')}),
sc AS (SELECT unique_id, avg(y) AS mu, CASE WHEN stddev_pop(y) = 0 THEN 1.0 ELSE stddev_pop(y) END AS sigma,
              stddev_pop(y) < 1e-6 AS is_constant
       FROM panel WHERE ds <= DATE '1999-12-31' GROUP BY unique_id)
SELECT unique_id, ds, {r('mu')} AS mu, {r('sigma', 'sigma')} AS sigma, is_constant, {r('(y - mu) / sigma')} AS z
FROM panel JOIN sc USING (unique_id) WHERE ds BETWEEN DATE '2000-01-01' AND DATE '2001-12-31'""")(series_scaling)
