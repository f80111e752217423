"""Registered queries: stacked predictions of all statistical models and
the comparison tables computed from them."""
from __future__ import annotations

from pyspark.sql import functions as F

from qpanel import schema as S
from qpanel.operators import compare as CP
from qpanel.operators import forecast as fc
from qpanel.operators import metrics as M
from qpanel.operators import reshape as R
from qpanel.plans import panels as P
from qpanel.plans.catalog import register
from qpanel.plans.output import round_doubles
from qpanel.plans.sql import metric_cols, panel_sql, qidx, r

MODELS = ["naive", "seasonal_naive", "seasonal_window_average"]
H = 8


def predictions(spark, sf_dir):
    """In-place scored rows of every model, stacked with ``model``."""
    panel = P.shared(P.coarse_panel(spark, sf_dir))
    parts = {m: fc.score_in_place(panel, m, P.TRAIN_END, H) for m in MODELS}
    return CP.stack_predictions(parts).withColumnRenamed("step", "horizon")


PRED_SQL = f"""WITH panel AS ({panel_sql('region')}),
p AS (SELECT *, {qidx('ds')} AS qi, {qidx('ds')} - {qidx("DATE '1999-12-31'")} AS step FROM panel),
t AS (SELECT * FROM p WHERE step BETWEEN 1 AND {H} AND y IS NOT NULL),
sn AS (SELECT 'seasonal_naive' AS model, t.unique_id, t.ds, t.step AS horizon, t.y AS actual, b.y AS forecast
       FROM t JOIN p b ON b.unique_id = t.unique_id AND b.step <= 0
        AND b.qi = t.qi - 4 * CAST(ceil(t.step / 4.0) AS INTEGER) AND b.y IS NOT NULL),
nv AS (SELECT 'naive' AS model, t.unique_id, t.ds, t.step AS horizon, t.y AS actual, l.forecast
       FROM t JOIN (SELECT unique_id, arg_max(y, ds) AS forecast FROM p
                    WHERE step <= 0 AND y IS NOT NULL GROUP BY 1) l USING (unique_id)),
nt AS (SELECT unique_id, count(y) FILTER (WHERE step <= 0) AS n_train FROM p GROUP BY 1),
sw AS (SELECT 'seasonal_window_average' AS model, t.unique_id, t.ds, t.step AS horizon, t.y AS actual,
              avg(b.y) AS forecast
       FROM t JOIN p b ON b.unique_id = t.unique_id AND b.step <= 0 AND b.y IS NOT NULL
        AND b.qi IN (t.qi - 4 * CAST(ceil(t.step / 4.0) AS INTEGER),
                     t.qi - 4 * CAST(ceil(t.step / 4.0) AS INTEGER) - 4,
                     t.qi - 4 * CAST(ceil(t.step / 4.0) AS INTEGER) - 8)
       JOIN nt ON nt.unique_id = t.unique_id AND nt.n_train >= 12
       GROUP BY ALL),
preds AS (SELECT * FROM sn UNION ALL SELECT * FROM nv UNION ALL
          SELECT model, unique_id, ds, horizon, actual, forecast FROM sw)"""


def prediction_records(spark, sf_dir):
    """The standard prediction record, keys split from the id."""
    p = predictions(spark, sf_dir).select("model", S.DS, S.UID, "actual", "forecast")
    std = R.split_uid(p, S.KEYS)
    return round_doubles(std.select("model", S.DS, S.UID, *S.KEYS, "actual", "forecast"), 4)


register("prediction_records", PRED_SQL + f"""
SELECT model, ds, unique_id, split_part(unique_id, '_', 1) AS rep, split_part(unique_id, '_', 2) AS cp,
       split_part(unique_id, '_', 3) AS basis, {r('actual')} AS actual, {r('forecast')} AS forecast
FROM preds""")(prediction_records)


def model_metrics(spark, sf_dir):
    """E11 after P14 / W16: cutoff = first test date, horizon = rank of
    the date per (model, series), RMSE / Log-RMSE / SMAPE / WMAPE."""
    p = predictions(spark, sf_dir).drop("horizon")
    cut = P.TRAIN_END
    p = fc.assign_horizon(p, cut, by=("model",), mode="rank")
    return M.compute_metrics(p, by=("model", "horizon"), digits=4)


register("model_metrics", PRED_SQL + f"""
, h AS (SELECT model, actual, forecast,
               CAST(row_number() OVER (PARTITION BY model, unique_id ORDER BY ds) AS INTEGER) AS horizon
        FROM preds WHERE ds > DATE '1999-12-31')
SELECT model, horizon, {metric_cols()} FROM h GROUP BY model, horizon""")(model_metrics)

_MM = PRED_SQL + f"""
, mm AS (SELECT model, horizon, {metric_cols(digits=12)} FROM preds GROUP BY model, horizon),
s AS (SELECT model, avg(rmse) AS rmse_mean, avg(smape) AS smape_mean, avg(wmape) AS wmape_mean,
             avg(log_rmse) AS log_rmse_mean,
             CASE model WHEN 'naive' THEN 'Naïve' WHEN 'seasonal_naive' THEN 'Seasonal_Naive'
                        WHEN 'seasonal_window_average' THEN 'Seasonal_Window_Avg' ELSE 'Other' END AS category
      FROM mm GROUP BY model)"""


def _metrics_all(spark, sf_dir):
    return M.compute_metrics(predictions(spark, sf_dir), by=("model", "horizon"))


def model_summary(spark, sf_dir):
    """Mean metrics per model with its category."""
    return round_doubles(CP.model_summary(_metrics_all(spark, sf_dir)), 4)


register("model_summary", _MM + f"""
SELECT model, {r('rmse_mean')} AS rmse_mean, {r('smape_mean')} AS smape_mean,
       {r('wmape_mean')} AS wmape_mean, {r('log_rmse_mean')} AS log_rmse_mean, category FROM s""")(model_summary)


def best_per_category(spark, sf_dir):
    """Best model per category and metric (arg-min, name tie-break)."""
    s = CP.model_summary(_metrics_all(spark, sf_dir))
    return round_doubles(CP.best_per_category(s), 4)


register("best_per_category", _MM + f"""
, l AS (UNPIVOT s ON rmse_mean, smape_mean, wmape_mean, log_rmse_mean INTO NAME metric VALUE value)
SELECT metric, category, arg_min(model, (value, model)) AS model, {r('min(value)')} AS value
FROM l GROUP BY metric, category""")(best_per_category)


def metric_by_horizon(spark, sf_dir):
    """Horizon x model RMSE table."""
    return round_doubles(CP.metric_by_horizon(_metrics_all(spark, sf_dir), "rmse", MODELS), 4)


register("metric_by_horizon", PRED_SQL + f"""
, mm AS (SELECT model, horizon, sqrt(avg(pow(forecast - actual, 2))) AS rmse FROM preds GROUP BY ALL)
SELECT horizon, {", ".join(f"{r(f'max(rmse) FILTER (WHERE model = {chr(39)}{m}{chr(39)})')} AS {m}" for m in MODELS)}
FROM mm GROUP BY horizon""")(metric_by_horizon)


def metric_variants(spark, sf_dir):
    """The reference's WMAPE variants, MAE, non-zero MAPE/RMSE."""
    p = predictions(spark, sf_dir)
    return p.groupBy("model").agg(
        F.round(M.wmape(variant="signed"), 6).alias("wmape_signed"),
        F.round(M.wmape(variant="abs"), 6).alias("wmape_abs"),
        F.round(M.wmape(variant="finite"), 6).alias("wmape_finite"),
        F.round(M.wmape(variant="nullskip"), 6).alias("wmape_nullskip"),
        F.round(M.mae(), 4).alias("mae"),
        F.round(M.mape_nonzero(), 6).alias("mape_nonzero"),
        F.round(M.rmse_nonzero(), 4).alias("rmse_nonzero"),
        F.round(M.rmse_log1p(F.log1p("actual"), "forecast"), 6).alias("rmse_log1p"))


register("metric_variants", PRED_SQL + f"""
SELECT model, round(sum(abs(actual - forecast)) / nullif(sum(actual), 0), 6) AS wmape_signed,
  round(sum(abs(actual - forecast)) / nullif(sum(abs(actual)), 0), 6) AS wmape_abs,
  round(sum(abs(actual - forecast)) FILTER (WHERE isfinite(actual) AND isfinite(forecast))
        / nullif(sum(abs(actual)) FILTER (WHERE isfinite(actual) AND isfinite(forecast)), 0), 6) AS wmape_finite,
  round(sum(abs(actual - forecast)) / nullif(sum(abs(actual)), 0), 6) AS wmape_nullskip,
  round(avg(abs(forecast - actual)), 4) AS mae,
  round(avg(abs((actual - forecast) / actual)) FILTER (WHERE actual > 0) * 100, 6) AS mape_nonzero,
  round(sqrt(avg(pow(forecast - actual, 2)) FILTER (WHERE actual > 0)), 4) AS rmse_nonzero,
  round(sqrt(avg(pow(ln(1 + actual) - ln(1 + forecast), 2))), 6) AS rmse_log1p
FROM preds GROUP BY model""")(metric_variants)


def wmape_rollup(spark, sf_dir):
    """Seasonal-naive WMAPE per series and overall (one ROLLUP)."""
    p = predictions(spark, sf_dir).filter(F.col("model") == "seasonal_naive")
    return M.wmape_rollup(p, S.UID, digits=6)


register("wmape_rollup", PRED_SQL + f"""
SELECT unique_id, round(sum(abs(actual - forecast)) / nullif(sum(abs(actual)), 0), 6) AS wmape,
       CAST(grouping(unique_id) AS INTEGER) AS is_total
FROM preds WHERE model = 'seasonal_naive' GROUP BY ROLLUP (unique_id)""")(wmape_rollup)


def metrics_by_quarter(spark, sf_dir):
    """WMAPE, SMAPE and RMSE per model and test quarter."""
    return M.metrics_by_period(predictions(spark, sf_dir), by=("model", S.DS), digits=4)


register("metrics_by_quarter", PRED_SQL + f"""
SELECT model, ds, round(sum(abs(actual - forecast)) / nullif(sum(abs(actual)), 0), 4) AS wmape,
       round(avg(2 * abs(forecast - actual) / (abs(actual) + abs(forecast) + 1e-6)) * 100, 4) AS smape,
       round(sqrt(avg(pow(forecast - actual, 2))), 4) AS rmse
FROM preds GROUP BY model, ds""")(metrics_by_quarter)
