"""Registered queries: statistical forecasts, back-tests and their scores."""
from __future__ import annotations

from pyspark.sql import functions as F

from qpanel import schema as S
from qpanel.operators import forecast as fc
from qpanel.operators import metrics as M
from qpanel.plans import panels as P
from qpanel.plans.catalog import register
from qpanel.plans.output import round_doubles
from qpanel.plans.sql import metric_cols, panel_sql, qidx, r, with_panels

H_TEST = 8  # 2000-Q1 .. 2001-Q4


def seasonal_naive_scores(spark, sf_dir):
    """Flagship: coarse panel -> split -> seasonal naive (m=4) -> actuals ->
    RMSE / Log-RMSE / SMAPE / WMAPE per horizon."""
    panel = P.coarse_panel(spark, sf_dir)
    scored = (fc.score_in_place(panel, "seasonal_naive", P.TRAIN_END, H_TEST)
              .withColumn("model", F.lit("seasonal_naive"))
              .withColumnRenamed("step", "horizon"))
    return M.compute_metrics(scored, by=("model", "horizon"), digits=4)


register("seasonal_naive_scores", with_panels(f"""
, fc AS (
  SELECT unique_id, CAST(last_day(ds + to_months(12 * j)) AS DATE) AS ds, y AS forecast
  FROM train, range(1, 3) r(j)
  WHERE ds > DATE '1998-12-31'
), scored AS (
  SELECT f.*, t.y AS actual, {qidx('f.ds')} - {qidx("DATE '1999-12-31'")} AS horizon
  FROM fc f JOIN test t USING (unique_id, ds)
)
SELECT 'seasonal_naive' AS model, horizon, {metric_cols()}
FROM scored WHERE horizon BETWEEN 1 AND {H_TEST} GROUP BY horizon"""))(seasonal_naive_scores)


_P = f"""p AS (SELECT *, {qidx('ds')} AS qi, {qidx('ds')} - {qidx("DATE '1999-12-31'")} AS step FROM panel)"""


def _scores(spark, sf_dir, model):
    panel = P.coarse_panel(spark, sf_dir)
    s = (fc.score_in_place(panel, model, P.TRAIN_END, H_TEST)
         .withColumn("model", F.lit(model)).withColumnRenamed("step", "horizon"))
    return M.compute_metrics(s, by=("model", "horizon"), digits=4)


def naive_scores(spark, sf_dir):
    """F1 scored per horizon on the 2000-2001 actuals."""
    return _scores(spark, sf_dir, "naive")


register("naive_scores", with_panels(f""", {_P},
last AS (SELECT unique_id, arg_max(y, ds) AS forecast FROM p WHERE step <= 0 GROUP BY 1),
scored AS (SELECT p.y AS actual, l.forecast, p.step AS horizon FROM p JOIN last l USING (unique_id)
           WHERE p.step BETWEEN 1 AND {H_TEST} AND p.y IS NOT NULL)
SELECT 'naive' AS model, horizon, {metric_cols()} FROM scored GROUP BY horizon"""))(naive_scores)


def seasonal_window_average_scores(spark, sf_dir):
    """F3 (m=4, window=3) scored per horizon."""
    return _scores(spark, sf_dir, "seasonal_window_average")


_SWA = """swa AS (
  SELECT {sel}t.unique_id, t.ds, t.step, t.y AS actual, avg(b.y) AS forecast
  FROM {rows} t JOIN {rows} b ON b.unique_id = t.unique_id {same} AND {train}
   AND b.qi IN (t.qi - 4 * CAST(ceil(t.step / 4.0) AS INTEGER),
                t.qi - 4 * CAST(ceil(t.step / 4.0) AS INTEGER) - 4,
                t.qi - 4 * CAST(ceil(t.step / 4.0) AS INTEGER) - 8)
  WHERE t.step BETWEEN 1 AND {h} AND t.y IS NOT NULL {tfilter}
  GROUP BY ALL)"""

register("seasonal_window_average_scores", with_panels(f""", {_P},
n AS (SELECT unique_id, count(y) FILTER (WHERE step <= 0) AS n_train FROM p GROUP BY 1),
{_SWA.format(sel='', rows='p', same='', train='b.step <= 0', h=H_TEST, tfilter='')},
scored AS (SELECT s.*, s.step AS horizon FROM swa s JOIN n USING (unique_id) WHERE n_train >= 12)
SELECT 'seasonal_window_average' AS model, horizon, {metric_cols()} FROM scored GROUP BY horizon"""
                                                   ))(seasonal_window_average_scores)

# ---------------------------------------------------------------------------
# Rolling back-tests of the three statistical models.

MODELS = ["naive", "seasonal_naive", "seasonal_window_average"]


def backtest_scores(spark, sf_dir):
    """3-year train / 1-year validation folds over the whole panel;
    WMAPE (absolute denominator) per model and fold, and per model."""
    panel = P.shared(P.coarse_panel(spark, sf_dir))
    out = None
    for m in MODELS:
        b = fc.backtest(panel, m, train_years=3, test_years=1).withColumn("model", F.lit(m))
        out = b if out is None else out.unionByName(b)
    return (out.groupingSets([["model", "fold"], ["model"]], "model", "fold")
            .agg(F.count(F.lit(1)).alias("n"),
                 F.round(M.wmape(variant="abs"), 4).alias("wmape")))


_FOLDS = f"""b AS (SELECT min(ds) AS d0, max(ds) AS d1 FROM panel),
folds AS (SELECT CAST(f AS INTEGER) AS fold, CAST(d0 + to_months(12 * f) AS DATE) AS start
          FROM b, range(0, 100) r(f) WHERE d0 + to_months(12 * f + 48) <= d1),
cal AS (SELECT fold, CAST(last_day(start + to_months(3 * i)) AS DATE) AS ds,
               CASE WHEN i < 12 THEN 'train' ELSE 'valid' END AS role,
               CAST(last_day(start + to_months(33)) AS DATE) AS cutoff
        FROM folds, range(0, 16) t(i)),
rows AS (SELECT c.fold, c.role, p.unique_id, p.ds, p.y, {qidx('p.ds')} AS qi,
                {qidx('p.ds')} - {qidx('c.cutoff')} AS step
         FROM panel p JOIN cal c USING (ds)),
valid AS (SELECT * FROM rows WHERE role = 'valid' AND step BETWEEN 1 AND 4 AND y IS NOT NULL),
nv AS (SELECT 'naive' AS model, v.fold, v.unique_id, v.ds, v.step, v.y AS actual, l.forecast
       FROM valid v JOIN (SELECT fold, unique_id, arg_max(y, ds) AS forecast FROM rows
                          WHERE role = 'train' AND y IS NOT NULL GROUP BY ALL) l USING (fold, unique_id)),
sn AS (SELECT 'seasonal_naive' AS model, v.fold, v.unique_id, v.ds, v.step, v.y AS actual, t.y AS forecast
       FROM valid v JOIN rows t ON t.fold = v.fold AND t.unique_id = v.unique_id AND t.role = 'train'
        AND t.qi = v.qi - 4 AND t.y IS NOT NULL),
nt AS (SELECT fold, unique_id, count(y) AS n_train FROM rows WHERE role = 'train' GROUP BY ALL),
{_SWA.format(sel='t.fold, ', rows='rows', same='AND b.fold = t.fold', train="b.role = 'train'", h=4,
             tfilter="AND t.role = 'valid'")},
sw AS (SELECT 'seasonal_window_average' AS model, s.fold, s.unique_id, s.ds, s.step, s.actual, s.forecast
       FROM swa s JOIN nt USING (fold, unique_id) WHERE n_train >= 12 AND s.forecast IS NOT NULL),
bt AS (SELECT * FROM nv UNION ALL SELECT * FROM sn UNION ALL SELECT * FROM sw)"""

register("backtest_scores", f"""WITH panel AS ({panel_sql('region')}), {_FOLDS}
SELECT model, fold, count(*) AS n,
       round(sum(abs(actual - forecast)) / nullif(sum(abs(actual)), 0), 4) AS wmape
FROM bt GROUP BY GROUPING SETS ((model, fold), (model))""")(backtest_scores)


def backtest_wmape_by_date(spark, sf_dir):
    """Seasonal-naive back-test WMAPE per validation quarter."""
    b = fc.backtest(P.shared(P.coarse_panel(spark, sf_dir)), "seasonal_naive")
    return M.metrics_by_period(b, by=("fold", S.DS), digits=4)


register("backtest_wmape_by_date", f"""WITH panel AS ({panel_sql('region')}), {_FOLDS}
SELECT fold, ds, round(sum(abs(actual - forecast)) / nullif(sum(abs(actual)), 0), 4) AS wmape,
       round(avg(2 * abs(forecast - actual) / (abs(actual) + abs(forecast) + 1e-6)) * 100, 4) AS smape,
       round(sqrt(avg(pow(forecast - actual, 2))), 4) AS rmse
FROM sn GROUP BY fold, ds""")(backtest_wmape_by_date)

# ---------------------------------------------------------------------------
# Forecasts beyond the data with 90 % intervals (F1, F2).

FUTURE_CUTOFF = "2001-12-31"


def future_seasonal_naive(spark, sf_dir):
    """F2 with intervals: 8 quarters after the last quarter of the data."""
    f = fc.seasonal_naive(P.coarse_panel(spark, sf_dir), FUTURE_CUTOFF, 8, m=4, level=True)
    return round_doubles(f, 4)


_SIG = """sig AS (SELECT unique_id, sqrt(avg(pow(y - ly, 2))) AS sigma FROM (
  SELECT unique_id, y, first(y) OVER (PARTITION BY unique_id ORDER BY qi
         RANGE BETWEEN {lag} PRECEDING AND {lag} PRECEDING) AS ly FROM p) GROUP BY 1)"""
_PF = f"""p AS (SELECT *, {qidx('ds')} AS qi FROM panel WHERE ds <= DATE '{FUTURE_CUTOFF}')"""

register("future_seasonal_naive", f"""WITH panel AS ({panel_sql('region')}), {_PF},
{_SIG.format(lag=4)},
f AS (SELECT unique_id, CAST(last_day(ds + to_months(12 * j)) AS DATE) AS ds, y AS forecast
      FROM p, range(1, 3) r(j) WHERE ds > DATE '2000-12-31'),
g AS (SELECT f.*, {qidx('f.ds')} - {qidx(f"DATE '{FUTURE_CUTOFF}'")} AS step, s.sigma
      FROM f JOIN sig s USING (unique_id))
SELECT unique_id, ds, step, {r('forecast')} AS forecast,
       {r(f'forecast - {fc.Z90} * sigma * sqrt(floor((step - 1) / 4) + 1)')} AS lo_90,
       {r(f'forecast + {fc.Z90} * sigma * sqrt(floor((step - 1) / 4) + 1)')} AS hi_90
FROM g WHERE step BETWEEN 1 AND 8""")(future_seasonal_naive)


def future_naive(spark, sf_dir):
    """F1 with intervals: last value for 8 quarters after the data."""
    f = fc.naive(P.coarse_panel(spark, sf_dir), FUTURE_CUTOFF, 8, level=True)
    return round_doubles(f, 4)


register("future_naive", f"""WITH panel AS ({panel_sql('region')}), {_PF},
{_SIG.format(lag=1)},
l AS (SELECT unique_id, arg_max(y, ds) AS forecast FROM p GROUP BY 1)
SELECT unique_id, CAST(last_day(DATE '{FUTURE_CUTOFF}' + to_months(3 * s)) AS DATE) AS ds,
       CAST(s AS INTEGER) AS step, {r('forecast')} AS forecast,
       {r(f'forecast - {fc.Z90} * sigma * sqrt(s)')} AS lo_90,
       {r(f'forecast + {fc.Z90} * sigma * sqrt(s)')} AS hi_90
FROM l JOIN sig USING (unique_id), range(1, 9) t(s)""")(future_naive)


def future_swa_intervals(spark, sf_dir):
    """F3 with split-conformal 90 % intervals: seasonal window average for
    the 8 quarters after the data, widths from two back-test windows."""
    panel = P.shared(P.coarse_panel(spark, sf_dir))
    f = fc.seasonal_window_average(panel, FUTURE_CUTOFF, 8)
    w = fc.conformal_intervals(panel, "seasonal_window_average", FUTURE_CUTOFF, 8)
    return round_doubles(fc.with_intervals(f, w), 4)


_SWA_WIN = """sw{k} AS (
  SELECT t.unique_id, t.step, abs(t.y - avg(b.y)) AS err
  FROM (SELECT *, qi - {qc} AS step FROM p) t
  JOIN p b ON b.unique_id = t.unique_id AND b.qi <= {qc} AND b.y IS NOT NULL
   AND b.qi IN (t.qi - 4 * CAST(ceil(t.step / 4.0) AS INTEGER),
                t.qi - 4 * CAST(ceil(t.step / 4.0) AS INTEGER) - 4,
                t.qi - 4 * CAST(ceil(t.step / 4.0) AS INTEGER) - 8)
  WHERE t.step BETWEEN 1 AND 8 AND t.y IS NOT NULL
    AND t.unique_id IN (SELECT unique_id FROM p WHERE qi <= {qc} GROUP BY 1 HAVING count(y) >= 12)
  GROUP BY t.unique_id, t.step, t.y)"""

register("future_swa_intervals", f"""WITH panel AS ({panel_sql('region')}), {_PF},
n AS (SELECT unique_id FROM p GROUP BY 1 HAVING count(y) >= 12),
s AS (SELECT unique_id, qi % 4 AS season, avg(y) AS f FROM p
      WHERE ds > DATE '1998-12-31' AND unique_id IN (SELECT unique_id FROM n) GROUP BY ALL),
f AS (SELECT unique_id, CAST(s AS INTEGER) AS step,
             CAST(last_day(DATE '{FUTURE_CUTOFF}' + to_months(3 * s)) AS DATE) AS ds
      FROM n, range(1, 9) t(s)),
{_SWA_WIN.format(k=1, qc=qidx("DATE '1999-12-31'"))},
{_SWA_WIN.format(k=2, qc=qidx("DATE '1997-12-31'"))},
w AS (SELECT unique_id, step, quantile_cont(err, 0.9) AS hw
      FROM (SELECT * FROM sw1 UNION ALL SELECT * FROM sw2) GROUP BY ALL)
SELECT f.unique_id, f.step, f.ds, {r('s.f')} AS forecast, {r('s.f - w.hw')} AS lo_90, {r('s.f + w.hw')} AS hi_90
FROM f JOIN s ON s.unique_id = f.unique_id AND s.season = {qidx('f.ds')} % 4
LEFT JOIN w ON w.unique_id = f.unique_id AND w.step = f.step""")(future_swa_intervals)


def naive_test_predictions(spark, sf_dir):
    """F1 + J6 + J2: naive forecasts with 90 % intervals for the test
    quarters, joined to the actual values (rows without an actual dropped)."""
    panel = P.shared(P.coarse_panel(spark, sf_dir))
    train, test = P.split_train_test(panel)
    f = fc.naive(train, P.TRAIN_END, H_TEST, level=True)
    return round_doubles(fc.join_actuals(f, test), 4)


register("naive_test_predictions", f"""WITH panel AS ({panel_sql('region')}),
p AS (SELECT *, {qidx('ds')} AS qi FROM panel WHERE ds <= DATE '{P.TRAIN_END}'),
{_SIG.format(lag=1)},
l AS (SELECT unique_id, arg_max(y, ds) AS forecast FROM p GROUP BY 1),
f AS (SELECT unique_id, CAST(last_day(DATE '{P.TRAIN_END}' + to_months(3 * s)) AS DATE) AS ds,
             CAST(s AS INTEGER) AS step, forecast, sigma
      FROM l JOIN sig USING (unique_id), range(1, {H_TEST + 1}) t(s))
SELECT f.unique_id, f.ds, f.step, {r('f.forecast')} AS forecast,
       {r(f'f.forecast - {fc.Z90} * sigma * sqrt(step)')} AS lo_90,
       {r(f'f.forecast + {fc.Z90} * sigma * sqrt(step)')} AS hi_90, {r('t.y')} AS actual
FROM f JOIN panel t ON t.unique_id = f.unique_id AND t.ds = f.ds
WHERE t.ds BETWEEN DATE '{P.TEST_START}' AND DATE '{P.TEST_END}'""")(naive_test_predictions)


def seasonal_naive_test_predictions(spark, sf_dir):
    """F2 + J2: seasonal-naive forecasts with 90 % intervals for the test
    quarters, joined to the actual values."""
    panel = P.shared(P.coarse_panel(spark, sf_dir))
    train, test = P.split_train_test(panel)
    f = fc.seasonal_naive(train, P.TRAIN_END, H_TEST, m=4, level=True)
    return round_doubles(fc.join_actuals(f, test), 4)


register("seasonal_naive_test_predictions", f"""WITH panel AS ({panel_sql('region')}),
p AS (SELECT *, {qidx('ds')} AS qi FROM panel WHERE ds <= DATE '{P.TRAIN_END}'),
{_SIG.format(lag=4)},
f AS (SELECT unique_id, CAST(last_day(ds + to_months(12 * j)) AS DATE) AS ds, y AS forecast
      FROM p, range(1, 3) r(j) WHERE ds > DATE '1998-12-31'),
g AS (SELECT f.*, {qidx('f.ds')} - {qidx(f"DATE '{P.TRAIN_END}'")} AS step, s.sigma
      FROM f JOIN sig s USING (unique_id))
SELECT g.unique_id, g.ds, g.step, {r('g.forecast')} AS forecast,
       {r(f'g.forecast - {fc.Z90} * sigma * sqrt(floor((step - 1) / 4) + 1)')} AS lo_90,
       {r(f'g.forecast + {fc.Z90} * sigma * sqrt(floor((step - 1) / 4) + 1)')} AS hi_90,
       {r('t.y')} AS actual
FROM g JOIN panel t ON t.unique_id = g.unique_id AND t.ds = g.ds
WHERE g.step BETWEEN 1 AND {H_TEST} AND t.ds BETWEEN DATE '{P.TEST_START}' AND DATE '{P.TEST_END}'""")(
    seasonal_naive_test_predictions)
