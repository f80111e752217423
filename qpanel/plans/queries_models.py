"""Registered queries: decomposition, per-series AR, linear recursion, block
VAR.  The oracles solve the same normal equations by elimination in SQL and
feed the predictions back in recursive queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from qpanel import schema as S
from qpanel.operators import backtests as BT
from qpanel.operators import forecast as fc
from qpanel.operators import metrics as M
from qpanel.operators import models as MD
from qpanel.plans import panels as P
from qpanel.plans.catalog import register
from qpanel.plans.output import round_doubles
from qpanel.plans.queries_forecast import _FOLDS
from qpanel.plans.sql import metric_cols, normal_equations_sql, panel_sql, qidx, r, solve_sql

H = 8
EARLY = "1998-12-31"
_W = "PARTITION BY unique_id ORDER BY ds"


def _dec(src: str, pre: str) -> str:
    """Additive decomposition of table ``src`` as CTEs named ``pre``*."""
    w, qi = _W, qidx("ds")
    return f"""{pre}d AS (SELECT x.*, (lag(y, 2) OVER ({w}) / 2 + lag(y, 1) OVER ({w}) + y
      + lead(y, 1) OVER ({w}) + lead(y, 2) OVER ({w}) / 2) / 4 AS trend, {qi} % 4 AS s FROM {src} x),
{pre}sm AS (SELECT unique_id, s, avg(y - trend) AS sm FROM {pre}d GROUP BY ALL),
{pre}sm2 AS (SELECT unique_id, s, sm - avg(sm) OVER (PARTITION BY unique_id) AS seasonal FROM {pre}sm),
{pre}dec AS (SELECT a.*, seasonal, y - trend - seasonal AS resid
             FROM {pre}d a LEFT JOIN {pre}sm2 USING (unique_id, s))"""


_EARLY_SQL = f"""WITH panel AS ({panel_sql('region')}),
e0 AS (SELECT * FROM panel WHERE ds <= DATE '{EARLY}'),
e AS (SELECT * FROM e0 WHERE unique_id IN (SELECT unique_id FROM e0 GROUP BY 1 HAVING count(*) >= 8)),
{_dec('e', '')}"""


def decomposition_variability(spark, sf_dir):
    """std(trend) + std(resid) of each series' data up to 1998."""
    # only quarters up to the cutoff matter: bound the ship date at the scan
    v = MD.composite_variability(P.shared(P.coarse_panel(spark, sf_dir, end=EARLY)), EARLY, min_points=8)
    return round_doubles(v, 2)


register("decomposition_variability", f"""{_EARLY_SQL}
SELECT unique_id, {r('stddev_pop(trend) + stddev_pop(resid)', 2)} AS variability
FROM dec GROUP BY unique_id""")(decomposition_variability)


def top_variable_decomposition(spark, sf_dir):
    """F8: full decomposition of the most variable series."""
    d = MD.top_variable_decomposition(P.shared(P.coarse_panel(spark, sf_dir)), EARLY)
    return round_doubles(d.select(S.UID, S.DS, S.Y, "trend", "seasonal", "resid"), 2)


register("top_variable_decomposition", f"""{_EARLY_SQL},
best AS (SELECT unique_id FROM (SELECT unique_id, stddev_pop(trend) + stddev_pop(resid) AS v
         FROM dec GROUP BY 1) ORDER BY v DESC, unique_id LIMIT 1),
f AS (SELECT * FROM panel WHERE unique_id IN (SELECT unique_id FROM best)),
{_dec('f', 'b_')}
SELECT unique_id, ds, {r('y', 2)} AS y, {r('trend', 2)} AS trend, {r('seasonal', 2)} AS seasonal,
       {r('resid', 2)} AS resid FROM b_dec""")(top_variable_decomposition)


def _score(f, test, model):
    j = fc.join_actuals(f.filter(F.col("forecast").isNotNull()), test)
    return M.compute_metrics(j.withColumn("model", F.lit(model)).withColumnRenamed("step", "horizon"),
                             by=("model", "horizon"), digits=4)


_TEST = f"te AS (SELECT unique_id, ds, y AS actual FROM panel WHERE ds BETWEEN DATE '{P.TEST_START}' AND DATE '{P.TEST_END}')"


def _step_ds(step: str) -> str:
    """Quarter end ``step`` quarters after the cutoff, in SQL."""
    return f"CAST(last_day(DATE '{P.TRAIN_END}' + to_months(CAST(3 * ({step}) AS INTEGER))) AS DATE)"


def _score_sql(model: str) -> str:
    """Scores of ``forecasts`` (unique_id, step, ds, forecast) against ``te``."""
    return f"""SELECT '{model}' AS model, CAST(step AS INTEGER) AS horizon, {metric_cols()}
FROM forecasts JOIN te USING (unique_id, ds) WHERE forecast IS NOT NULL GROUP BY step"""


# F5 in SQL: quarters between a series' first and last are interpolated; AR(p)
# on the lag-4 differences for p = 0..3, AICc from the residuals, then the walk.
def _ar_walk_sql(end: int, h: int) -> str:
    """From ``tr0`` (unique_id, qi, y, points) to ``walk``, h quarters beyond ``end``."""
    return f"""tr1 AS (SELECT *, lead(qi) OVER w AS qn, lead(y) OVER w AS yn FROM tr0 WHERE points >= 12 WINDOW w AS (PARTITION BY unique_id ORDER BY qi)),
tr AS (SELECT unique_id, qi + o AS qi, CASE WHEN o = 0 THEN y ELSE y + (yn - y) * o / (qn - qi) END AS y
       FROM (SELECT *, unnest(range(0, coalesce(qn - qi, 1))) AS o FROM tr1)),
df AS (SELECT unique_id, qi, y - lag(y, 4) OVER (PARTITION BY unique_id ORDER BY qi) AS d FROM tr),
ld AS (SELECT unique_id, qi, [lag(d, 1) OVER w, lag(d, 2) OVER w, lag(d, 3) OVER w] AS l, d
       FROM df WHERE d IS NOT NULL WINDOW w AS (PARTITION BY unique_id ORDER BY qi)),
ex0 AS (SELECT unique_id, p, qi, list_concat([1.0::DOUBLE], l[1:p], [d]) AS e FROM ld, range(0, 4) t(p) WHERE p = 0 OR l[p] IS NOT NULL),
ex AS (SELECT unique_id, p, qi, e FROM (SELECT *, count(*) OVER (PARTITION BY unique_id, p) AS n FROM ex0) WHERE n - p - 3 > 0),
ne AS ({normal_equations_sql('ex', 'p + 1', 'unique_id, p')}),
{solve_sql('ne', 'sol', 'unique_id, p')},
co AS (SELECT unique_id, p, [x[p + 2] FOR x IN m] AS b FROM sol WHERE k = len(m)),
rs AS (SELECT unique_id, p, count(*) AS n, sum(pow(e[p + 2] - list_sum([e[i] * b[i] FOR i IN range(1, p + 2)]), 2)) AS rss
       FROM ex JOIN co USING (unique_id, p) GROUP BY unique_id, p),
pick AS (SELECT unique_id, arg_min(p, (n * ln(greatest(rss / n, 1e-300)) + 2 * (p + 2) + 2 * (p + 2) * (p + 3) / (n - p - 3), p)) AS p
         FROM rs GROUP BY unique_id),
seed AS (SELECT unique_id, max(qi) AS last, list(y ORDER BY qi)[-4:] AS ys FROM tr GROUP BY unique_id),
dseed AS (SELECT unique_id, list(d ORDER BY qi DESC)[1:3] AS ds3 FROM ld GROUP BY unique_id),
walk AS (SELECT unique_id, p, b, last AS qi, ys, ds3, NULL::DOUBLE AS f
         FROM pick JOIN co USING (unique_id, p) JOIN seed USING (unique_id) JOIN dseed USING (unique_id)
  UNION ALL SELECT unique_id, p, b, qi + 1, list_append(ys[2:], ys[1] + dn), list_prepend(dn, ds3)[1:3], ys[1] + dn
  FROM (SELECT *, b[1] + coalesce(list_sum([b[i + 1] * ds3[i] FOR i IN range(1, p + 1)]), 0) AS dn FROM walk
        WHERE qi < {end} + {h}))"""


def _ar_sql(level: str) -> str:
    return f"""WITH RECURSIVE panel AS ({panel_sql(level)}),
{_TEST},
tr0 AS (SELECT unique_id, {qidx('ds')} AS qi, y, count(y) OVER (PARTITION BY unique_id) AS points FROM panel
        WHERE ds <= DATE '{P.TRAIN_END}' AND y IS NOT NULL),
{_ar_walk_sql(P.TRAIN_END_INDEX, H)},
forecasts AS (SELECT unique_id, CAST(qi - {P.TRAIN_END_INDEX} AS INTEGER) AS step,
                     {_step_ds(f'qi - {P.TRAIN_END_INDEX}')} AS ds, f AS forecast, CAST(p AS INTEGER) AS order_p
              FROM walk WHERE qi > {P.TRAIN_END_INDEX})
"""


def ar_forecasts(spark, sf_dir):
    """the chosen order and the forecasts of every series of the fine panel
    that is long enough."""
    train, _ = P.split_train_test(P.shared(P.fine_panel(spark, sf_dir)))
    f = MD.forecast_ar_per_series(train, H, cutoff=P.TRAIN_END).filter(F.col("status") == "ok")
    return f.select(S.UID, "step", S.DS, F.round("forecast", 1).alias("forecast"), "order_p")


register("ar_forecasts", f"{_ar_sql('nation')} SELECT unique_id, step, ds, {r('forecast', 1)} AS forecast, order_p FROM forecasts")(ar_forecasts)


def ar_forecast_scores(spark, sf_dir):
    """per-series seasonal AR (AICc order), scored per horizon."""
    train, test = P.split_train_test(P.shared(P.coarse_panel(spark, sf_dir)))
    f = MD.forecast_ar_per_series(train, H, cutoff=P.TRAIN_END)
    return _score(f, test, "arima")


register("ar_forecast_scores", _ar_sql("region") + _score_sql("arima"))(ar_forecast_scores)


def ar_fit_report(spark, sf_dir):
    """fit status of every series of the fine panel (gappy, short)."""
    train, test = P.split_train_test(P.shared(P.fine_panel(spark, sf_dir)))
    f = MD.forecast_ar_per_series(train, H, cutoff=P.TRAIN_END)
    return MD.series_fit_report(f, test).groupBy("status").agg(F.count(F.lit(1)).alias("series"))


# Oracle: with >= 12 points the AR(0) candidate always has degrees of
# freedom left, so a fit can only end as ok / too_short / no_test_data.
register("ar_fit_report", f"""WITH panel AS ({panel_sql('nation')}),
tr AS (SELECT unique_id, count(y) AS n FROM panel WHERE ds <= DATE '{P.TRAIN_END}' GROUP BY 1),
te AS (SELECT DISTINCT unique_id FROM panel WHERE ds BETWEEN DATE '{P.TEST_START}' AND DATE '{P.TEST_END}'),
st AS (SELECT CASE WHEN n < 12 THEN 'too_short' WHEN te.unique_id IS NULL THEN 'no_test_data'
                   ELSE 'ok' END AS status FROM tr LEFT JOIN te USING (unique_id))
SELECT status, count(*) AS series FROM st GROUP BY 1""")(ar_fit_report)


# F13 in SQL: one fit over the scaled windows of all series, then the walk from
# the last four training (or first four test) values.
def _linear_fit_sql(level: str) -> str:
    return f"""WITH RECURSIVE panel AS ({panel_sql(level)}),
{_TEST},
tr0 AS (SELECT unique_id, ds, y, avg(y) OVER u AS mu, stddev_pop(y) OVER u AS sd FROM panel
        WHERE ds <= DATE '{P.TRAIN_END}' WINDOW u AS (PARTITION BY unique_id)),
tr AS (SELECT *, (y - mu) / CASE WHEN sd = 0 THEN 1 ELSE sd END AS z FROM tr0),
win AS (SELECT z, list(z) OVER (PARTITION BY unique_id ORDER BY ds ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS x FROM tr),
ex AS (SELECT list_concat([1.0::DOUBLE], x, [z]) AS e FROM win WHERE len(x) = 4),
ne AS ({normal_equations_sql('ex', '5', '')}),
{solve_sql('ne', 'sol', '')},
co AS (SELECT [x[6] FOR x IN m] AS b FROM sol WHERE k = len(m))"""


def _linear_sql(level: str, test_head: bool = False) -> str:
    start, steps = (P.TRAIN_END_INDEX + 4, H - 4) if test_head else (P.TRAIN_END_INDEX, H)
    seeds = f"""SELECT unique_id, ds, (actual - mu) / CASE WHEN sd = 0 THEN 1 ELSE sd END AS z
        FROM (SELECT *, row_number() OVER (PARTITION BY unique_id ORDER BY ds) AS k FROM te)
        JOIN sc USING (unique_id) WHERE k <= 4""" if test_head else "SELECT unique_id, ds, z FROM tr"
    return f"""{_linear_fit_sql(level)},
sc AS (SELECT DISTINCT unique_id, mu, sd FROM tr),
seed AS (SELECT unique_id, max({qidx('ds')}) AS last, list(z ORDER BY ds)[-4:] AS w FROM ({seeds}) GROUP BY unique_id),
walk AS (SELECT unique_id, b, last AS qi, w, NULL::DOUBLE AS f FROM seed, co WHERE len(w) = 4 AND last <= {start}
  UNION ALL SELECT unique_id, b, qi + 1, list_append(w[2:], z), z
  FROM (SELECT *, b[1] + w[1] * b[2] + w[2] * b[3] + w[3] * b[4] + w[4] * b[5] AS z FROM walk WHERE qi < {start + steps})),
forecasts AS (SELECT unique_id, CAST(qi - {start} AS INTEGER) AS step, {_step_ds(f'qi - {P.TRAIN_END_INDEX}')} AS ds,
                     CASE WHEN sd < 1e-6 THEN mu ELSE f * CASE WHEN sd = 0 THEN 1 ELSE sd END + mu END AS forecast
              FROM walk JOIN sc USING (unique_id) WHERE qi > {start})
"""


def linear_window_fit(spark, sf_dir):
    """intercept and coefficients of the fine panel's window regression."""
    train, _ = P.split_train_test(P.shared(P.fine_panel(spark, sf_dir)))
    _, (b0, b) = MD.recursive_linear_forecast(train, H, n_steps=4, cutoff=P.TRAIN_END)
    return spark.createDataFrame([(i, c) for i, c in enumerate([b0, *b])], "term int, coef double").select("term", F.round("coef", 8).alias("coef"))


register("linear_window_fit", f"""{_linear_fit_sql('nation')}
SELECT CAST(t AS INTEGER) AS term, {r('b[t + 1]', 8)} AS coef FROM co, range(0, 5) x(t)""")(linear_window_fit)


def linear_forecasts(spark, sf_dir):
    """every forecast of the fine panel, seeded by the last training quarters."""
    train, _ = P.split_train_test(P.shared(P.fine_panel(spark, sf_dir)))
    f, _ = MD.recursive_linear_forecast(train, H, n_steps=4, cutoff=P.TRAIN_END)
    return f.filter(F.col("status") == "ok").select(S.UID, F.col("step").cast("int").alias("step"), S.DS, F.round("forecast", 1).alias("forecast"))


register("linear_forecasts", f"{_linear_sql('nation')} SELECT unique_id, step, ds, {r('forecast', 1)} AS forecast FROM forecasts")(linear_forecasts)


def recursive_linear_scores(spark, sf_dir):
    """one linear model on all scaled windows of 4, fed back 8 times."""
    train, test = P.split_train_test(P.shared(P.coarse_panel(spark, sf_dir)))
    f, _ = MD.recursive_linear_forecast(train, H, n_steps=4, cutoff=P.TRAIN_END)
    return _score(f, test, "linear_recursive")


register("recursive_linear_scores", _linear_sql("region") + _score_sql("linear_recursive"))(recursive_linear_scores)


# F14 in SQL, for a panel without gaps (the coarse one): vectors of a block's
# scaled series by quarter, ridge normal equations on four lags, then the walk.
def _var_walk_sql(end: int, h: int) -> str:
    """From ``tr0`` (unique_id, qi, y, mu, sd, block) to ``walk`` and the series' places ``sid``."""
    return f"""tr AS (SELECT *, CASE WHEN sd = 0 THEN 1 ELSE sd END AS s FROM tr0),
vec AS (SELECT block, qi, list((y - mu) / s ORDER BY unique_id) AS v FROM tr GROUP BY block, qi),
lagged AS (SELECT block, qi, v, list_concat(lag(v, 1) OVER w, lag(v, 2) OVER w, lag(v, 3) OVER w, lag(v, 4) OVER w) AS x,
                  row_number() OVER w AS t FROM vec WINDOW w AS (PARTITION BY block ORDER BY qi)),
ex AS (SELECT block, len(x) + 1 AS p, list_concat([1.0::DOUBLE], x, v) AS e FROM lagged WHERE t > 4),
ne AS ({normal_equations_sql('ex', 'p', 'block, p', 1.0)}),
{solve_sql('ne', 'sol', 'block, p')},
seed AS (SELECT block, p, m, qi, list_concat(v, x)[1:p - 1] AS h FROM lagged JOIN sol USING (block)
         WHERE k = len(m) AND qi = {end}),
walk AS (SELECT block, p, m, 0 AS step, h, []::DOUBLE[] AS f FROM seed
  UNION ALL SELECT block, p, m, step + 1, list_concat(n, h)[1:p - 1], n
  FROM (SELECT *, [m[1][p + c] + list_sum([h[i] * m[i + 1][p + c] FOR i IN range(1, p)])
                   FOR c IN range(1, len(m[1]) - p + 1)] AS n FROM walk WHERE step < {h})),
sid AS (SELECT unique_id, block, any_value(mu) AS mu, any_value(s) AS s, row_number() OVER (PARTITION BY block ORDER BY unique_id) AS c
        FROM tr GROUP BY unique_id, block)"""


_VAR_SQL = f"""WITH RECURSIVE panel AS ({panel_sql('region')}),
{_TEST},
tr0 AS (SELECT unique_id, {qidx('ds')} AS qi, y, avg(y) OVER u AS mu, stddev_pop(y) OVER u AS sd,
               (dense_rank() OVER (ORDER BY unique_id) - 1) // 8 AS block FROM panel
        WHERE ds <= DATE '{P.TRAIN_END}' WINDOW u AS (PARTITION BY unique_id)),
{_var_walk_sql(P.TRAIN_END_INDEX, H)},
forecasts AS (SELECT unique_id, CAST(step AS INTEGER) AS step, {_step_ds('step')} AS ds, f[c] * s + mu AS forecast
              FROM walk JOIN sid USING (block) WHERE step > 0)
"""


def block_var_forecasts(spark, sf_dir):
    """F14 + K8: every forecast of the ridge VARs of 8 series."""
    train, _ = P.split_train_test(P.shared(P.coarse_panel(spark, sf_dir)))
    f = MD.forecast_blocks(train, H, block_size=8, cutoff=P.TRAIN_END)
    return f.select(S.UID, "step", S.DS, F.round("forecast", 1).alias("forecast"))


register("block_var_forecasts", f"{_VAR_SQL} SELECT unique_id, step, ds, {r('forecast', 1)} AS forecast FROM forecasts")(block_var_forecasts)


def block_var_scores(spark, sf_dir):
    """F14 + K8: ridge VAR per block of 8 series, scored per horizon."""
    train, test = P.split_train_test(P.shared(P.coarse_panel(spark, sf_dir)))
    f = MD.forecast_blocks(train, H, block_size=8, cutoff=P.TRAIN_END)
    return _score(f, test, "block_var_8")


register("block_var_scores", _VAR_SQL + _score_sql("block_var_8"))(block_var_scores)


def recursive_linear_test_head_scores(spark, sf_dir):
    """F13 with the test-head warm start (Q12): the first 4 test quarters
    seed the recursion, the next 4 are forecast and scored."""
    train, test = P.split_train_test(P.shared(P.coarse_panel(spark, sf_dir)))
    f, _ = MD.recursive_linear_forecast(train, H, n_steps=4, warm_start="test_head", test=test, cutoff=P.TRAIN_END)
    return _score(f, test, "linear_recursive_test_head")


register("recursive_linear_test_head_scores",
         _linear_sql("region", True) + _score_sql("linear_recursive_test_head"))(recursive_linear_test_head_scores)


# ---------------------------------------------------------------------------
# Which forecasts there are: every series of the gappy fine panel, every step
# counted from the cutoff, and a status for those without (or with a filled
# start).  The values are the models' own; rows, dates and statuses are not.

def _grid(f):
    return f.select(S.UID, F.col("step").cast("int").alias("step"), S.DS, "status",
                    F.col("forecast").isNotNull().alias("has_forecast"))


def _grid_sql(status: str, steps: int = H, shift: int = 0) -> str:
    return f"""WITH panel AS ({panel_sql('nation')}),
tr AS (SELECT unique_id, count(y) AS n, max(ds) AS last FROM panel WHERE ds <= DATE '{P.TRAIN_END}' GROUP BY 1),
te0 AS (SELECT unique_id, ds, row_number() OVER (PARTITION BY unique_id ORDER BY ds) AS k FROM panel
        WHERE ds BETWEEN DATE '{P.TEST_START}' AND DATE '{P.TEST_END}'),
te AS (SELECT unique_id, count(*) AS seeds, max(ds) AS seed_end FROM te0 WHERE k <= 4 GROUP BY 1),
st AS (SELECT tr.unique_id, {status} AS status FROM tr LEFT JOIN te USING (unique_id))
SELECT unique_id, CAST(step AS INTEGER) AS step,
       CAST(last_day(DATE '{P.TRAIN_END}' + to_months(CAST(3 * (step + {shift}) AS INTEGER))) AS DATE) AS ds, status,
       status IN ('ok', 'filled_to_cutoff') AS has_forecast
FROM st, range(1, {steps + 1}) AS t(step)"""


def ar_forecast_grid(spark, sf_dir):
    """every series x step x date from the cutoff, with its status."""
    train, _ = P.split_train_test(P.shared(P.fine_panel(spark, sf_dir)))
    return _grid(MD.forecast_ar_per_series(train, H, cutoff=P.TRAIN_END))


register("ar_forecast_grid", _grid_sql("CASE WHEN n < 12 THEN 'too_short' ELSE 'ok' END"))(ar_forecast_grid)


def linear_forecast_grid(spark, sf_dir):
    """every series x step x date from the cutoff, with its status."""
    train, _ = P.split_train_test(P.shared(P.fine_panel(spark, sf_dir)))
    return _grid(MD.recursive_linear_forecast(train, H, n_steps=4, cutoff=P.TRAIN_END)[0])


register("linear_forecast_grid", _grid_sql("CASE WHEN n < 4 THEN 'too_short' ELSE 'ok' END"))(linear_forecast_grid)


def linear_test_head_grid(spark, sf_dir):
    """F13 warm-started from the test head: series x step x date x status."""
    train, test = P.split_train_test(P.shared(P.fine_panel(spark, sf_dir)))
    return _grid(MD.recursive_linear_forecast(train, H, n_steps=4, warm_start="test_head", test=test, cutoff=P.TRAIN_END)[0])


register("linear_test_head_grid", _grid_sql(
    "CASE WHEN coalesce(seeds, 0) < 4 THEN 'too_short' WHEN seed_end > DATE '2000-12-31' THEN 'late_seed' ELSE 'ok' END",
    H - 4, 4))(linear_test_head_grid)


def block_var_grid(spark, sf_dir):
    """F14 + K8: every series x step x date from the cutoff, with its status."""
    train, _ = P.split_train_test(P.shared(P.fine_panel(spark, sf_dir)))
    return _grid(MD.forecast_blocks(train, H, block_size=8, cutoff=P.TRAIN_END))


register("block_var_grid", _grid_sql(
    f"CASE WHEN last = DATE '{P.TRAIN_END}' THEN 'ok' ELSE 'filled_to_cutoff' END"))(block_var_grid)


# ---------------------------------------------------------------------------
# F4 of the fitted models: three training years, one validation year, every fold.
# In the oracles each fold is fitted anew on its own rows; quarters are numbered
# from the fold's cutoff.

BACKTEST_H = 4


def _backtest(b):
    return b.select("fold", S.UID, S.DS, "step", F.round("forecast", 1).alias("forecast"), F.round("actual", 2).alias("actual"), "status")


def _backtest_sql(status: str) -> str:
    """Cells of the folds' validation quarters with ``forecasts`` (fold, unique_id, step, f)."""
    return f"""seen AS (SELECT fold, unique_id, count(y) AS n, max(step) AS last FROM rows WHERE role = 'train' GROUP BY fold, unique_id)
SELECT v.fold, v.unique_id, v.ds, CAST(v.step AS INTEGER) AS step, {r('f', 1)} AS forecast, {r('v.y', 2)} AS actual, {status} AS status
FROM valid v JOIN seen USING (fold, unique_id) LEFT JOIN forecasts x ON x.fold = v.fold AND x.unique_id = v.unique_id AND x.step = v.step"""


def backtest_linear_forecasts(spark, sf_dir):
    """F4 of F13: every fold's forecasts of the gappy fine panel, all folds from
    one pass of prefix sums."""
    return _backtest(BT.backtest_linear(P.shared(P.fine_panel(spark, sf_dir))))


register("backtest_linear_forecasts", f"""WITH RECURSIVE panel AS ({panel_sql('nation')}), {_FOLDS},
tr0 AS (SELECT fold, unique_id, step, y, avg(y) OVER u AS mu, stddev_pop(y) OVER u AS sd FROM rows
        WHERE role = 'train' WINDOW u AS (PARTITION BY fold, unique_id)),
tr AS (SELECT *, (y - mu) / CASE WHEN sd = 0 THEN 1 ELSE sd END AS z FROM tr0),
win AS (SELECT fold, z, list(z) OVER (PARTITION BY fold, unique_id ORDER BY step ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS x FROM tr),
ex AS (SELECT fold, list_concat([1.0::DOUBLE], x, [z]) AS e FROM win WHERE len(x) = 4),
ne AS ({normal_equations_sql('ex', '5', 'fold')}),
{solve_sql('ne', 'sol', 'fold')},
co AS (SELECT fold, [x[6] FOR x IN m] AS b FROM sol WHERE k = len(m)),
seed AS (SELECT fold, unique_id, any_value(mu) AS mu, any_value(sd) AS sd, max(step) AS last, list(z ORDER BY step)[-4:] AS w
         FROM tr GROUP BY fold, unique_id),
walk AS (SELECT fold, unique_id, b, mu, sd, last AS step, w, NULL::DOUBLE AS z FROM seed JOIN co USING (fold) WHERE len(w) = 4
  UNION ALL SELECT fold, unique_id, b, mu, sd, step + 1, list_append(w[2:], p), p
  FROM (SELECT *, b[1] + w[1] * b[2] + w[2] * b[3] + w[3] * b[4] + w[4] * b[5] AS p FROM walk WHERE step < {BACKTEST_H})),
forecasts AS (SELECT fold, unique_id, step, CASE WHEN sd < 1e-6 THEN mu ELSE z * CASE WHEN sd = 0 THEN 1 ELSE sd END + mu END AS f
              FROM walk WHERE step > 0),
{_backtest_sql("CASE WHEN n < 4 THEN 'too_short' ELSE 'ok' END")}""")(backtest_linear_forecasts)


def backtest_ar_forecasts(spark, sf_dir):
    """F4 of F5: every fold's forecasts of the gappy fine panel."""
    return _backtest(BT.backtest_ar(P.shared(P.fine_panel(spark, sf_dir))))


register("backtest_ar_forecasts", f"""WITH RECURSIVE panel AS ({panel_sql('nation')}), {_FOLDS},
tr0 AS (SELECT unique_id || '#' || fold AS unique_id, step AS qi, y, count(y) OVER (PARTITION BY fold, unique_id) AS points FROM rows
        WHERE role = 'train' AND y IS NOT NULL),
{_ar_walk_sql(0, BACKTEST_H)},
forecasts AS (SELECT CAST(split_part(unique_id, '#', 2) AS INTEGER) AS fold, split_part(unique_id, '#', 1) AS unique_id, qi AS step, f
              FROM walk WHERE qi > 0),
{_backtest_sql("CASE WHEN n < 12 THEN 'too_short' ELSE 'ok' END")}""")(backtest_ar_forecasts)


def backtest_block_var_forecasts(spark, sf_dir):
    """F4 of F14 + K8: every fold's forecasts of the coarse panel in blocks of 8."""
    return _backtest(BT.backtest_blocks(P.shared(P.coarse_panel(spark, sf_dir))))


register("backtest_block_var_forecasts", f"""WITH RECURSIVE panel AS ({panel_sql('region')}), {_FOLDS},
bk AS (SELECT unique_id, (dense_rank() OVER (ORDER BY unique_id) - 1) // 8 AS block0 FROM (SELECT DISTINCT unique_id FROM panel)),
tr0 AS (SELECT unique_id, step AS qi, y, avg(y) OVER u AS mu, stddev_pop(y) OVER u AS sd, block0 * 1000 + fold AS block
        FROM rows JOIN bk USING (unique_id) WHERE role = 'train' WINDOW u AS (PARTITION BY fold, unique_id)),
{_var_walk_sql(0, BACKTEST_H)},
forecasts AS (SELECT CAST(block % 1000 AS INTEGER) AS fold, unique_id, step, f[c] * s + mu AS f FROM walk JOIN sid USING (block) WHERE step > 0),
{_backtest_sql("CASE WHEN last = 0 THEN 'ok' ELSE 'filled_to_cutoff' END")}""")(backtest_block_var_forecasts)
