"""Registered queries: selection, blocks, folds, arrays, alignment."""
from __future__ import annotations

from pyspark.sql import functions as F

from qpanel import schema as S
from qpanel.operators import forecast as fc
from qpanel.operators import models as MD
from qpanel.operators import reshape as R
from qpanel.operators import select as SL
from qpanel.operators import trees as TR
from qpanel.plans import panels as P
from qpanel.plans.catalog import register
from qpanel.plans.output import round_doubles
from qpanel.plans.sql import panel_sql, r

FINE = f"WITH panel AS ({panel_sql('nation')})"
COARSE = f"WITH panel AS ({panel_sql('region')})"


def first_series(spark, sf_dir):
    """The first 200 series (by id) of the fine panel."""
    return round_doubles(SL.first_n_series(P.shared(P.fine_panel(spark, sf_dir)), 200)
                         .select(S.UID, S.DS, S.Y), 4)


register("first_series", f"""{FINE}
SELECT unique_id, ds, {r('y')} AS y FROM panel
WHERE unique_id IN (SELECT DISTINCT unique_id FROM panel ORDER BY unique_id LIMIT 200)""")(first_series)


def sample_cells(spark, sf_dir):
    """T5: repeatable ~10 % sample of the fine panel's cells."""
    return round_doubles(SL.hash_sample(P.fine_panel(spark, sf_dir)).select(S.UID, S.DS, S.Y), 4)


register("sample_cells", f"""{FINE}
SELECT unique_id, ds, {r('y')} AS y FROM panel
WHERE substr(md5('sample|' || unique_id || '|' || year(ds) || '-Q' || quarter(ds)), 1, 2) < '1a'""")(sample_cells)


def series_block_ids(spark, sf_dir):
    """K8: blocks of 40 series in id order."""
    return MD.series_blocks(P.fine_panel(spark, sf_dir), 40)


register("series_block_ids", f"""{FINE}
SELECT unique_id, CAST(floor((dense_rank() OVER (ORDER BY unique_id) - 1) / 40) AS INTEGER) AS block
FROM (SELECT DISTINCT unique_id FROM panel)""")(series_block_ids)


def time_series_folds(spark, sf_dir):
    """M2: 5 splits = ntile(6) over the distinct quarters; rows per tile."""
    t = TR.time_series_split(P.shared(P.fine_panel(spark, sf_dir)), 5)
    return t.groupBy("tile").agg(F.count(F.lit(1)).alias("cells"), F.min(S.DS).alias("first_ds"),
                                 F.max(S.DS).alias("last_ds"))


register("time_series_folds", f"""{FINE},
t AS (SELECT ds, CAST(ntile(6) OVER (ORDER BY ds) AS INTEGER) AS tile FROM (SELECT DISTINCT ds FROM panel))
SELECT tile, count(*) AS cells, min(ds) AS first_ds, max(ds) AS last_ds
FROM panel JOIN t USING (ds) GROUP BY tile""")(time_series_folds)


def series_value_arrays(spark, sf_dir):
    """Each series' values as one array ordered by date."""
    a = R.series_arrays(P.coarse_panel(spark, sf_dir))
    return a.select(S.UID, F.size("dates").alias("n"),
                    F.transform("values", lambda v: F.round(v, 4) + F.lit(0.0)).alias("values"))


register("series_value_arrays", f"""{COARSE}
SELECT unique_id, CAST(count(*) AS INTEGER) AS n, list(round(y, 4) + 0.0 ORDER BY ds) AS "values"
FROM panel GROUP BY unique_id""")(series_value_arrays)


def forecast_alignment(spark, sf_dir):
    """Actuals of 2001 outer-aligned with seasonal-naive forecasts made
    at the end of 2000 for 2001-2002."""
    panel = P.shared(P.coarse_panel(spark, sf_dir))
    f = fc.seasonal_naive(panel, "2000-12-31", 8, level=False)
    a = panel.filter(F.year(S.DS) == 2001)
    return round_doubles(SL.align(a, f), 4)


register("forecast_alignment", f"""{COARSE},
f AS (SELECT unique_id, CAST(last_day(ds + to_months(12 * j)) AS DATE) AS ds, y AS forecast
      FROM panel, range(1, 3) t(j) WHERE ds > DATE '1999-12-31' AND ds <= DATE '2000-12-31'),
a AS (SELECT unique_id, ds, y AS actual FROM panel WHERE year(ds) = 2001)
SELECT coalesce(a.unique_id, f.unique_id) AS unique_id, coalesce(a.ds, f.ds) AS ds,
       {r('a.actual')} AS actual, {r('f.forecast')} AS forecast
FROM a FULL OUTER JOIN f ON a.unique_id = f.unique_id AND a.ds = f.ds""")(forecast_alignment)


def history_with_predictions(spark, sf_dir):
    """1995-1999 history plus seasonal-naive predictions for
    2000-2001, one row per (series, quarter)."""
    panel = P.shared(P.coarse_panel(spark, sf_dir))
    train, _ = P.split_train_test(panel)
    f = fc.seasonal_naive(train, P.TRAIN_END, 8, level=False)
    h = SL.history_union(train, f)
    return h.groupBy(F.year(S.DS).alias("year")).agg(F.count(F.lit(1)).alias("rows"),
                                                     F.round(F.sum(S.Y), 2).alias("total"))


register("history_with_predictions", f"""{COARSE},
tr AS (SELECT unique_id, ds, y FROM panel WHERE ds <= DATE '1999-12-31'),
f AS (SELECT unique_id, CAST(last_day(ds + to_months(12 * j)) AS DATE) AS ds, y
      FROM tr, range(1, 3) t(j) WHERE ds > DATE '1998-12-31'),
h AS (SELECT * FROM tr UNION ALL SELECT * FROM f)
SELECT CAST(year(ds) AS INTEGER) AS year, count(*) AS rows, round(sum(y), 2) AS total
FROM h GROUP BY 1""")(history_with_predictions)


def pair_list(spark, sf_dir):
    """U4: distinct (reporter, counterparty) pairs with data."""
    return SL.distinct_pairs(P.fine_panel(spark, sf_dir))


register("pair_list", f"""{FINE} SELECT DISTINCT rep, cp FROM panel""")(pair_list)


def zero_null_rules(spark, sf_dir):
    """P15, P16, P19, P20, P24 on the predictions of the naive model:
    counts after each rule."""
    from qpanel.plans.queries_evaluate import predictions
    p = predictions(spark, sf_dir).filter(F.col("model") == "naive")
    z = SL.zero_as_missing(p.withColumn("d", F.round(F.col("forecast") - F.col("actual"), 0)), ["d"])
    return z.agg(F.count(F.lit(1)).alias("rows"),
                 F.count("d").alias("nonzero_diff"),
                 F.count_if(F.col("actual") > 0).alias("positive_actual"),
                 F.round(F.sum(SL.to_number(F.format_string("%.2f", "actual"))), 2).alias("sum_text_actual"),
                 F.count_if(F.coalesce(F.col("d"), F.lit(0.0)) == 0).alias("filled_zero"))


register("zero_null_rules", f"""WITH p0 AS (
  SELECT * FROM ({__import__('qpanel.plans.queries_evaluate', fromlist=['PRED_SQL']).PRED_SQL}
  SELECT * FROM preds) WHERE model = 'naive'),
z AS (SELECT *, nullif(round(forecast - actual, 0), 0) AS d FROM p0)
SELECT count(*) AS rows, count(d) AS nonzero_diff, count(*) FILTER (WHERE actual > 0) AS positive_actual,
       round(sum(TRY_CAST(printf('%.2f', actual) AS DOUBLE)), 2) AS sum_text_actual,
       count(*) FILTER (WHERE coalesce(d, 0) = 0) AS filled_zero FROM z""")(zero_null_rules)


def test_horizon(spark, sf_dir):
    """Distinct test quarters -> forecast horizon."""
    _, test = P.split_train_test(P.coarse_panel(spark, sf_dir))
    return test.agg(F.countDistinct(S.DS).alias("h"))


register("test_horizon", f"""{COARSE}
SELECT count(DISTINCT ds) AS h FROM panel WHERE ds BETWEEN DATE '2000-01-01' AND DATE '2001-12-31'""")(test_horizon)
