"""Registered queries: global boosted trees, recursion and tuning
(randomised learners, so rows-only checks)."""
from __future__ import annotations

from pyspark.sql import functions as F

from qpanel import schema as S
from qpanel.operators import boosting as BO
from qpanel.operators import features as FE
from qpanel.operators import forecast as fc
from qpanel.operators import metrics as M
from qpanel.operators import trees as TR
from qpanel.plans import panels as P
from qpanel.plans.catalog import register
from qpanel.plans.queries_models import _grid_sql
from qpanel.plans.sql import panel_sql

PARAMS = {"maxIter": 30, "maxDepth": 4, "stepSize": 0.1}


def _frame(spark, sf_dir):
    prep = FE.prepare_log(P.shared(P.coarse_panel(spark, sf_dir)))
    return TR.model_frame(prep)


def gbt_test_scores(spark, sf_dir):
    """F10 + F11 + E12: fit on 1995-1999 with 1999 as early-stopping
    validation, predict 2000-2001 levels, score per quarter."""
    fr = _frame(spark, sf_dir)
    fit = fr.filter(F.year(S.DS) <= 1999).withColumn("is_valid", F.year(S.DS) == 1999)
    model = TR.fit_gbt(fit, PARAMS, valid_flag="is_valid")
    test = fr.filter(F.year(S.DS).between(2000, 2001))
    pred = TR.predict_levels(model, test).withColumn("actual", F.expm1("y_log"))
    return M.metrics_by_period(pred, by=(S.DS,), digits=4)


register("gbt_test_scores")(gbt_test_scores)


def gbt_recursive_scores(spark, sf_dir):
    """recursive 8-quarter forecast from the 1995-1999 history."""
    prep = FE.prepare_log(P.shared(P.coarse_panel(spark, sf_dir)))
    fr = TR.model_frame(prep)
    fit = fr.filter(F.year(S.DS) <= 1999).withColumn("is_valid", F.year(S.DS) == 1999)
    model = TR.fit_gbt(fit, PARAMS, valid_flag="is_valid")
    hist = prep.filter(F.year(S.DS) <= 1999)
    f = TR.recursive_forecast(model, hist, 8, cutoff=P.TRAIN_END)
    test = prep.filter(F.year(S.DS).between(2000, 2001)).select(S.UID, S.DS, F.col("exposure").alias(S.Y))
    j = fc.join_actuals(f, test).withColumn("model", F.lit("gbt_recursive")) \
        .withColumnRenamed("step", "horizon")
    return M.compute_metrics(j, by=("model", "horizon"), digits=4)


register("gbt_recursive_scores")(gbt_recursive_scores)


def fold_sizes(spark, sf_dir):
    """M1: every validation year the data allows, with its earlier training
    rows and its own."""
    fr = P.shared(P.fine_panel(spark, sf_dir).withColumn("y_log", F.log1p(S.Y)))
    first, last = fr.agg(F.min(F.year(S.DS)), F.max(F.year(S.DS))).first()
    out = None
    for year, train, valid in TR.expanding_folds(fr, range(first + 1, last + 1)):
        both = train.select(S.DS, F.lit(True).alias("t")).unionByName(valid.select(S.DS, F.lit(False).alias("t")))
        one = both.agg(F.count_if("t").alias("train_rows"), F.max(F.when(F.col("t"), F.col(S.DS))).alias("train_end"),
                       F.count_if(~F.col("t")).alias("valid_rows"), F.min(F.when(~F.col("t"), F.col(S.DS))).alias("valid_start"))
        one = one.withColumn("year", F.lit(year))
        out = one if out is None else out.unionByName(one)
    return out


register("fold_sizes", f"""WITH panel AS ({panel_sql('nation')}),
years AS (SELECT CAST(y AS INTEGER) AS year FROM (SELECT min(year(ds)) AS a, max(year(ds)) AS b FROM panel), range(1900, 2200) t(y) WHERE y > a AND y <= b)
SELECT year, count(*) FILTER (WHERE year(ds) < year) AS train_rows, max(ds) FILTER (WHERE year(ds) < year) AS train_end,
       count(*) FILTER (WHERE year(ds) = year) AS valid_rows, min(ds) FILTER (WHERE year(ds) = year) AS valid_start
FROM years, panel GROUP BY year""")(fold_sizes)


def gbt_forecast_grid(spark, sf_dir):
    """every series of the gappy fine panel x step x date from the
    cutoff, with its status (a series that ends earlier is filled up to it)."""
    prep = FE.prepare_log(P.shared(P.fine_panel(spark, sf_dir)))
    hist = prep.filter(F.year(S.DS) <= 1999)
    model = TR.fit_gbt(TR.model_frame(hist), PARAMS | {"maxIter": 2})
    f = TR.recursive_forecast(model, hist, 8, cutoff=P.TRAIN_END)
    return f.select(S.UID, "step", S.DS, "status", F.col("forecast").isNotNull().alias("has_forecast"))


register("gbt_forecast_grid", _grid_sql(
    f"CASE WHEN last = DATE '{P.TRAIN_END}' THEN 'ok' ELSE 'filled_to_cutoff' END"))(gbt_forecast_grid)


TUNING_ROUNDS, TUNING_PATIENCE = 20, 10


def gbt_tuning(spark, sf_dir):
    """M1 + M3 + M5 + M6: 50 seeded draws from the reference's space, every fold
    year from the second one to 1999 (train strictly earlier), level-scale RMSE;
    the best candidate is refitted on 1995-1999 and scored on 2000-2001."""
    fr = TR.cut_lineage(_frame(spark, sf_dir).withColumn("year", F.year(S.DS)))
    known = fr.filter(F.col("year") <= 1999)
    first = known.agg(F.min("year")).first()[0]
    cands = [BO.Params(**c) for c in TR.random_candidates(TR.REFERENCE_SPACE, 50, seed=42)]
    how = {"features": TR.FEATURES, "label": "y_log", "period": "year", "key": [S.UID, S.DS]}
    cv = TR.cut_lineage(BO.search(known, cands, list(range(first + 1, 2000)), **how, rounds=TUNING_ROUNDS, patience=TUNING_PATIENCE))
    best = TR.select_best(cv)
    rounds = cv.filter((F.col("candidate") == best) & F.col("fold").isNull()).first()["rounds"]
    model = BO.train(known, [BO.Fit(best, cands[best])], **how, rounds=rounds)[0][0]
    pred = BO.predict(fr.filter(F.col("year") >= 2000), model)
    test_rmse = pred.agg(F.sqrt(F.avg(F.pow(F.expm1("prediction") - F.expm1("y_log"), 2)))).first()[0]
    return (cv.withColumn("is_best", F.col("candidate") == best)
            .withColumn("test_rmse", F.when(F.col("is_best") & F.col("fold").isNull(), F.lit(float(test_rmse)))))


register("gbt_tuning")(gbt_tuning)
