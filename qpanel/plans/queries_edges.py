"""Registered queries on rows that trigger rules other queries pass by: runs
appended twice (S15), timing files in nested folders (S12), the non-zero mask
(P15), refused files (P21), missing counts on gappy series (W15) and missing
forecasts in the scores (E7)."""
from __future__ import annotations

from pyspark.sql import functions as F

from qpanel import schema as S
from qpanel.operators import compare as CP
from qpanel.operators import features as FE
from qpanel.operators import impute as I
from qpanel.operators import metrics as M
from qpanel.operators import select as SEL
from qpanel.plans import panels as P
from qpanel.plans.catalog import register
from qpanel.plans.queries_profile import _DENSE_SQL
from qpanel.plans.queries_runtimes import _RUN, _runtimes
from qpanel.plans.sql import panel_sql, r
from qpanel.session import scratch_dir
from qpanel.sources import files as FS
from qpanel.sources import runs as RU

COARSE = f"WITH panel AS ({panel_sql('region')})"
_TEST_SQL = f"ds BETWEEN DATE '{P.TEST_START}' AND DATE '{P.TEST_END}'"


def appended_runs(spark, sf_dir):
    """The panel appended twice under one run id, its test quarters under
    another; an attempt that died after its data left no manifest row."""
    path = scratch_dir(spark, "runs")
    panel = P.shared(P.coarse_panel(spark, sf_dir)).select(S.UID, S.DS, S.Y)
    _, test = P.split_train_test(panel)
    RU.append_run(panel, path, "2001-Q4/all")
    RU.append_run(panel, path, "2001-Q4/all")
    test.write.parquet(RU._run_folder(path, "died"))
    RU.append_run(test.select(S.Y, S.DS, S.UID), path, "test")
    back = RU.read_runs(spark, path)
    return back.groupBy(RU.RUN, S.DS).agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum(S.Y), 2).alias("total"))


register("appended_runs", f"""{COARSE}
SELECT run_id, ds, count(*) AS rows, round(sum(y), 2) AS total FROM panel, (VALUES ('2001-Q4/all'), ('test')) t(run_id)
WHERE run_id <> 'test' OR {_TEST_SQL} GROUP BY run_id, ds""")(appended_runs)


def timing_folders(spark, sf_dir):
    """A timing file for each model in nested folders, found by name
    among other files; each file's rows are summed."""
    root = scratch_dir(spark, "timings")
    rows = P.shared(_runtimes(spark, sf_dir).withColumn("total_time_s", F.col("total_time_s").cast("string")))
    by_model = rows.groupBy("model", "stage").agg(F.round(F.sum(F.col("total_time_s").try_cast("double")), 2).alias("total_time_s"))
    for model in ("naive", "lightgbm"):
        # a few (model, stage) sums a file, whatever the number of events
        lines = [f"{x['model']},{x['stage']},{x['total_time_s']}" for x in
                 by_model.filter(F.col("model") == model).orderBy("stage").collect()]
        text = "\n".join(["model,stage,total_time_s", "", *lines, "model,stage,total_time_s"])
        FS.write_text(f"{root}/{model}/deep/er/{model}_Runtime.csv", text)
        FS.write_text(f"{root}/{model}/{model}_predictions.csv", text)
        FS.write_text(f"{root}/{model}/{model}_runtime.txt", text)
    return CP.collect_runtimes(spark, root).select("model", "stage", F.round("total_time_s", 2).alias("total_time_s"))


register("timing_folders", f"""{_RUN}
SELECT model, stage, round(sum(total_time_s), 2) AS total_time_s FROM runtimes
WHERE model IN ('naive', 'lightgbm') GROUP BY model, stage""")(timing_folders)


def nonzero_scores(spark, sf_dir):
    """Zero, negative and missing actuals leave before a percentage error."""
    panel = P.coarse_panel(spark, sf_dir)
    q = F.quarter(S.DS)
    pairs = panel.select(S.BASIS, F.when(q == 1, 0.0).when(q == 2, -F.col(S.Y)).when(q == 3, F.col(S.Y)).alias("actual"),
                         (F.col(S.Y) * 1.1 + 5).alias("forecast"))
    kept = SEL.nonzero(pairs)
    return kept.groupBy(S.BASIS).agg(F.count(F.lit(1)).alias("n"),
                                     F.round(F.avg(F.abs(F.col("forecast") / F.col("actual") - 1)) * 100, 6).alias("mape"))


register("nonzero_scores", f"""{COARSE}
SELECT basis, count(*) AS n, round(avg(abs((y * 1.1 + 5) / y - 1)) * 100, 6) AS mape FROM panel
WHERE quarter(ds) = 3 AND y > 0 GROUP BY basis""")(nonzero_scores)


def refused_files(spark, sf_dir):
    """Prediction files of the test quarters, some without a column their
    layout needs: which are refused, why, and the rows of the others."""
    base = scratch_dir(spark, "refused")
    _, test = P.split_train_test(P.shared(P.coarse_panel(spark, sf_dir)))
    rows = test.select(S.DS, S.UID, F.col(S.Y).alias("actual"), (F.col(S.Y) + 1).alias("forecast"))
    made = {"whole": rows, "no_id": rows.drop(S.UID), "no_date": rows.drop(S.DS), "no_forecast": rows.drop("forecast")}
    for name, df in made.items():
        FS.write_table(df, f"{base}/{name}", fmt="csv")
    return FS.check_files(spark, {name: (f"{base}/{name}", [S.DS, S.UID, "actual", "forecast"]) for name in made})


register("refused_files", f"""{COARSE},
n AS (SELECT count(*) AS rows FROM panel WHERE {_TEST_SQL})
SELECT file, missing IS NOT NULL AS refused, missing, CASE WHEN missing IS NULL THEN rows END AS rows
FROM n, (VALUES ('whole', NULL), ('no_id', 'unique_id'), ('no_date', 'ds'), ('no_forecast', 'forecast')) t(file, missing)""")(refused_files)


def missing_counts(spark, sf_dir):
    """Missing count and slope of the last 4 on the gappy dense panel
    (slopes of cents over four quarters are whole thousandths)."""
    dense = P.shared(I.densify(P.shared(P.fine_panel(spark, sf_dir))))
    f = FE.panel_features_more(dense, value=S.Y)
    return f.select(S.UID, S.DS, F.col("miss_count_4").cast("int").alias("miss_count_4"), F.round("roll_slope_4", 3).alias("roll_slope_4"))


register("missing_counts", f"""{_DENSE_SQL},
k AS (SELECT unique_id, ds, y, row_number() OVER (PARTITION BY unique_id ORDER BY ds) AS t FROM dense)
SELECT unique_id, ds, CAST(sum(CASE WHEN y IS NULL THEN 1 ELSE 0 END) OVER w AS INTEGER) AS miss_count_4,
       {r('CASE WHEN count(y) OVER w = 4 THEN regr_slope(y, t) OVER w END', 3)} AS roll_slope_4
FROM k WINDOW w AS (PARTITION BY unique_id ORDER BY ds ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""")(missing_counts)


def wmape_missing_forecasts(spark, sf_dir):
    """Weighted errors where every first quarter lacks its forecast and
    every second its actual: E7 keeps the actuals of missing forecasts."""
    panel = P.coarse_panel(spark, sf_dir)
    q = F.quarter(S.DS)
    pairs = panel.select(S.BASIS, F.when(q != 2, F.col(S.Y)).alias("actual"), F.when(q != 1, F.col(S.Y) * 0.9 - 3).alias("forecast"))
    return pairs.groupBy(S.BASIS).agg(F.round(M.wmape(variant="abs"), 8).alias("wmape_pairs"),
                                      F.round(M.wmape(variant="nullskip"), 8).alias("wmape_nullskip"))


register("wmape_missing_forecasts", f"""{COARSE}
SELECT basis, round(sum(abs(y - (y * 0.9 - 3))) FILTER (WHERE quarter(ds) > 2) / sum(abs(y)) FILTER (WHERE quarter(ds) > 2), 8) AS wmape_pairs,
       round(sum(abs(y - (y * 0.9 - 3))) FILTER (WHERE quarter(ds) > 2) / sum(abs(y)) FILTER (WHERE quarter(ds) <> 2), 8) AS wmape_nullskip
FROM panel GROUP BY basis""")(wmape_missing_forecasts)
