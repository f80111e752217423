"""Registered queries: readers and sinks, as write-then-read round trips in a
scratch folder beside the checkpoints (S1, S2, S4-S11, S14-S17, J3, P1, P8,
P21, P24)."""
from __future__ import annotations

from pyspark.sql import functions as F

from qpanel import schema as S
from qpanel.functions.dates import quarter_label
from qpanel.operators import reshape as R
from qpanel.operators.clean import quarter_columns
from qpanel.plans import panels as P
from qpanel.plans.catalog import register
from qpanel.plans.queries_prepare import _CLAIMS_SQL, ID_COLS, claims_wide
from qpanel.plans.sql import panel_sql, r
from qpanel.session import scratch_dir
from qpanel.sources import files as FS

COARSE = f"WITH panel AS ({panel_sql('region')})"


def csv_panel_round_trip(spark, sf_dir):
    """The wide claims table through CSV with padded headers."""
    path = scratch_dir(spark, "panel-csv")
    wide = claims_wide(spark, sf_dir)
    padded = wide.toDF(*[f" {c} " if c in ("CBS_BASIS", "1995-Q2", "2001-Q4") else c for c in wide.columns])
    FS.write_table(padded, path, fmt="csv")
    back = FS.read_panel(spark, path)
    return back.select(*[F.col(f"`{c}`") for c in ID_COLS + quarter_columns(back)])


register("csv_panel_round_trip", _CLAIMS_SQL)(csv_panel_round_trip)


def long_csv_round_trip(spark, sf_dir):
    """The long panel through CSV; values of first quarters and dates
    of basis N are spoilt on the way and come back NULL."""
    path = scratch_dir(spark, "long-csv")
    panel = P.coarse_panel(spark, sf_dir)
    text = panel.select(F.when(F.col(S.BASIS) == "N", F.lit("no date")).otherwise(F.col(S.DS).cast("string")).alias("ds"), S.UID,
                        F.when(F.quarter(S.DS) == 1, F.lit("n/a")).otherwise(F.round(S.Y, 4).cast("string")).alias("y"))
    FS.write_table(text, path, fmt="csv")
    return FS.read_long(spark, path)


register("long_csv_round_trip", f"""{COARSE}
SELECT CASE WHEN basis <> 'N' THEN ds END AS ds, unique_id,
       CASE WHEN quarter(ds) <> 1 THEN round(y, 4) END AS y FROM panel""")(long_csv_round_trip)


def _layout_files(spark, sf_dir):
    """One prediction file for each layout, from the test quarters: the forecast
    is the actual value plus the layout's number; AFRICA's are spoilt."""
    base = scratch_dir(spark, "predictions")
    _, test = P.split_train_test(P.shared(P.coarse_panel(spark, sf_dir)))
    test = test.withColumn("v", F.round(S.Y, 2))
    keyed = test.select(F.col(S.REP).alias("L_REP_CTY"), F.col(S.CP).alias("L_CP_COUNTRY"), F.col(S.BASIS).alias("CBS_BASIS"), S.DS, "v")
    spoilt = lambda k, c: F.when(F.col(c) == "AFRICA", F.lit("n/a")).otherwise(F.round(F.col("v") + k, 2).cast("string"))
    files = {
        "arima": test.select(S.DS, S.UID, F.col("v").alias("actual"), spoilt(1, S.REP).alias("forecast")),
        "lightgbm": keyed.select("L_REP_CTY", "L_CP_COUNTRY", "CBS_BASIS", F.replace(quarter_label(S.DS), F.lit("-")).alias("period"),
                                 F.col("v").alias("y_true"), spoilt(2, "L_REP_CTY").alias("yhat")),
        "lightgbm_iterative": keyed.select("L_REP_CTY", "L_CP_COUNTRY", "CBS_BASIS", quarter_label(S.DS).alias("period"),
                                           F.col("v").alias("exposure"), spoilt(3, "L_REP_CTY").alias("exposure_pred")),
        "naive": test.select(S.UID, S.DS, F.col("v").alias("value"), spoilt(4, S.REP).alias("prediction")),
        "seasonal_naive": test.select(S.UID, S.DS, spoilt(5, S.REP).alias("SeasonalNaive"), F.col("v").alias("y")),
        "seasonal_window_average": test.select(S.UID, S.DS, spoilt(6, S.REP).alias("SeasWA"), F.col("v").alias("y")),
    }
    # row-indexed: the row number is a key of its own, the quarter's and the series' text
    row = F.crc32(F.concat_ws("|", S.UID, S.DS).cast("binary"))
    meta = test.select(row.alias("row"), S.UID, S.DS)
    files["lstm_blocks_4feat_500ep"] = test.select(row.alias("row"), F.col("v").alias("y_true"), spoilt(7, S.REP).alias("y_pred"))
    for model, df in files.items():
        FS.write_table(df, f"{base}/{model}", fmt="csv")
    return {m: f"{base}/{m}" for m in files}, meta


def prediction_layouts(spark, sf_dir):
    """Every model family's file through its reader."""
    files, meta = _layout_files(spark, sf_dir)
    return FS.read_all_predictions(spark, files, meta)


register("prediction_layouts", f"""{COARSE},
models(model, k) AS (VALUES ('arima', 1), ('lightgbm', 2), ('lightgbm_iterative', 3), ('naive', 4), ('seasonal_naive', 5),
                            ('seasonal_window_average', 6), ('lstm_blocks_4feat_500ep', 7))
SELECT ds, unique_id, rep AS key1, cp AS key2, basis AS key3, round(y, 2) AS actual,
       CASE WHEN rep <> 'AFRICA' THEN round(round(y, 2) + k, 2) END AS forecast, model
FROM panel, models WHERE ds BETWEEN DATE '{P.TEST_START}' AND DATE '{P.TEST_END}'""")(prediction_layouts)


def standard_records(spark, sf_dir):
    """Records with the id from the keys, and with the keys from the id."""
    _, test = P.split_train_test(P.shared(P.coarse_panel(spark, sf_dir)))
    rows = test.withColumn("actual", F.round(S.Y, 2)).withColumn("forecast", F.lit(float("inf")))
    a = R.standardize_predictions(rows.drop(S.UID)).withColumn("made", F.lit("id"))
    b = R.standardize_predictions(rows.drop(*S.KEYS)).withColumn("made", F.lit("keys"))
    return a.unionByName(b)


register("standard_records", f"""{COARSE}
SELECT ds, unique_id, rep, cp, basis, round(y, 2) AS actual, CAST(NULL AS DOUBLE) AS forecast, made
FROM panel, (VALUES ('id'), ('keys')) m(made) WHERE ds BETWEEN DATE '{P.TEST_START}' AND DATE '{P.TEST_END}'""")(standard_records)


def sink_by_method(spark, sf_dir):
    """One folder per basis, then the same rows appended."""
    path = scratch_dir(spark, "sink")
    panel = P.shared(P.coarse_panel(spark, sf_dir))
    FS.write_table(panel, path, partition_by=[S.BASIS])
    FS.write_table(panel, path, mode="append", partition_by=[S.BASIS])
    return spark.read.parquet(path).groupBy(S.BASIS).agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum(S.Y), 2).alias("total"))


register("sink_by_method", f"""{COARSE}
SELECT basis, 2 * count(*) AS rows, round(2 * sum(y), 2) AS total FROM panel GROUP BY basis""")(sink_by_method)


def panel_range_read(spark, sf_dir):
    """S14 by year: a date range read back from the folders it needs."""
    path = scratch_dir(spark, "by-year")
    FS.write_panel(P.coarse_panel(spark, sf_dir), path)
    back = FS.read_panel_range(spark, path, "1996-07-01", "1998-03-31")
    return back.select(S.UID, S.DS, F.round(S.Y, 4).alias(S.Y))


register("panel_range_read", f"""{COARSE}
SELECT unique_id, ds, {r('y')} AS y FROM panel WHERE ds BETWEEN DATE '1996-07-01' AND DATE '1998-03-31'""")(panel_range_read)


def saved_model(spark, sf_dir):
    """A fitted pipeline, saved and loaded, predicts the same rows."""
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    panel = P.shared(P.coarse_panel(spark, sf_dir)).select(S.UID, S.DS, S.Y, F.quarter(S.DS).cast("double").alias("q"), F.year(S.DS).cast("double").alias("t"))
    model = Pipeline(stages=[VectorAssembler(inputCols=["q", "t"], outputCol="x"), LinearRegression(featuresCol="x", labelCol=S.Y)]).fit(panel)
    path = scratch_dir(spark, "model")
    FS.save_model(model, path)
    one, two = (m.transform(panel).select(S.UID, S.DS, "prediction") for m in (model, PipelineModel.load(path)))
    both = one.join(two.withColumnRenamed("prediction", "again"), [S.UID, S.DS])
    return both.select(S.UID, S.DS, (F.col("prediction") == F.col("again")).alias("same"))


register("saved_model", f"{COARSE} SELECT unique_id, ds, true AS same FROM panel")(saved_model)
