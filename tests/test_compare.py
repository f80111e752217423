"""Comparison tables on small metric / runtime frames."""
import datetime as dt

from pyspark.sql import functions as F

from qpanel import schema as S
from qpanel.operators import compare as CP
from qpanel.operators import reshape as R
from qpanel.operators import select as SL
from qpanel.sources.files import attach_keys

MODELS = ["lstm_blocks_4feat_100ep", "lstm_blocks_8feat_100ep", "lstm_blocks_4feat_500ep",
          "lstm1_500epochs", "lightgbm", "lightgbm_iterative", "naive", "arima", "vector_lstm_50epochs"]


def metrics(spark):
    rows = [(m, h, float(10 * i + h), float(i + h), 0.1 * (i + 1), 1.0)
            for i, m in enumerate(MODELS) for h in (1, 2, 3, 4, 5)]
    return spark.createDataFrame(rows, "model string, horizon int, rmse double, smape double, "
                                       "wmape double, log_rmse double")


def runtimes(spark):
    rows = [(m, "s", float(i + 1)) for i, m in enumerate(MODELS)] + [("lightgbm", "predict", 0.5)]
    return spark.createDataFrame(rows, "model string, stage string, total_time_s double")


def test_categories_and_best(spark):
    s = CP.model_summary(metrics(spark))
    cats = {r["model"]: r["category"] for r in s.collect()}
    assert cats["lstm_blocks_8feat_100ep"] == "LSTM_Hybrid_8feat"
    assert cats["naive"] == "Naïve" and cats["vector_lstm_50epochs"] == "LSTM_Vectorized"
    best = {(r["metric"], r["category"]): r["model"] for r in CP.best_per_category(s).collect()}
    assert best[("rmse_mean", "LSTM_Hybrid_4feat")] == "lstm_blocks_4feat_100ep"


def test_accuracy_runtime_tables(spark):
    m, rt = metrics(spark), runtimes(spark)
    g2 = {r["model"]: r for r in CP.accuracy_vs_runtime(m, rt, "rmse", 4).collect()}
    assert g2["lightgbm"]["total_time_s"] == 5.5 and g2["lightgbm"]["mean_rmse"] == 42.5
    g6 = CP.pairwise_model_comparison(m, rt).collect()
    assert sorted(r["model"] for r in g6) == ["lightgbm", "lightgbm_iterative"]
    g7 = {r["label"] for r in CP.variant_tradeoff(m, rt).collect()}
    assert g7 == {"L1", "L4"}


def test_block_epoch_grid_reindexed(spark):
    g = {r["epoch"]: r for r in CP.block_epoch_grid(metrics(spark), "rmse").collect()}
    assert set(g) == {100, 200, 500}
    assert g[200]["4"] is None and g[100]["8"] == 13.0
    long = CP.block_epoch_grid_all(metrics(spark)).filter(F.col("metric") == "wmape").count()
    assert long == 3


def test_epoch_variants_and_horizon_pivot(spark):
    g5 = CP.epoch_variant_accuracy(metrics(spark), "wmape").columns
    assert "lstm1_500epochs" in g5 and "naive" not in g5
    g1 = CP.metric_by_horizon(metrics(spark), "rmse", ["naive", "arima"]).orderBy("horizon").first()
    assert (g1["naive"], g1["arima"]) == (61.0, 71.0)


def test_explode_steps_and_keys(spark):
    df = spark.createDataFrame([(3, [1.0, 2.0], [1.5, 2.5])], "row int, actuals array<double>, forecasts array<double>")
    ex = R.explode_steps(df, ["row"]).collect()
    assert [(r["step"], r["actual"], r["forecast"]) for r in ex] == [(1, 1.0, 1.5), (2, 2.0, 2.5)]
    meta = spark.createDataFrame([(3, "A_B_F", dt.date(2020, 3, 31))], "row int, unique_id string, ds date")
    j = attach_keys(R.explode_steps(df, ["row"]), meta).first()
    assert j[S.UID] == "A_B_F"
    assert SL.series_slice(meta, "A_B_F").count() == 1


def test_stack_predictions_union_by_name(spark):
    a = spark.createDataFrame([("u", 1.0)], "unique_id string, forecast double")
    b = spark.createDataFrame([(2.0, "v", 3.0)], "forecast double, unique_id string, lo double")
    s = CP.stack_predictions({"m1": a, "m2": b}).orderBy("model").collect()
    assert [(r["model"], r["unique_id"], r["lo"]) for r in s] == [("m1", "u", None), ("m2", "v", 3.0)]


def test_tick_labels_and_feature_prefixes(spark):
    from qpanel.operators import profile as PR
    from qpanel.operators import trees as TR
    cal = spark.createDataFrame([(dt.date(2002, 6, 30),), (dt.date(2004, 6, 30),), (dt.date(2004, 9, 30),)],
                                "ds date")
    ev = spark.createDataFrame([(dt.date(2004, 6, 30), "crisis")], "ds date, event string")
    got = {str(r["ds"]): (r["tick"], r["event"]) for r in PR.tick_labels(cal, events=ev).collect()}
    # ticks in Q2 of years divisible by 3 (2004 = 3 x 668)
    assert got == {"2002-06-30": (False, None), "2004-06-30": (True, "crisis"), "2004-09-30": (False, None)}
    df = spark.createDataFrame([(1.0, 2.0, 3.0, "x")], "lag_1 double, roll_mean_4 double, y double, k string")
    assert TR.feature_columns(df) == ["lag_1", "roll_mean_4"]


def test_evaluate_flow(spark):
    rows = [("A_B_F", dt.date(2020, m, d), 10.0 + i, 11.0 + i)
            for i, (m, d) in enumerate([(3, 31), (6, 30), (9, 30), (12, 31)])]
    p = spark.createDataFrame(rows, "unique_id string, ds date, actual double, forecast double")
    test = p.select("unique_id", "ds")
    out = CP.evaluate({"naive": p, "seasonal_naive": p.withColumn("forecast", F.col("actual"))}, test)
    met = {(r["model"], r["horizon"]): r["rmse"] for r in out["metrics"].collect()}
    assert met[("naive", 1)] == 1.0 and met[("seasonal_naive", 4)] == 0.0
    best = {(r["metric"], r["category"]): r["model"] for r in out["best"].collect()}
    assert best[("rmse_mean", "Seasonal_Naive")] == "seasonal_naive"
