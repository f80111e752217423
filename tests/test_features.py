"""Feature goldens (fixtures D, E, H) and a no-leakage invariant."""
import math

from pyspark.sql import functions as F

from qpanel import schema as S
from qpanel.functions.dates import label_to_quarter_end
from qpanel.operators import features as FE
from qpanel.operators import reshape as R

QS = ["2005-Q1", "2005-Q2", "2005-Q3", "2005-Q4"]


def feature_panel(spark):
    """Fixture D with distinct keys: 4 rows x 4 quarters, values 1..7."""
    rows = [("A", "X", "F", 1, 2, 3, 4), ("B", "Y", "F", 2, 3, 4, 5),
            ("C", "X", "U", 3, 4, 5, 6), ("D", "Z", "U", 4, 5, 6, 7)]
    df = spark.createDataFrame(rows, "rep string, cp string, basis string, `2005-Q1` int, "
                                     "`2005-Q2` int, `2005-Q3` int, `2005-Q4` int")
    long = R.wide_to_long(df, ["rep", "cp", "basis"], QS, keep_nulls=False)
    return R.make_uid(long)


def test_long_rows_and_lag(spark):
    long = feature_panel(spark)
    assert long.count() == 16
    f = FE.panel_features(FE.prepare_log(long)).orderBy(S.UID, S.DS).collect()
    a = [r for r in f if r[S.UID] == "A_X_F"]
    assert a[0]["lag_1"] is None
    assert [r["lag_1"] for r in a[1:]] == [1.0, 2.0, 3.0]
    assert all(r["y_log"] >= 0 for r in f)
    for c in ["roll_mean_8", "roll_std_8", "roll_skew_8", "roll_kurt_8", "pct_gap_1",
              "zero_flag", "nonzero_count", "ctrpty_quarter_season", "q_sin", "q_cos"]:
        assert c in f[0].asDict()


def test_nan_inf_prepare(spark):
    """Fixture E: melt keeps inf, drops NaN (7 rows); prepare drops inf (6)."""
    rows = [("A", "X", "F", 1.0, float("nan"), 3.0, 4.0), ("B", "Y", "U", 2.0, 4.0, float("inf"), 5.0)]
    qs = ["2000-Q1", "2000-Q2", "2000-Q3", "2000-Q4"]
    df = spark.createDataFrame(rows, "rep string, cp string, basis string, " +
                               ", ".join(f"`{q}` double" for q in qs))
    long = R.wide_to_long(df, ["rep", "cp", "basis"], qs, keep_nulls=False)
    assert long.count() == 7
    prep = FE.prepare_log(R.make_uid(long))
    rows = prep.collect()
    assert len(rows) == 6
    assert all(abs(r["y_log"] - math.log1p(r["exposure"])) < 1e-12 for r in rows)
    f = FE.panel_features_short(prep)
    assert {"lag_1", "roll_mean_4", "pct_change_1", "pct_change_4"} <= set(f.columns)


def test_supervised_windows(spark):
    """Fixture H: [10..50], n_steps 2 -> 3 windows, [10,20] -> 30."""
    df = spark.createDataFrame([("s", f"2000-Q{i + 1}" if i < 4 else "2001-Q1", float(v))
                                for i, v in enumerate([10, 20, 30, 40, 50])],
                               "unique_id string, q string, y double") \
        .withColumn(S.DS, label_to_quarter_end("q"))
    w = FE.supervised_windows(df, 2).orderBy(S.DS).collect()
    assert len(w) == 3
    assert (list(w[0]["x"]), w[0]["target"]) == ([10.0, 20.0], 30.0)


def test_no_future_leakage(spark):
    """Truncating the panel after t leaves lag/rolling features at <= t unchanged."""
    long = FE.prepare_log(feature_panel(spark))
    full = FE.panel_features(long).filter(F.col(S.DS) <= F.to_date(F.lit("2005-06-30")))
    cut = FE.panel_features(long.filter(F.col(S.DS) <= F.to_date(F.lit("2005-06-30"))))
    cols = [S.UID, S.DS, "lag_1", "roll_mean_8", "roll_std_8", "nonzero_count"]
    assert sorted(full.select(cols).collect()) == sorted(cut.select(cols).collect())


def test_partition_count_independent(spark):
    long = FE.prepare_log(feature_panel(spark))
    a = FE.panel_features(long.repartition(1)).select(S.UID, S.DS, "lag_2", "roll_mean_8")
    b = FE.panel_features(long.repartition(7)).select(S.UID, S.DS, "lag_2", "roll_mean_8")
    assert sorted(a.collect()) == sorted(b.collect())


def test_modelling_mode_uses_only_earlier_quarters(spark):
    """Q10: with contemporaneous=False, changing the last quarter's value
    changes no feature of that quarter (only its label)."""
    long = FE.prepare_log(feature_panel(spark))
    last = F.to_date(F.lit("2005-12-31"))
    bumped = long.withColumn("exposure", F.when(F.col(S.DS) == last, F.col("exposure") * 10)
                             .otherwise(F.col("exposure")))
    cols = [S.UID, "pct_gap_1", "zero_flag", "nonzero_count", "lag_1", "roll_mean_8"]
    a = FE.panel_features(long, contemporaneous=False).filter(F.col(S.DS) == last).select(cols)
    b = FE.panel_features(bumped, contemporaneous=False).filter(F.col(S.DS) == last).select(cols)
    assert sorted(a.collect()) == sorted(b.collect())
    c = FE.panel_features(bumped).filter(F.col(S.DS) == last).select(cols)
    assert sorted(a.collect()) != sorted(c.collect())
