"""Cleaning and consolidation on the reference's tiny wide fixtures."""
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qpanel.operators import clean as C
from qpanel.operators import reshape as R

DESC = ["Reporting country", "Counterparty country", "L_REP_CTY", "L_CP_COUNTRY", "CBS_BASIS",
        "L_MEASURE", "Type of instruments", "Remaining maturity",
        "Currency type of booking location", "Counterparty sector", "Balance sheet position",
        "CBS_BANK_TYPE"]
QS = ["2005-Q1", "2005-Q2", "2020-Q1", "2020-Q2"]


def raw_fixture(spark):
    """Fixture A: 6 rows; empty descriptors are NULL and must survive !=."""
    base = ["A", "B", "A", "B", "F", None, None, None, None, "All sectors", "Total claims"]
    rows = [
        (*base, "4B", 10.0, 20.0, 30.0, 40.0),
        (*base, "4R", 1.0, 2.0, 3.0, 4.0),
        (*base, "4C", 5.0, 5.0, 5.0, 5.0),
        (*base, "4O", 0.0, 0.0, 0.0, 0.0),
        ("All reporting countries", *base[1:], "4B", 1.0, 1.0, 1.0, 1.0),
        (*base, "4B", None, None, None, None),
    ]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in DESC] +
                          [T.StructField(q, T.DoubleType()) for q in QS])
    return spark.createDataFrame(rows, schema)


def test_clean_keeps_null_descriptors(spark):
    out = C.clean_claims(raw_fixture(spark), time_cols=QS)
    assert out.count() == 4


def test_filter_audit_adds_up(spark):
    a = {r["step"]: r["rows"] for r in C.filter_audit(raw_fixture(spark), QS).collect()}
    assert a == {"kept": 4, "aggregate_entity": 1, "all_periods_missing": 1}


def test_consolidation_golden_14(spark):
    cl = C.clean_claims(raw_fixture(spark), time_cols=QS)
    long = R.wide_to_long(cl, ["L_REP_CTY", "L_CP_COUNTRY", "CBS_BASIS", "CBS_BANK_TYPE"], QS,
                          keep_nulls=False)
    wide = C.pivot_bank_types(long, ["L_REP_CTY", "L_CP_COUNTRY", "CBS_BASIS", "quarter"],
                              bank_col="CBS_BANK_TYPE", value_col="y")
    out = {r["quarter"]: r["consolidated"] for r in C.consolidate(wide).collect()}
    assert out["2005-Q1"] == 14.0           # (10 - 1) + (5 + 0)
    assert len(out) == 4


def test_consolidation_golden_b(spark):
    """Fixture B: F -> 35, 200; X -> 65, 130."""
    rows = [("F", "4B", 100.0, 200.0), ("F", "4R", 100.0, 200.0), ("F", "4C", 25.0, 0.0),
            ("F", "4O", 10.0, 0.0), ("X", "4B", 120.0, 240.0), ("X", "4R", 100.0, 200.0),
            ("X", "4C", 30.0, 60.0), ("X", "4O", 15.0, 30.0)]
    df = spark.createDataFrame(rows, "basis string, bt string, `2005-Q1` double, `2005-Q2` double")
    long = R.wide_to_long(df, ["basis", "bt"], ["2005-Q1", "2005-Q2"])
    wide = C.consolidate(C.pivot_bank_types(long, ["basis", "quarter"], bank_col="bt", value_col="y"))
    got = {(r["basis"], r["quarter"]): r["consolidated"] for r in wide.collect()}
    assert got == {("F", "2005-Q1"): 35.0, ("F", "2005-Q2"): 200.0,
                   ("X", "2005-Q1"): 65.0, ("X", "2005-Q2"): 130.0}


def test_missing_bank_type_is_zero(spark):
    df = spark.createDataFrame([("F", "4B", 1.0)], "k string, bt string, y double")
    w = C.pivot_bank_types(df, ["k"], bank_col="bt", value_col="y").collect()[0]
    assert (w["4R"], w["4C"], w["4O"]) == (0.0, 0.0, 0.0)


def test_split_by_period(spark):
    df = spark.createDataFrame([("a", "2004-12-31"), ("a", "2005-03-31"), ("a", "2020-03-31")],
                               "unique_id string, d string").select("unique_id", F.to_date("d").alias("ds"))
    tr, te = C.split_by_period(df)
    assert tr.count() == 1 and te.count() == 1


def test_quarter_column_rules(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0, 4.0)], "id int, `2005-Q1` double, `2005-Q3 ` double, `1999` double")
    assert C.quarter_columns(df, "strict") == ["2005-Q1"]
    assert C.quarter_columns(C.trim_columns(df), "suffix") == ["2005-Q1", "2005-Q3"]


def test_filter_codes_and_required_columns(spark):
    df = spark.createDataFrame([("A", "4B"), ("A", "4R"), ("B", "4B")], "L_REP_CTY string, CBS_BANK_TYPE string")
    assert C.filter_codes(df, {"L_REP_CTY": "A", "CBS_BANK_TYPE": "4B"}).count() == 1
    C.require_columns(df, ["L_REP_CTY"])
    try:
        C.require_columns(df, ["L_REP_CTY", "Counterparty country"])
        raise AssertionError("expected ValueError")
    except ValueError as e:
        assert "Counterparty country" in str(e)


def test_coverage_approx_close_to_exact(spark):
    import datetime as dt

    from qpanel.operators import profile as PR
    rows = [(f"r{i % 17}", f"c{i % 23}", dt.date(2000, 3, 31), 1.0) for i in range(400)]
    df = spark.createDataFrame(rows, "rep string, cp string, ds date, y double")
    ex = PR.coverage_by_quarter(df).first()
    ap = PR.coverage_approx(df).first()
    assert (ex["n_reporters"], ex["n_counterparties"]) == (17, 23)
    for c in ("n_reporters", "n_counterparties", "n_pairs"):
        assert abs(ap[c] - ex[c]) <= max(2, 0.05 * ex[c])


def test_unique_value_summary_branches(spark):
    from qpanel.operators import profile as PR
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("a", 2.0)], "s string, v double")
    got = {r["column"]: r["summary"] for r in PR.unique_value_summary(df, ["s", "v"], numeric_cols=["v"]).collect()}
    assert got == {"s": "a, b", "v": "3 instances"}


def test_filter_and_sum_extract(spark):
    base = dict(FREQ="Q", CURR_TYPE_BOOK="TO1", L_MEASURE="S", CBS_BASIS="F", L_POSITION="C",
                L_INSTR="A", REM_MATURITY="A", L_CP_SECTOR="A")
    cols = ["Reporting country", "Counterparty country", *base, "CBS_BANK_TYPE", "2005-Q1", "2005-Q2"]
    rows = [("DE", "US", *base.values(), "4B", 1.0, None),
            ("DE", "US", *base.values(), "4D", 2.0, None),
            ("DE", "US", *base.values(), "4X", 50.0, 50.0),       # bank type out of the list
            ("DE", "US", *{**base, "L_MEASURE": "B"}.values(), "4B", 70.0, 70.0)]
    schema = ", ".join(f"`{c}` string" for c in cols[:-2]) + ", `2005-Q1` double, `2005-Q2` double"
    out = C.filter_and_sum_extract(spark.createDataFrame(rows, schema)).collect()
    assert [(r["2005-Q1"], r["2005-Q2"]) for r in out] == [(3.0, 0.0)]
