"""Column helpers and the quirk rules they encode."""
import datetime as dt

from pyspark.sql import functions as F

from qpanel.functions.dates import label_to_quarter_end, quarter_end, quarter_index, quarter_label
from qpanel.functions.numeric import clip, finite_or_null, safe_div


def test_quarter_end_is_idempotent(spark):
    """Q6: a quarter end stays put (pandas' +QuarterEnd() would move it)."""
    df = spark.createDataFrame([(dt.date(2020, 3, 31),), (dt.date(2020, 2, 14),), (dt.date(2020, 12, 1),)],
                               "d date")
    got = [(str(r[0]), str(r[1]), r[2], r[3]) for r in df.select(
        quarter_end("d"), quarter_end(quarter_end("d")), quarter_label("d"), quarter_index("d")).collect()]
    assert got == [("2020-03-31", "2020-03-31", "2020-Q1", 8080), ("2020-03-31", "2020-03-31", "2020-Q1", 8080),
                   ("2020-12-31", "2020-12-31", "2020-Q4", 8083)]


def test_label_parsing_rejects_junk(spark):
    df = spark.createDataFrame([("2005-Q1",), ("2005-Q4",), ("2005Q1",), ("Series",), (None,)], "l string")
    got = [r[0] for r in df.select(label_to_quarter_end("l")).collect()]
    assert [str(g) if g else None for g in got] == ["2005-03-31", "2005-12-31", None, None, None]


def test_numeric_rules(spark):
    df = spark.createDataFrame([(float("inf"), 0.0), (float("nan"), 2.0), (-3.0, 0.0), (None, 1.0), (5.0, 2.0)],
                               "x double, y double")
    rows = df.select(finite_or_null("x").alias("f"), clip("x", 0.0, 4.0).alias("c"),
                     safe_div("x", "y").alias("d")).collect()
    assert [r["f"] for r in rows] == [None, None, -3.0, None, 5.0]
    assert [r["c"] for r in rows][2:] == [0.0, None, 4.0]       # NULL stays NULL (P18)
    assert [r["d"] for r in rows][2:] == [None, None, 2.5]     # x / 0 -> NULL, no ANSI error (Q18)
