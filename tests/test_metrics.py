"""Metric goldens (fixture G), h/m/s, and forecast alignment (fixture F)."""
import datetime as dt

from pyspark.sql import functions as F

from qpanel import schema as S
from qpanel.functions.dates import seconds_to_hms
from qpanel.functions.numeric import finite_or_null
from qpanel.operators import forecast as fc
from qpanel.operators import metrics as M


def test_wmape_finite_pairs(spark):
    """Fixture G: pairs with a non-finite side are masked: (0+.5+.5)/3."""
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 0.5), (2.0, 2.5), (3.0, float("nan"))],
                               "actual double, forecast double")
    assert abs(df.agg(M.wmape(variant="finite")).first()[0] - 1 / 3) < 1e-12


def test_wmape_nullskip(spark):
    """Fixture G: NaN actual is missing; errors 0,1,1 over |0|+|1|+|2| = 2/3."""
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 2.0), (2.0, 1.0), (float("nan"), 5.0)],
                               "actual double, forecast double") \
        .select(finite_or_null("actual").alias("actual"), "forecast")
    assert abs(df.agg(M.wmape(variant="nullskip")).first()[0] - 2 / 3) < 1e-12


def test_seconds_to_hms(spark):
    df = spark.createDataFrame([(0,), (3600,), (3661,), (7322,)], "s long")
    got = [tuple(r["t"]) for r in df.select(seconds_to_hms("s").alias("t")).collect()]
    assert got == [(0, 0, 0), (1, 0, 0), (1, 1, 1), (2, 2, 2)]


def test_forecast_aligned_to_test_dates(spark):
    """Fixture F: two series, 4 quarter ends; naive forecasts line up with ds."""
    rows = [(uid, dt.date(2020, m, d), float(uid * 10 + i))
            for uid in (1, 2) for i, (m, d) in enumerate([(3, 31), (6, 30), (9, 30), (12, 31)])]
    df = spark.createDataFrame(rows, "uid int, ds date, y double") \
        .select(F.col("uid").cast("string").alias(S.UID), S.DS, S.Y)
    f = fc.naive(df, "2019-12-31", 4, level=False)
    assert f.count() == 0   # nothing at or before the cutoff
    hist = df.withColumn(S.DS, F.add_months(S.DS, -12)).withColumn(S.DS, F.last_day(S.DS))
    f = fc.naive(hist, "2019-12-31", 4, level=False)
    j = fc.join_actuals(f, df).filter(F.col(S.UID) == "1").orderBy(S.DS).collect()
    assert [r["actual"] for r in j] == [10.0, 11.0, 12.0, 13.0]
    assert [r["step"] for r in j] == [1, 2, 3, 4]
