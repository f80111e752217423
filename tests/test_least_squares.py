"""Least squares over columns against NumPy."""
import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from qpanel.functions.least_squares import least_squares
from qpanel.operators import models as MD

SCHEMA = "g string, x array<double>, target double"


def ridge(x, y, reg):
    xc, yc = x - x.mean(0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc / len(y) + reg * np.eye(x.shape[1]), xc.T @ yc / len(y))
    b = y.mean() - w @ x.mean(0)
    return b, w, float(np.mean((y - b - x @ w) ** 2))


def close(row, b, w, mse):
    return np.allclose(row["intercept"], b, atol=1e-8) and np.allclose(row["coefs"], w, atol=1e-8) and np.isclose(row["mse"], mse, atol=1e-8)


def test_each_group_equals_numpy(spark):
    rng = np.random.default_rng(3)
    rows, data = [], {}
    for g, n in [("a", 40), ("b", 7), ("c", 300)]:
        x = rng.normal(size=(n, 3)) * [1.0, 10.0, 0.1] + 1000
        y = x @ [2.0, -1.0, 5.0] + rng.normal(size=n)
        data[g] = (x, y)
        rows += [(g, [float(v) for v in a], float(b)) for a, b in zip(x, y)]
    df = spark.createDataFrame(rows, SCHEMA)
    for reg in (0.0, 0.3):
        got = {r["g"]: r for r in least_squares(df, 3, reg=reg, by=("g",)).collect()}
        assert set(got) == set(data)
        assert all(got[g]["n"] == len(y) and close(got[g], *ridge(x, y, reg)) for g, (x, y) in data.items()), reg
    x, y = (np.concatenate([d[i] for d in data.values()]) for i in (0, 1))
    assert close(least_squares(df, 3).first(), *ridge(x, y, 0.0))


def test_dependent_and_constant_regressors_get_zero(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(30, 2))
    rows = [("g", [float(a), 2 * float(a) + 1, 7.0, float(b)], float(3 * a - b + 2)) for a, b in x]
    r = least_squares(spark.createDataFrame(rows, SCHEMA), 4).first()
    assert np.allclose(r["coefs"], [3.0, 0.0, 0.0, -1.0]) and np.isclose(r["intercept"], 2.0) and r["mse"] < 1e-12


def test_incomplete_rows_take_no_part(spark):
    good = [("g", [float(i), float(i * i)], float(2 * i + i * i)) for i in range(6)]
    bad = [("g", [1.0], 9.0), ("g", [1.0, None], 9.0), ("g", None, 9.0), ("g", [1.0, 2.0], None), ("only", [1.0], 2.0)]
    got = least_squares(spark.createDataFrame(good + bad, SCHEMA), 2, by=("g",)).collect()
    assert [(r["g"], r["n"]) for r in got] == [("g", 6)]
    assert np.allclose(got[0]["coefs"], [2.0, 1.0])
    one = least_squares(spark.createDataFrame(good[:1], SCHEMA), 2).first()
    assert (one["n"], one["intercept"], list(one["coefs"]), one["mse"]) == (1, 0.0, [0.0, 0.0], 0.0)


def test_no_rows(spark):
    df = spark.createDataFrame([], SCHEMA)
    r = least_squares(df, 2).first()
    assert (r["n"], r["intercept"], r["coefs"], r["mse"]) == (0, None, None, None)
    assert least_squares(df, 2, by=("g",)).collect() == []
    assert MD.fit_window_regression(df, n_steps=2) == (None, [])


def test_one_shuffle_and_no_python(spark):
    df = spark.range(100).select(F.array(F.rand(1), F.rand(2)).alias("x"), F.rand(3).alias("target"), (F.col("id") % 5).alias("g"))
    plan = least_squares(df, 2, by=("g",))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan


def test_series_too_short_to_fit_say_so(spark):
    days = [dt.date(2010, 3, 31), dt.date(2010, 6, 30), dt.date(2010, 9, 30), dt.date(2010, 12, 31)]
    train = spark.createDataFrame([("a", d, float(i)) for i, d in enumerate(days)], "unique_id string, ds date, y double")
    f, model = MD.recursive_linear_forecast(train, 3, n_steps=4)
    assert model == (None, [])
    assert [(r["step"], r["forecast"], r["status"]) for r in f.orderBy("step").collect()] == [(k, None, "no_model") for k in (1, 2, 3)]
