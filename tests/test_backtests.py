"""Back-tests of the fitted models against one refit a fold."""
import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from qpanel import schema as S
from qpanel.operators import backtests as BT
from qpanel.operators import forecast as fc
from qpanel.operators import models as MD

SCHEMA = f"{S.UID} string, {S.DS} date, {S.Y} double"


def quarter_end(i: int) -> dt.date:
    y, q = 1995 + i // 4, i % 4
    return dt.date(y + (q == 3), (3 * (q + 1)) % 12 + 1, 1) - dt.timedelta(days=1)


def panel(spark, series: dict):
    """A row for each value that is not 'gap'."""
    rows = [(k, quarter_end(i), None if v is None else float(v)) for k, vs in series.items() for i, v in enumerate(vs) if v != "gap"]
    return spark.createDataFrame(rows, SCHEMA)


def noisy(n_series: int = 9, n: int = 28) -> dict:
    rng = np.random.default_rng(5)
    out = {}
    for i in range(n_series):
        season = np.tile(rng.normal(size=4) * 20, n // 4)
        out[f"s{i}"] = list(1e6 * (i + 1) + 1e4 * (np.cumsum(rng.normal(size=n)) + season))
    return out


def gappy() -> dict:
    out = noisy()
    out["gaps"] = [v if i not in (3, 9, 10, 17) else "gap" for i, v in enumerate(out["s0"])]
    out["ends"] = out["s1"][:20]
    out["starts"] = ["gap"] * 13 + out["s2"][13:]
    out["flat"] = [7.1] * 28
    out["flat first"] = [0.1] * 15 + out["s3"][15:]
    out["two"] = ["gap"] * 10 + [5, 6] + ["gap"] * 15 + [3]
    return out


def refits(p, fit):
    """(fold, uid, ds) -> (step, forecast, actual, status), a forecaster run anew on each fold."""
    out = {}
    for f, a, b in BT.fold_bounds(p, 3, 1):
        qi = F.year(S.DS) * 4 + F.quarter(S.DS) - 1
        train, test = p.filter((qi >= a) & (qi <= b)), p.filter((qi > b) & (qi <= b + 4))
        actual = {(r[0], r[1]): r[2] for r in test.collect() if r[2] is not None}
        for r in fit(train, str(quarter_end(b - 1995 * 4))).collect():
            if (r[S.UID], r[S.DS]) in actual:
                out[f, r[S.UID], r[S.DS]] = (r["step"], r["forecast"], actual[r[S.UID], r[S.DS]], r["status"])
    return out


def same(got, want):
    got = {(r["fold"], r[S.UID], r[S.DS]): (r["step"], r["forecast"], r["actual"], r["status"]) for r in got.collect()}
    assert got.keys() == want.keys() and len(got) > 30
    for k, (step, f, y, status) in want.items():
        assert (got[k][0], got[k][2], got[k][3]) == (step, y, status), k
        assert (got[k][1] is None) == (f is None) and (f is None or np.isclose(got[k][1], f, rtol=1e-7)), (k, got[k], f)


@pytest.mark.parametrize("reg", [0.0, 0.5])
def test_linear_equals_refits(spark, reg):
    p = panel(spark, gappy())
    same(BT.backtest_linear(p, reg=reg), refits(p, lambda t, c: MD.recursive_linear_forecast(t, 4, reg=reg, cutoff=c)[0]))


def test_ar_equals_refits(spark):
    p = panel(spark, gappy())
    same(BT.backtest_ar(p), refits(p, lambda t, c: MD.forecast_ar_per_series(t, 4, cutoff=c)))


def test_blocks_equal_refits(spark):
    p = panel(spark, noisy())  # the same series in each fold, so the same blocks
    same(BT.backtest_blocks(p, block_size=4), refits(p, lambda t, c: MD.forecast_blocks(t, 4, block_size=4, cutoff=c)))


def test_no_later_quarter_is_seen(spark):
    """Values after a fold's validation year change nothing in it."""
    data = noisy(4)
    other = {k: v[:16] + [x * 3 + 1 for x in v[16:]] for k, v in data.items()}
    for run in (BT.backtest_linear, BT.backtest_ar, BT.backtest_blocks):
        a, b = ({(r[S.UID], r[S.DS]): r["forecast"] for r in run(panel(spark, d)).filter("fold = 0").collect()} for d in (data, other))
        assert a.keys() == b.keys() and len(a) == 16
        assert all(np.isclose(a[k], b[k], rtol=1e-8) for k in a), run.__name__


def test_null_values_and_short_panels(spark):
    data = noisy(3)
    data["holes"] = [None if i in (2, 5, 20) else v for i, v in enumerate(data["s0"])]
    data["empty"] = [None] * 28
    p = panel(spark, data)
    for run in (BT.backtest_linear, BT.backtest_ar, BT.backtest_blocks):
        rows = run(p).collect()
        assert {r["fold"] for r in rows} == {0, 1, 2} and all(r["actual"] is not None for r in rows)
        assert not [r for r in rows if r[S.UID] == "empty"]
        assert all(r["forecast"] is not None for r in rows if r["status"] in ("ok", "filled_to_cutoff"))
        short = run(panel(spark, {"a": range(8)}))
        assert short.columns == run(p).columns and short.count() == 0
        assert run(p.limit(0)).count() == 0


def test_folds_are_those_of_the_other_backtests(spark):
    p = panel(spark, noisy(2))
    a = BT.backtest_linear(p).select("fold", S.UID, S.DS, "step", "actual").collect()
    assert sorted(a) == sorted(fc.backtest(p, "naive").select("fold", S.UID, S.DS, "step", "actual").collect())


def test_a_failed_fit_tells_why(spark):
    f = MD.forecast_ar_per_series(panel(spark, {"big": [1e308 * (-1) ** (i // 4) for i in range(16)], "ok": range(16)}), 4).collect()
    assert all(r["error"] and r["forecast"] is None for r in f if r[S.UID] == "big" and r["status"] == "failed")
    assert all(r["error"] is None for r in f if r[S.UID] == "ok")
    assert {r["status"] for r in f if r[S.UID] == "big"} == {"failed"}
