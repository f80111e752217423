"""Forecasters, grouped maps and global-order statistics against brute
force on small fixtures."""
import datetime as dt
import math

import numpy as np
from pyspark.sql import functions as F

from qpanel import schema as S
from qpanel.operators import forecast as fc
from qpanel.operators import impute as I
from qpanel.operators import models as MD
from qpanel.operators.knn import impute_knn
from qpanel.plans.ordered import ecdf_distances, exact_quantile, global_rank


def qend(y, q):
    return dt.date(y, q * 3, 31 if q in (1, 4) else 30)


def panel(spark, series: dict):
    rows = []
    for uid, vals in series.items():
        for i, v in enumerate(vals):
            rows.append((uid, qend(1995 + i // 4, i % 4 + 1), None if v is None else float(v)))
    return spark.createDataFrame(rows, "unique_id string, ds date, y double")


def test_seasonal_naive_in_place_equals_generic(spark):
    rng = np.random.default_rng(1)
    p = panel(spark, {f"s{i}": list(rng.integers(1, 100, 28)) for i in range(6)})
    train = p.filter(F.col(S.DS) <= dt.date(1999, 12, 31))
    test = p.filter(F.col(S.DS) > dt.date(1999, 12, 31))
    for model, gen in [("seasonal_naive", fc.seasonal_naive(train, "1999-12-31", 8, level=False)),
                       ("naive", fc.naive(train, "1999-12-31", 8, level=False)),
                       ("seasonal_window_average", fc.seasonal_window_average(train, "1999-12-31", 8))]:
        a = fc.join_actuals(gen, test).select(S.UID, S.DS, "step", "forecast", "actual")
        b = fc.score_in_place(p, model, "1999-12-31", 8)
        assert sorted(a.collect()) == sorted(b.collect()), model


def test_backtest_has_three_folds(spark):
    p = panel(spark, {"a": list(range(1, 29)), "b": list(range(28, 0, -1))})
    b = fc.backtest(p, "seasonal_naive", 3, 1)
    assert sorted(r[0] for r in b.select("fold").distinct().collect()) == [0, 1, 2]
    # season of the last training year, one year back
    r = b.filter((F.col("fold") == 0) & (F.col(S.UID) == "a")).orderBy(S.DS).collect()
    assert [x["forecast"] for x in r] == [9.0, 10.0, 11.0, 12.0]
    assert [x["actual"] for x in r] == [13.0, 14.0, 15.0, 16.0]


def test_poly_fill_recovers_cubic(spark):
    vals = [0.5 * i ** 3 - 2 * i ** 2 + i + 3 for i in range(12)]
    gappy = [v if i not in (3, 7, 8) else None for i, v in enumerate(vals)]
    out = I.impute_poly(panel(spark, {"c": gappy})).orderBy(S.DS).collect()
    assert np.allclose([r[S.Y] for r in out], vals, atol=1e-6)


def test_linear_fill_positions_and_ends(spark):
    out = I.impute_linear(panel(spark, {"l": [None, 2, None, None, 8, None]})).orderBy(S.DS).collect()
    assert [r[S.Y] for r in out] == [2.0, 2.0, 4.0, 6.0, 8.0, 8.0]


def test_ar_recovers_seasonal_series(spark):
    base = [10, 20, 30, 40]
    vals = [base[i % 4] + 2 * (i // 4) for i in range(20)]   # lag-4 difference = 2
    f = MD.forecast_ar_per_series(panel(spark, {"ar": vals, "short": [1, 2, 3]}), 4)
    got = {(r[S.UID], r["step"]): (r["forecast"], r["status"]) for r in f.collect()}
    assert got[("short", 1)] == (None, "too_short")
    assert np.allclose([got[("ar", s)][0] for s in range(1, 5)], [20, 30, 40, 50], atol=1e-6)


def test_recursive_linear_expr_matches_loop(spark):
    b0, b = 0.5, [0.1, -0.2, 0.3, 0.6]
    hist = [1.0, 2.0, 3.0, 4.0, 5.0]
    df = spark.createDataFrame([(hist,)], "h array<double>")
    got = df.select(MD.recursive_linear_expr(F.col("h"), b0, b, 6).alias("p")).first()["p"]
    w, exp = hist[-4:], []
    for _ in range(6):
        nxt = b0 + sum(c * x for c, x in zip(b, w))
        exp.append(nxt)
        w = w[1:] + [nxt]
    assert np.allclose(got, exp)


def test_stub_forecaster_200_rows(spark):
    """Fixture I: 200 series with values 1..6, a stub model predicting 99:
    6 forecasts each, all 99, actuals 1..6."""
    df = spark.createDataFrame([(f"A_B_F{i}", [float(v) for v in range(1, 7)]) for i in range(200)],
                               "unique_id string, actual array<double>")
    out = df.select(S.UID, "actual",
                    MD.recursive_linear_expr(F.array(*[F.lit(0.0)] * 4), 99.0, [0.0] * 4, 6).alias("forecast"))
    rows = out.collect()
    assert len(rows) == 200
    assert all(r["forecast"] == [99.0] * 6 and r["actual"] == [1.0, 2, 3, 4, 5, 6] for r in rows)


def _knn_brute(mat, k):
    """NumPy re-statement of the k-NN fill on a series x quarter matrix."""
    mu = np.nanmean(mat, axis=1, keepdims=True)
    sd = np.nanstd(mat, axis=1, keepdims=True)
    sd[(sd == 0) | np.isnan(sd)] = 1.0
    z = (mat - mu) / sd
    n, t = z.shape
    out = mat.copy()
    colmean = np.nanmean(z, axis=0)
    for i in range(n):
        for q in np.where(np.isnan(z[i]))[0]:
            cands = []
            for j in range(n):
                if j == i or np.isnan(z[j, q]):
                    continue
                both = ~np.isnan(z[i]) & ~np.isnan(z[j])
                if both.sum() == 0:
                    continue
                d = math.sqrt(t / both.sum() * np.sum((z[i, both] - z[j, both]) ** 2))
                cands.append((d, j))
            cands.sort()
            top = cands[:k]
            if not top:
                zf = colmean[q]
            elif any(d == 0 for d, _ in top):
                zf = np.mean([z[j, q] for d, j in top if d == 0])
            else:
                zf = sum(z[j, q] / d for d, j in top) / sum(1 / d for d, _ in top)
            out[i, q] = zf * sd[i, 0] + mu[i, 0]
    return out


def test_knn_matches_brute_force_across_tiles(spark):
    rng = np.random.default_rng(7)
    n, t = 23, 12
    mat = rng.normal(100, 20, (n, t))
    mat[rng.random((n, t)) < 0.2] = np.nan
    ids = [f"s{i:02d}" for i in range(n)]
    p = panel(spark, {ids[i]: [None if np.isnan(v) else v for v in mat[i]] for i in range(n)})
    got = impute_knn(p, k=3, block=5).collect()         # 5 blocks -> 25 tiles
    exp = _knn_brute(mat, 3)
    pos = {(r[S.UID], r[S.DS]): r[S.Y] for r in got}
    for i in range(n):
        for q in range(t):
            assert abs(pos[(ids[i], qend(1995 + q // 4, q % 4 + 1))] - exp[i, q]) < 1e-9


def test_knn_tiles_without_gaps(spark):
    """Gaps in one block only, then none at all: tiles without a gap have no
    candidates to return."""
    mat = np.random.default_rng(8).normal(100, 20, (6, 4))
    full = mat.copy()
    mat[0, 1] = mat[1, 3] = np.nan
    for m in (mat, full):
        p = panel(spark, {f"s{i}": [None if np.isnan(v) else v for v in m[i]] for i in range(6)})
        pos = {(r[S.UID], r[S.DS]): r[S.Y] for r in impute_knn(p, k=2, block=2).collect()}
        exp = _knn_brute(m, 2)
        assert len(pos) == 24
        assert all(abs(pos[(f"s{i}", qend(1995, q + 1))] - exp[i, q]) < 1e-9 for i in range(6) for q in range(4))


def test_knn_uniform_tiles_without_gaps(spark):
    """One gap: the mean of the donors' z values there, on the series' own scale."""
    rows = {"a": [1, 3, None], "b": [2, 4, 9], "c": [5, 1, 3], "d": [7, 7, 1]}
    donors = [(v[2] - np.mean(v)) / np.std(v) for k, v in rows.items() if k != "a"]
    got = impute_knn(panel(spark, rows), k=3, block=2, weights="uniform").collect()
    pos = {(r[S.UID], r[S.DS]): r[S.Y] for r in got}
    assert len(pos) == 12
    assert abs(pos[("a", qend(1995, 3))] - (np.mean(donors) + 2)) < 1e-9
    assert [pos[("d", qend(1995, q))] for q in (1, 2, 3)] == [7, 7, 1]


def test_knn_unscaled_tiles_without_gaps(spark):
    """One gap, values as they are: the donors' distances are 1 : 2 : 4."""
    rows = {"a": [0, 0, None], "b": [3, 4, 10], "c": [6, 8, 40], "d": [12, 16, 80]}
    got = impute_knn(panel(spark, rows), k=5, block=2, scale=False).collect()
    pos = {(r[S.UID], r[S.DS]): r[S.Y] for r in got}
    assert len(pos) == 12
    assert abs(pos[("a", qend(1995, 3))] - (4 * 10 + 2 * 40 + 80) / 7) < 1e-9
    assert [pos[("d", qend(1995, q))] for q in (1, 2, 3)] == [12, 16, 80]


def test_exact_quantile_and_ecdf(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(0, 1, 500).round(2)
    b = rng.normal(0.3, 1.2, 400).round(2)
    da = spark.createDataFrame([(float(x),) for x in a], "v double")
    db = spark.createDataFrame([(float(x),) for x in b], "v double")
    for q in (0.0, 0.5, 0.99, 1.0):
        assert abs(exact_quantile(da, "v", q) - np.quantile(a, q)) < 1e-12
    r = ecdf_distances(da, db, "v").first()
    xs = np.union1d(a, b)
    f1 = np.searchsorted(np.sort(a), xs, side="right") / len(a)
    f2 = np.searchsorted(np.sort(b), xs, side="right") / len(b)
    assert abs(r["ks"] - np.max(np.abs(f1 - f2))) < 1e-12
    assert abs(r["wasserstein"] - np.sum(np.abs(f1 - f2)[:-1] * np.diff(xs))) < 1e-9


def test_global_rank_dense(spark):
    df = spark.createDataFrame([(k,) for k in ["b", "a", "c", "a", "d"]], "k string")
    assert sorted(tuple(r) for r in global_rank(df, "k").collect()) == \
        [("a", 1), ("b", 2), ("c", 3), ("d", 4)]


def test_map_series_carries_series_across_batches(spark):
    import pandas as pd

    from qpanel.plans.series_map import map_series
    rows = [(f"s{i % 7}", j, float(j)) for i in range(7) for j in range(i + 3)]
    df = spark.createDataFrame(rows, "k string, t int, v double")

    def fn(pdf):
        assert pdf["k"].nunique() == 1 and list(pdf["t"]) == sorted(pdf["t"])
        return pd.DataFrame({"k": [pdf["k"].iloc[0]], "n": [len(pdf)], "tot": [pdf["v"].sum()]})
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        out = {r["k"]: (r["n"], r["tot"]) for r in
               map_series(df, "k", ["t"], fn, "k string, n long, tot double", partitions=2).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert out == {f"s{i}": (i + 3, float(sum(range(i + 3)))) for i in range(7)}


def test_imputation_invariants(spark):
    """No NULL left, known cells unchanged, same result at 1 and 7 partitions."""
    rng = np.random.default_rng(11)
    series = {}
    for i in range(12):
        v = list(rng.normal(50, 10, 16).round(3))
        for j in rng.choice(16, 5, replace=False):
            v[j] = None
        series[f"s{i:02d}"] = v
    series["empty"] = [None] * 16
    dense = panel(spark, series)
    known = {(r[S.UID], r[S.DS]): r[S.Y] for r in dense.collect() if r[S.Y] is not None}
    for name in ["zeros", "ffill", "linear", "poly", "knn_3"]:
        fn = I.METHODS[name]
        a = fn(dense.repartition(1)).collect()
        b = fn(dense.repartition(7)).collect()
        assert sorted(a) == sorted(b), name
        got = {(r[S.UID], r[S.DS]): r[S.Y] for r in a}
        assert all(abs(got[k] - v) < 1e-9 for k, v in known.items()), name
        nonempty = [v for (u, _), v in got.items() if u != "empty"]
        assert all(v is not None for v in nonempty), name


def test_panel_same_without_broadcasts(spark):
    """The shuffled path of the panel join gives the same panel."""
    from qpanel.plans import panels as P
    sf = "/root/testdata/sf0.001"
    a = sorted(P.coarse_panel(spark, sf).collect())
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        b = sorted(P.coarse_panel(spark, sf).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert [(r.unique_id, r.ds) for r in a] == [(r.unique_id, r.ds) for r in b]
    assert all(abs(x.y - z.y) < 1e-6 for x, z in zip(a, b))


def test_grid_and_random_search_spaces():
    from qpanel.operators import trees as TR
    space = {"a": [1, 2, 3], "b": [1, 2, 3], "c": [1, 2, 3], "d": [1, 2, 3], "e": [1],
             "f": [1, 2], "g": [1, 2]}
    grid = TR.param_grid(space)
    assert len(grid) == 324 and len({tuple(sorted(g.items())) for g in grid}) == 324
    draw = TR.random_candidates(space, 50, seed=42)
    assert len(draw) == 50 and draw == TR.random_candidates(space, 50, seed=42)


def test_fixture_c_one_output_per_method(spark):
    """Fixture C: 5 series x 4 quarters with gaps; every method writes one
    output (partitioned by method) and every score is >= 0."""
    import os
    import tempfile

    from qpanel.sources.files import write_table
    vals = {"X_Y_Z1": [1.0, None, 3.0, 4.0], "X_Y_Z2": [2.0, 4.0, None, 8.0],
            "X_Y_Z3": [None, 5.0, 6.0, 7.0], "X_Y_Z4": [3.0, 3.0, 3.0, None],
            "X_Y_Z5": [1.0, 2.0, 3.0, 4.0]}
    dense = panel(spark, vals)
    methods = ["zeros", "ffill", "linear", "poly", "knn_3"]
    outs = None
    for m in methods:
        o = I.METHODS[m](dense).withColumn("method", F.lit(m))
        outs = o if outs is None else outs.unionByName(o)
    d = tempfile.mkdtemp(prefix="qpanel-imp-", dir="/tmp")
    write_table(outs, f"{d}/imputed", partition_by=["method"])
    assert sorted(x for x in os.listdir(f"{d}/imputed") if x.startswith("method=")) == \
        sorted(f"method={m}" for m in methods)
    masked = I.mask_cells(dense, key=S.UID)
    scores = I.compare_imputers(masked, tuple(methods)).collect()
    assert sorted(r["method"] for r in scores) == sorted(methods)
    for r in scores:
        for c in ("mae", "rmse", "ks", "wasserstein"):
            assert r[c] is None or r[c] >= 0


def test_reference_space_mapping():
    from qpanel.operators import trees as TR
    c = TR.to_gbt_params({"learning_rate": 0.05, "num_leaves": 63, "colsample_bytree": 0.8,
                          "subsample": 0.6, "subsample_freq": 5, "reg_alpha": 1, "reg_lambda": 0})
    assert c == {"stepSize": 0.05, "maxDepth": 6, "featureSubsetStrategy": "0.8",
                 "subsamplingRate": 0.6, "maxIter": 20}
    cands = TR.reference_candidates(5)
    assert len(cands) == 5 and len({tuple(sorted(x.items())) for x in cands}) == 5


def test_recursive_linear_warm_starts(spark):
    """A series growing by a constant step is forecast exactly from either
    warm start; test_head forecasts only the quarters after its window."""
    vals = {f"s{i}": [float(10 * i + 3 * t) for t in range(28)] for i in range(1, 6)}
    p = panel(spark, vals)
    train = p.filter(F.col(S.DS) <= dt.date(1999, 12, 31))
    test = p.filter(F.col(S.DS) > dt.date(1999, 12, 31))
    for mode, n_out in [("train_tail", 8), ("test_head", 4)]:
        f, _ = MD.recursive_linear_forecast(train, 8, n_steps=4, warm_start=mode, test=test)
        j = fc.join_actuals(f, test).collect()
        assert len(j) == 5 * n_out, mode
        assert all(abs(r["forecast"] - r["actual"]) < 1e-6 * max(1.0, abs(r["actual"])) for r in j), mode


def test_gbt_fit_predict_and_recursion(spark):
    from qpanel.operators import features as FE
    from qpanel.operators import trees as TR
    # seasonal series: the level repeats every 4 quarters, so lag_4 predicts it
    base = [100.0, 200.0, 150.0, 300.0]
    vals = {f"s{i}": [base[t % 4] * (1 + i) for t in range(28)] for i in range(6)}
    prep = FE.prepare_log(panel(spark, vals))
    fr = TR.model_frame(prep)
    fit = fr.filter(F.year(S.DS) <= 1999).withColumn("is_valid", F.year(S.DS) == 1999)
    model = TR.fit_gbt(fit, {"maxIter": 30, "maxDepth": 4, "stepSize": 0.3}, valid_flag="is_valid")
    pred = TR.predict_levels(model, fr.filter(F.year(S.DS) == 2000)).collect()
    rel = [abs(r["forecast"] - math.expm1(r["y_log"])) / math.expm1(r["y_log"]) for r in pred]
    assert len(pred) == 24 and max(rel) < 0.25
    rec = TR.recursive_forecast(model, prep.filter(F.year(S.DS) <= 1999), 4).collect()
    assert len(rec) == 6 * 4
    assert sorted({str(r[S.DS]) for r in rec}) == ["2000-03-31", "2000-06-30", "2000-09-30", "2000-12-31"]
    assert all(r["forecast"] > 0 for r in rec)


def test_ragged_series_share_the_cutoff(spark):
    """A series that ends early, a short one and a full one: the same dates for
    the same steps, a status for each."""
    from qpanel.operators import models as MD
    import datetime as dt
    ends = [dt.date(2010 + i // 4, 3 * (i % 4) + 3, [31, 30, 30, 31][i % 4]) for i in range(24)]
    rows = [("full", d, 10.0 + i) for i, d in enumerate(ends)] + [("early", d, 5.0 + i % 4) for i, d in enumerate(ends[:20])] \
        + [("short", d, 1.0) for d in ends[-3:]]
    train = spark.createDataFrame(rows, "unique_id string, ds date, y double")
    for f in (MD.forecast_ar_per_series(train, 4), MD.recursive_linear_forecast(train, 4)[0], MD.forecast_blocks(train, 4, block_size=3)):
        got = {(r.unique_id, r.step): r for r in f.collect()}
        assert len(got) == 12
        assert {r.ds for (u, s), r in got.items() if s == 1} == {dt.date(2016, 3, 31)}
        assert {r.ds for (u, s), r in got.items() if s == 4} == {dt.date(2016, 12, 31)}
        assert all(got["full", s].forecast is not None and got["full", s].status == "ok" for s in range(1, 5))
    ar = {r.unique_id: r.status for r in MD.forecast_ar_per_series(train, 4).collect()}
    assert ar == {"full": "ok", "early": "ok", "short": "too_short"}


def test_a_narrow_calendar_raises_and_a_new_quarter_shows(spark):
    import datetime as dt

    import pytest

    from qpanel.operators import impute as I
    rows = [("a", dt.date(2010, 3, 31), 1.0), ("a", dt.date(2010, 9, 30), 2.0), ("b", dt.date(2011, 3, 31), 3.0)]
    df = spark.createDataFrame(rows, "unique_id string, ds date, y double")
    with pytest.raises(ValueError):
        I.densify(df, start="2010-06-30", end="2011-03-31")
    assert I.densify(df).count() == 10
    more = df.unionByName(spark.createDataFrame([("b", dt.date(2011, 6, 30), 4.0)], df.schema))
    assert I.densify(more).count() == 12
