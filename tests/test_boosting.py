"""The histogram booster against a plain recomputation, sampling, stopping, SQL."""
import duckdb
import numpy as np
import pytest

from qpanel.operators import boosting as B
from qpanel.operators.boosting import Fit, Params, best_splits, train

FEATURES = ["f0", "f1", "f2"]


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(7)
    rows = []
    for i in range(600):
        x = [float(v) for v in np.round(rng.normal(size=3), 3)]
        y = 1.0 + 0.5 * (x[0] > 0.2) + 0.3 * x[1] * (x[0] < -0.3) + 0.05 * float(rng.normal())
        rows.append((i, 1990 + i % 6, *x, float(y)))
    return rows


@pytest.fixture(scope="module")
def frame(spark, table):
    return spark.createDataFrame(table, "id long, year int, f0 double, f1 double, f2 double, y double").repartition(3)


def plain_tree(bins, g, params, usable, n_bins):
    """One leaf at a time, the one that gains most; every split tried in a loop."""
    def shrunk(s):
        return np.sign(s) * max(abs(s) - params.reg_alpha, 0)

    def score(s, n):
        return shrunk(s) ** 2 / (n + params.reg_lambda) if n + params.reg_lambda else 0.0

    def best(rows):
        out = (1e-12, None)
        for f in np.flatnonzero(usable):
            for b in range(n_bins - 1):
                go = bins[rows, f] <= b
                left, right = rows[go], rows[~go]
                if min(len(left), len(right)) < params.min_child:
                    continue
                gain = score(g[left].sum(), len(left)) + score(g[right].sum(), len(right)) - score(g[rows].sum(), len(rows))
                if gain > out[0] + 1e-9:
                    out = (gain, (f, b, left, right))
        return out

    leaves = [(np.arange(len(bins)), None)]
    leaves[0] = (leaves[0][0], best(leaves[0][0]))
    first = True
    while len(leaves) < params.num_leaves:
        k = max(range(len(leaves)), key=lambda i: leaves[i][1][0])
        gain, split = leaves[k][1]
        if split is None:
            break
        leaves[k:k + 1] = [(rows, best(rows)) for rows in split[2:]]
        first = False
    add = np.zeros(len(bins))
    for rows, _ in leaves:
        add[rows] = 0.0 if first else -params.learning_rate * shrunk(g[rows].sum()) / (len(rows) + params.reg_lambda)
    return add


@pytest.mark.parametrize("params", [
    Params(learning_rate=0.3, num_leaves=5, min_child=15), Params(num_leaves=31, reg_lambda=1.0, min_child=10),
    Params(num_leaves=4, reg_alpha=1.0, reg_lambda=1.0, min_child=5, colsample_bytree=0.6), Params(num_leaves=6, subsample=0.6, subsample_freq=2)])
def test_trees_as_grown_one_leaf_at_a_time(spark, frame, table, params):
    rounds = 6  # beyond WRITE_EVERY
    models, told = train(frame, [Fit(0, params, 1994), Fit(1, params)], FEATURES, "y", "year", ["id"], rounds=rounds, patience=99)
    row = {r.id: r.h for r in frame.selectExpr("id", "xxhash64(id) AS h").collect()}
    for model, t, fit in zip(models, told, (1994, None), strict=True):
        x = np.array([r[2:5] for r in table])
        bins = np.stack([np.searchsorted(np.array(e), x[:, f]) for f, e in enumerate(model.edges)], axis=1)
        y, year = np.array([r[5] for r in table]), np.array([r[1] for r in table])
        use = year < fit if fit else np.ones(len(y), bool)
        pred, errors = np.full(len(y), y[use].mean()), []
        for k in range(t["rounds"] if fit is None else rounds):
            errors.append(np.sqrt(np.mean((pred[year == 1994] - y[year == 1994]) ** 2)))
            mine = np.flatnonzero(use & B.drawn(np.array([row[r[0]] for r in table]), params, k))
            tree_bins = bins[mine]
            usable = B.usable_features(3, params, k)
            grown = plain_tree(tree_bins, (pred - y)[mine], params, usable, B.BINS)
            tree = B.Tree() if k >= len(model.trees) else model.trees[k]
            if k < len(model.trees):
                assert np.allclose(np.array(tree.value)[tree.node_of(tree_bins)], grown, atol=1e-9)
                pred = pred + np.array(tree.value)[tree.node_of(bins)]
        got = {r.id: r.prediction for r in B.predict(frame.select("id", *FEATURES), model).collect()}
        assert np.allclose([got[r[0]] for r in table], pred, atol=1e-9)
        if fit:
            assert t["rmse"] == pytest.approx(np.sqrt(np.mean((pred[year == fit] - y[year == fit]) ** 2)))


def test_split_and_leaf_values_by_hand():
    # gradients -4, -2, 3, 5 in bins 0..3; alpha 1, lambda 1
    hist = np.array([[[[-4.0, 1], [-2.0, 1], [3.0, 1], [5.0, 1]]]])
    gain, f, b, left, right = best_splits(hist, Params(reg_alpha=1, reg_lambda=1, min_child=1), np.array([True]))[0]
    # left G=-6, H=2: (6-1)^2/3; right G=8: (8-1)^2/3; parent G=2, H=4: (2-1)^2/5
    assert (f, b) == (0, 1) and gain == pytest.approx(25 / 3 + 49 / 3 - 1 / 5)
    assert (left, right) == (pytest.approx(5 / 3), pytest.approx(-7 / 3))
    assert best_splits(hist, Params(min_child=3), np.array([True])) == [None]
    assert best_splits(hist, Params(min_child=1), np.array([False])) == [None]


def test_early_stopping_keeps_the_best_round(frame):
    params = Params(learning_rate=0.9, num_leaves=31, min_child=2)
    models, told = train(frame, [Fit(0, params, 1995)], FEATURES, "y", "year", ["id"], rounds=12, patience=2)
    longer, all_ = train(frame, [Fit(0, params, 1995)], FEATURES, "y", "year", ["id"], rounds=told[0]["rounds"], patience=99)
    assert told[0]["rounds"] < 12 and len(models[0].trees) == told[0]["rounds"]
    assert all_[0]["rmse"] == pytest.approx(told[0]["rmse"])


def test_levels_equal_the_trees_in_sql(spark, frame, tmp_path):
    model = train(frame, [Fit(0, Params(num_leaves=7, learning_rate=0.3), None)], FEATURES, "y", "year", ["id"], rounds=4)[0][0]
    rows = frame.toPandas()  # noqa: F841  (read by DuckDB)
    want = dict(duckdb.sql(f"SELECT id, {model.sql()} FROM rows").fetchall())
    got = {r.id: r.prediction for r in B.predict(frame, model).collect()}
    assert len(got) == 600 and all(got[i] == pytest.approx(want[i], abs=1e-12) for i in got)


def test_search_gives_every_fold_and_a_mean(frame):
    res = B.search(frame, [Params(num_leaves=3), Params(num_leaves=8)], [1993, 1994, 1995], FEATURES, "y", "year", ["id"], rounds=3, together=4).collect()
    per = {(r.candidate, r.fold): r.rmse for r in res}
    assert len(per) == 8
    for c in (0, 1):
        assert per[c, None] == pytest.approx(np.mean([per[c, y] for y in (1993, 1994, 1995)]))


def test_missing_features_and_empty_rows(spark):
    rows = [(i, 2000, None if i % 3 else float(i), float("nan") if i % 2 else 1.0, float("inf"), None if i == 5 else float(i % 3)) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, year int, f0 double, f1 double, f2 double, y double")
    model, told = train(df, [Fit(0, Params(min_child=3, learning_rate=1.0))], FEATURES, "y", "year", ["id"], rounds=1)
    assert B.predict(df, model[0]).filter("prediction IS NULL").count() == 0
    assert train(df.filter("false"), [Fit(0, Params())], FEATURES, "y", "year", ["id"], rounds=1)[0][0].trees[:0] == []
