import numpy as np
import pytest
from pyspark.sql import functions as F

from qpanel.llm import hard_negatives
from qpanel.llm.hard_negatives import mine

SCHEMA = "vec_id long, label long, embedding array<double>"


def plain(rows, every, positives=5, negatives=10):
    fit = [(i, lab, [int(np.floor(256 * x)) for x in v]) for i, lab, v in rows
           if lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    most = (1 << 63) - 2
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    for k, (aid, lab, a) in enumerate(fit):
        if aid is None or aid % every:
            continue
        scored = [(max(-most, min(most, sum(x * y for x, y in zip(a, v, strict=False)))), i, other, j) for j, (i, other, v) in enumerate(fit)]
        best = sorted([s for s in scored if s[2] == lab and s[3] != k], key=order)[:positives]
        for p, pid, *_ in best:
            inside = sorted([s for s in scored if s[2] != lab and 30 * p <= 100 * s[0] <= 90 * p], key=order)[:negatives]
            out += [(aid, pid, n + 1, i, p, s) for n, (s, i, *_) in enumerate(inside)]
    return sorted(out, key=str)


def vectors(n=400, dims=6, seed=5, spread=0.2):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(8, dims))
    which = draw.integers(0, 8, n)
    x = centres[which] + spread * draw.normal(size=(n, dims))
    rows = [(int(i), int(c % 5 if draw.random() < 0.8 else draw.integers(0, 5)), [float(y) for y in v]) for i, c, v in zip(range(n), which, x, strict=True)]
    return rows + rows[:30] + [(None, 1, rows[0][2]), (None, 2, rows[0][2]), (10, None, rows[0][2]), (20, 1, None), (30, 1, [float("nan")] * dims),
                               (40, 2, [None, *rows[1][2][1:]]), (50, 3, [float("-inf")] + rows[1][2][1:]), (60, 3, rows[1][2][:2]), (-70, 4, []),
                               (80, 0, [0.0] * dims), (90, 0, [-y for y in rows[0][2]])]


@pytest.mark.parametrize("block,group,cut", [(256, 2048, 64), (16, 7, 3)])
def test_as_by_brute_force(spark, monkeypatch, block, group, cut):
    for name, value in (("BLOCK", block), ("GROUP", group), ("SLICE", cut)):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = vectors()
    table = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("z") for c in ("row", "g", "a", "block", "score", "kind", "n")})
    got = [tuple(r) for r in mine(table, every=10).collect()]
    assert sorted(got, key=str) == plain(rows, 10)


def test_zone_maps_leave_blocks_out(spark, monkeypatch):
    """In clustered vectors most blocks are not chosen, and none that matters is left out."""
    monkeypatch.setattr(hard_negatives, "BLOCK", 16)
    chosen = []
    real = hard_negatives.choose_blocks

    def watched(blocks, groups, *rest):
        pairs = real(blocks, groups, *rest)
        bits = sum(bin(int.from_bytes(r.need, "big")).count("1") for r in pairs.collect())
        chosen.append(bits / (blocks.count() * sum(len(r.row) for r in groups.select("row").collect())))
        return pairs

    monkeypatch.setattr(hard_negatives, "choose_blocks", watched)
    rows = vectors(1500, 4, spread=0.05)
    assert sorted([tuple(r) for r in mine(spark.createDataFrame(rows, SCHEMA), every=20).collect()], key=str) == plain(rows, 20)
    assert chosen[0] < 0.3 and chosen[1] < 0.6


def test_large_numbers_and_ties(spark):
    rows = [(10 * i, i % 2, [1e14 * (i % 3 + 1), 3.0]) for i in range(12)]
    assert sorted([tuple(r) for r in mine(spark.createDataFrame(rows, SCHEMA), every=10).collect()], key=str) == plain(rows, 10)


def test_empty_and_unlabelled(spark):
    assert mine(spark.createDataFrame([], SCHEMA)).collect() == []
    assert mine(spark.createDataFrame([(100, None, [1.0]), (200, 1, None)], SCHEMA)).collect() == []
    assert mine(spark.createDataFrame([(100, 1, []), (200, 1, []), (300, 2, [])], SCHEMA), every=100).count() == 2  # 300 has no positive


@pytest.mark.parametrize("axes,bits", [(2, 4), (3, 3)])
def test_curve_goes_from_neighbour_to_neighbour(axes, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes, indexing="ij"), -1).reshape(-1, axes)
    place = hard_negatives.hilbert(grid, bits)
    assert sorted(place) == list(range(len(grid)))
    walk = grid[np.argsort(place)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()
