"""Boosted regression trees as histogram aggregates.

Many fits are trained together: one for each (candidate, fold).  All share one
binned table; a row holds its features' bins, its label, its period and the
prediction of every fit so far.  A round grows one tree for each fit, level by
level: a job sums gradients and counts by (fit, node, feature, bin) in each
partition, adds them up by fit, and sends the best split of each open node to
the driver.  So a level costs one job whatever the number of fits, no row leaves
its partition, and what reaches the driver is the trees.

* Split: squared error; with G, H the sums of gradients and rows of a node,
  score = max(|G| - reg_alpha, 0)^2 / (H + reg_lambda), gain = score of both
  children less the parent's, at least ``min_child`` rows a child; ties go to
  the first feature and bin.  Leaf: -sign(G) max(|G| - reg_alpha, 0) / (H + reg_lambda).
* Leaf-wise growth: levels grow until no split gains; then the splits are taken
  in order of gain, a node's after its parent's, up to ``num_leaves`` leaves.
  A split depends on its node's rows alone, so this is the tree that grows by
  the best leaf at a time.
* Rows are drawn by a hash of (row, draw) anew every ``subsample_freq`` rounds,
  features by a seeded draw for each tree.
* Early stopping: a fit ends when its validation error has not fallen for
  ``patience`` rounds, and keeps the trees up to the best one.

Folds are by period: a fit trains on the periods before its ``valid`` one and
stops by the error in it, so no fold sees a later quarter.  The table is written
every ``WRITE_EVERY`` rounds with the predictions up to there.  A NULL or
non-finite feature lies in the first bin.
"""
from __future__ import annotations

import heapq
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qpanel.plans.ordered import cut_lineage

BINS = 32
WRITE_EVERY = 5
ROWS_A_TASK = 1 << 17
_HASH = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Params:
    learning_rate: float = 0.1
    num_leaves: int = 31
    colsample_bytree: float = 1.0
    subsample: float = 1.0
    subsample_freq: int = 5
    reg_alpha: float = 0.0
    reg_lambda: float = 0.0
    min_child: int = 20
    max_depth: int = 16
    seed: int = 42


@dataclass
class Fit:
    """One training run: candidate, its parameters, and the validation period
    (trains on earlier ones; None: trains on all and never stops early)."""
    candidate: int
    params: Params
    valid: int | None = None


@dataclass
class Tree:
    """Nodes as lists: feature (-1: leaf), last bin that goes left, children, value."""
    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def add(self, value: float) -> int:
        for items, x in ((self.feature, -1), (self.bin, 0), (self.left, 0), (self.right, 0), (self.value, value), (self.gain, 0.0)):
            items.append(x)
        return len(self.feature) - 1

    def node_of(self, bins: np.ndarray) -> np.ndarray:
        node, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        if len(self.feature) == 1:
            return node
        feature, at, left, right = (np.array(x) for x in (self.feature, self.bin, self.left, self.right))
        while True:
            f = feature[node]
            inner = f >= 0
            if not inner.any():
                return node
            node = np.where(inner, np.where(bins[rows, np.maximum(f, 0)] > at[node], right[node], left[node]), node)

    def leafwise(self, num_leaves: int, rate: float) -> Tree:
        """The splits of most gain, parents first, and values times ``rate``."""
        out, open_ = Tree(value=[self.value[0] * rate]), []
        push = lambda node, new: heapq.heappush(open_, (-self.gain[node], node, new)) if self.feature[node] >= 0 else None
        push(0, 0)
        leaves = 1
        while open_ and leaves < num_leaves:
            _, node, new = heapq.heappop(open_)
            out.feature[new], out.bin[new], out.gain[new] = self.feature[node], self.bin[node], self.gain[node]
            for child, side in ((self.left[node], out.left), (self.right[node], out.right)):
                side[new] = out.add(self.value[child] * rate)
                push(child, side[new])
            leaves += 1
        return out

    def sql(self, names: list[str], edges: list[list[float]], node: int = 0) -> str:
        """The tree as a CASE expression over the features."""
        if self.feature[node] < 0:
            return f"CAST({float(self.value[node])!r} AS DOUBLE)"
        f, b = self.feature[node], self.bin[node]
        return (f"CASE WHEN {names[f]} > CAST({edges[f][b]!r} AS DOUBLE) THEN {self.sql(names, edges, self.right[node])} "
                f"ELSE {self.sql(names, edges, self.left[node])} END")


@dataclass
class Model:
    features: list[str]
    edges: list[list[float]]
    base: float
    trees: list[Tree]

    def sql(self) -> str:
        return " + ".join([f"CAST({float(self.base)!r} AS DOUBLE)", *[f"({t.sql(self.features, self.edges)})" for t in self.trees]])


def bin_edges(frame: DataFrame, features: list[str], bins: int = BINS) -> list[list[float]]:
    """Upper edges of all bins but the last, by quantiles: bins - 1 numbers a feature."""
    at = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    row = frame.agg(*[F.percentile_approx(F.when(F.abs(F.col(c)) < float("inf"), F.col(c)), at, 10_000).alias(c) for c in features]).first()
    return [sorted(set(row[c] or [])) for c in features]


def binned(frame: DataFrame, features: list[str], edges: list[list[float]], keep: list[str]) -> DataFrame:
    """``keep`` columns and ``bins``: a byte for each feature."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = []
            for f, edge in zip(features, edges, strict=True):
                x = batch.column(f).to_numpy(zero_copy_only=False).astype(float)
                cols.append(np.searchsorted(np.array(edge, float), np.where(np.isfinite(x), x, -np.inf)).astype(np.uint8))
            raw = [r.tobytes() for r in np.stack(cols, axis=1)] if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(raw, pa.binary())], names=[*keep, "bins"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.select(*keep).schema)
    return frame.select(*keep, *[F.col(c).cast("double").alias(c) for c in features]).mapInArrow(cut, f"{fields}, bins binary")


def best_splits(hist: np.ndarray, params: Params, usable: np.ndarray) -> list[tuple[float, int, int, float, float] | None]:
    """For each node of (node, feature, bin, [G, H]): gain, feature, bin and the
    values of both children, or None."""
    def shrunk(g):
        return np.sign(g) * np.maximum(np.abs(g) - params.reg_alpha, 0)

    def score(g, h):
        return shrunk(g) ** 2 / np.maximum(h + params.reg_lambda, 1e-12)

    left = np.cumsum(hist, axis=2)[:, :, :-1]
    whole = hist[:, :1].sum(axis=2)[:, :, None]
    right = whole - left
    gain = score(left[..., 0], left[..., 1]) + score(right[..., 0], right[..., 1]) - score(whole[..., 0], whole[..., 1])
    fit = (left[..., 1] >= params.min_child) & (right[..., 1] >= params.min_child) & usable[None, :, None]
    gain = np.where(fit, gain, -np.inf)
    out: list[tuple[float, int, int, float, float] | None] = []
    for i, g in enumerate(gain):
        f, b = np.unravel_index(int(np.argmax(g)), g.shape)
        if not g[f, b] > 1e-12:
            out.append(None)
            continue
        value = [float(-shrunk(s[i, f, b, 0]) / max(s[i, f, b, 1] + params.reg_lambda, 1e-12)) for s in (left, right)]
        out.append((float(g[f, b]), int(f), int(b), *value))
    return out


def usable_features(n: int, params: Params, round_: int) -> np.ndarray:
    """The features that a tree may split on: at least one."""
    out = np.zeros(n, bool)
    count = max(1, int(round(n * params.colsample_bytree)))
    out[np.random.default_rng([params.seed, round_]).choice(n, count, replace=False)] = True
    return out


def drawn(row: np.ndarray, params: Params, round_: int) -> np.ndarray:
    """The rows that a round trains on, by a hash of the row."""
    if params.subsample >= 1:
        return np.ones(len(row), bool)
    draw = round_ // max(1, params.subsample_freq)
    h = (row.view(np.uint64) ^ np.uint64(params.seed * 1_000_003 + draw)) * _HASH
    h = (h ^ (h >> np.uint64(32))) * _HASH
    return (h >> np.uint64(11)) / float(1 << 53) < params.subsample


_PART = "fit int, nodes binary, hist binary, sums binary"
_SPLIT = "fit int, node int, feature int, bin int, gain double, left double, right double, sse double, level_sse double, n long"


def _level(rows: DataFrame, fits: list[Fit], live: list[int], pending: list[list[Tree]], growing: dict[int, Tree], open_: dict[int, list[int]],
           round_: int, features: int, bins: int) -> DataFrame:
    """Best split of every open node, and each fit's validation errors before this round."""
    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hist = {i: np.zeros((len(open_[i]), features, bins, 2)) for i in live}
        sums = {i: np.zeros(3) for i in live}
        for batch in batches:
            if not batch.num_rows:
                continue
            b, y, period, row, pred = _arrays(batch, features, len(fits))
            pred = _applied(pred, b, pending)
            for i in live:
                fit = fits[i]
                if fit.valid is not None:
                    v = period == fit.valid
                    sums[i] += (np.sum((pred[v, i] - y[v]) ** 2), np.sum((np.expm1(pred[v, i]) - np.expm1(y[v])) ** 2), v.sum())
                use = np.flatnonzero((period < fit.valid if fit.valid is not None else True) & drawn(row, fit.params, round_))
                place = np.full(len(growing[i].feature), -1)
                place[open_[i]] = np.arange(len(open_[i]))
                at = place[growing[i].node_of(b[use])]
                use, at = use[at >= 0], at[at >= 0]
                g = pred[use, i] - y[use]
                cell = ((at[:, None] * features + np.arange(features)) * bins + b[use]).ravel()
                size = len(open_[i]) * features * bins
                hist[i][..., 0] += np.bincount(cell, np.repeat(g, features), size).reshape(hist[i].shape[:3])
                hist[i][..., 1] += np.bincount(cell, minlength=size).reshape(hist[i].shape[:3])
        yield pa.RecordBatch.from_arrays(
            [pa.array(live, pa.int32()), pa.array([np.array(open_[i], np.int64).tobytes() for i in live], pa.binary()),
             pa.array([hist[i].tobytes() for i in live], pa.binary()), pa.array([sums[i].tobytes() for i in live], pa.binary())],
            names=["fit", "nodes", "hist", "sums"])

    def best(table: pa.Table) -> pa.Table:
        i = table["fit"][0].as_py()
        nodes = np.frombuffer(table["nodes"][0].as_py(), np.int64)
        hist = sum(np.frombuffer(h.as_py()).reshape(len(nodes), features, bins, 2) for h in table["hist"])
        sse, level_sse, n = sum(np.frombuffer(s.as_py()) for s in table["sums"])
        found = best_splits(hist, fits[i].params, usable_features(features, fits[i].params, round_))
        rows = [(i, int(node), s[1], s[2], s[0], s[3], s[4], sse, level_sse, int(n)) if s else (i, int(node), -1, 0, 0.0, 0.0, 0.0, sse, level_sse, int(n))
                for node, s in zip(nodes, found, strict=True)]
        kinds = [pa.int32()] * 4 + [pa.float64()] * 5 + [pa.int64()]
        names = [c.split()[0] for c in _SPLIT.split(", ")]
        return pa.table({c: pa.array([r[k] for r in rows], t) for k, (c, t) in enumerate(zip(names, kinds, strict=True))})

    return rows.mapInArrow(parts, _PART).groupBy("fit").applyInArrow(best, _SPLIT)


def _arrays(batch: pa.RecordBatch, features: int, fits: int):
    b = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(-1, features)
    pred = np.frombuffer(b"".join(batch.column("pred").to_pylist())).reshape(-1, fits)
    return b, batch.column("label").to_numpy(), batch.column("period").to_numpy(), batch.column("row").to_numpy(), pred


def _applied(pred: np.ndarray, bins: np.ndarray, pending: list[list[Tree]]) -> np.ndarray:
    if not any(pending):
        return pred
    pred = pred.copy()
    for i, trees in enumerate(pending):
        for tree in trees:
            pred[:, i] += np.array(tree.value)[tree.node_of(bins)]
    return pred


def train(frame: DataFrame, fits: list[Fit], features: list[str], label: str, period: str, key: list[str], rounds: int = 500, patience: int = 20,
          bins: int = BINS) -> tuple[list[Model], list[dict]]:
    """All ``fits`` together.  The models, and for each its candidate, validation
    period, rounds kept and validation RMSE of labels and of levels (expm1)."""
    if not 2 <= bins <= 256:
        raise ValueError("a bin is a byte")
    edges = bin_edges(frame, features, bins)
    rows = frame.select(F.xxhash64(*key).alias("row"), F.col(label).cast("double").alias("label"), F.col(period).cast("int").alias("period"), *features)
    rows = rows.filter("label IS NOT NULL AND period IS NOT NULL")
    totals = {r["period"]: (r["s"], r["n"]) for r in rows.groupBy("period").agg(F.sum("label").alias("s"), F.count("label").alias("n")).collect()}  # a row a period
    base = []
    for fit in fits:
        mine = [v for p, v in totals.items() if fit.valid is None or p < fit.valid]
        base.append(sum(s for s, _ in mine) / max(1, sum(n for _, n in mine)))
    start = np.array(base).tobytes()
    tasks = max(1, -(-sum(n for _, n in totals.values()) // ROWS_A_TASK))
    rows = binned(rows, features, edges, ["row", "label", "period"]).withColumn("pred", F.lit(start))
    rows = cut_lineage(rows.coalesce(tasks) if rows.rdd.getNumPartitions() > tasks else rows)

    kept: list[list[Tree]] = [[] for _ in fits]
    pending: list[list[Tree]] = [[] for _ in fits]
    best = [{"rounds": 0, "rmse": float("inf"), "level_rmse": None} for _ in fits]
    live = list(range(len(fits)))
    for round_ in range(rounds + 1):
        growing, open_ = {i: Tree() for i in live}, {i: [0] for i in live}
        depth = 0
        while open_:
            found = _level(rows, fits, sorted(open_), pending, growing, open_, round_, len(features), bins).collect()  # a row an open node
            if depth == 0:
                for r in found:
                    i, b = r["fit"], best[r["fit"]]
                    rmse = (r["sse"] / r["n"]) ** 0.5 if r["n"] else None
                    if fits[i].valid is None or rmse is None or rmse < b["rmse"] - 1e-12:
                        best[i] = {"rounds": round_, "rmse": rmse, "level_rmse": (r["level_sse"] / r["n"]) ** 0.5 if r["n"] else None}
                    if round_ == rounds or round_ - best[i]["rounds"] >= patience:
                        live.remove(i)
            open_ = {}
            for r in found:
                i, tree = r["fit"], growing[r["fit"]]
                if i not in live or r["feature"] < 0:
                    continue
                node = r["node"]
                tree.feature[node], tree.bin[node], tree.gain[node] = r["feature"], r["bin"], r["gain"]
                tree.left[node], tree.right[node] = tree.add(r["left"]), tree.add(r["right"])
                if depth + 1 < fits[i].params.max_depth:
                    open_.setdefault(i, []).extend([tree.left[node], tree.right[node]])
            depth += 1
        if not live:
            break
        for i in live:
            tree = growing[i].leafwise(fits[i].params.num_leaves, fits[i].params.learning_rate)
            kept[i].append(tree)
            pending[i].append(tree)
        if (round_ + 1) % WRITE_EVERY == 0:
            rows, pending = _written(rows, pending, len(features), len(fits)), [[] for _ in fits]
    models = [Model(features, edges, b, trees[:s["rounds"]]) for b, trees, s in zip(base, kept, best, strict=True)]
    return models, [{"candidate": f.candidate, "valid": f.valid, **s} for f, s in zip(fits, best, strict=True)]


def _written(rows: DataFrame, pending: list[list[Tree]], features: int, fits: int) -> DataFrame:
    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, *_, pred = _arrays(batch, features, fits)
            pred = [p.tobytes() for p in _applied(pred, b, pending)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("row", "label", "period", "bins")], pa.array(pred, pa.binary())],
                                             names=["row", "label", "period", "bins", "pred"])

    return cut_lineage(rows.select("row", "label", "period", "bins", "pred").mapInArrow(
        move, "row bigint, label double, period int, bins binary, pred binary"))


def predict(frame: DataFrame, model: Model, out: str = "prediction") -> DataFrame:
    """``frame`` with the model's label in ``out`` (F11 takes expm1 of it)."""
    if out in frame.columns:
        raise ValueError(f"{out} is there already")
    names = frame.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [np.searchsorted(np.array(e, float), np.nan_to_num(batch.column(f).to_numpy(zero_copy_only=False).astype(float), nan=-np.inf))
                    for f, e in zip(model.features, model.edges, strict=True)]
            pred = np.full((batch.num_rows, 1), model.base)
            if batch.num_rows:
                pred = _applied(pred, np.stack(cols, axis=1), [model.trees])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred[:, 0])], names=[*names, out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema)
    return frame.mapInArrow(run, f"{fields}, `{out}` double")


def search(frame: DataFrame, candidates: list[Params], years: list[int], features: list[str], label: str, period: str, key: list[str],
           rounds: int = 500, patience: int = 20, together: int = 32, parallelism: int = 8) -> DataFrame:
    """M3-M5: candidate, fold, rounds, rmse (levels); and a row without fold for
    each candidate's mean.  ``together`` fits share a table and its jobs; the jobs
    of ``parallelism`` such tables are submitted at a time."""
    fits = [Fit(c, p, y) for c, p in enumerate(candidates) for y in years]

    def some(a: int) -> list[dict]:
        return train(frame, fits[a:a + together], features, label, period, key, rounds, patience)[1]

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        told = [t for part in pool.map(some, range(0, len(fits), together)) for t in part]
    rows = [(t["candidate"], t["valid"], t["rounds"], t["level_rmse"]) for t in told]
    res = frame.sparkSession.createDataFrame(rows, "candidate int, fold int, rounds int, rmse double")
    return res.groupingSets([["candidate", "fold"], ["candidate"]], "candidate", "fold").agg(
        F.max("rounds").alias("rounds"), F.avg("rmse").alias("rmse"))
