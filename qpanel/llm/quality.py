"""Quality classifier: naive Bayes support vectors.

Indicators: which n-grams a text holds.  The n-grams are runs of 1, 2 and 3
UTF-8 bytes as written, runs of 1 and 2 word shapes (letters by case, digits
and other characters, repeats collapsed), and runs of ``REPEATS`` words by
which of them equal the first, hashed to ``BUCKETS``.

1. Class log-count ratios: for each bucket, in how many training texts of
   either class it occurs, counted by Spark over every training row.
2. Each indicator is scaled by its ratio, and a linear hinge-loss model is
   fitted by dual coordinate descent on at most ``SAMPLE`` texts a class, the
   first by a hash of doc_id.
3. Platt's logistic curve on a fifth kept out of the fit, weighted to the class
   shares of all training rows, turns margins into scores from 0 to 1.

Labels meet texts by a broadcast of (doc_id, label) when there are at most
``BROADCAST_LABELS`` of them, else by a shuffle join.

Edge cases: a NULL text is empty and scored like one; conflicting labels of a
document count by majority (a tie is 0); NULL labels or ids are not learned
from; with no label, or one class only, every score is the share of label 1
(0.5 without labels); repeated rows get equal scores; extra columns are
ignored; an empty table gives an empty table.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from qpanel.llm.common import Words, bucket_of, chunks, documents, grams, mix, slices, table

BUCKETS = 1 << 17
SAMPLE = 2000
REPEATS = 4
BROADCAST_LABELS = 2_000_000
ALPHA = 1.0
COST = 0.05
EPOCHS = 15
PIECE = 1 << 18

# classes of bytes for word shapes: lower, upper, digit; any other byte stands for itself
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[0x61:0x7B] = _SHAPE[0x80:] = 1
_SHAPE[0x41:0x5B] = 2
_SHAPE[0x30:0x3A] = 3


def _grams(raw: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind: 32-bit hashes of the n-grams, and each document's first."""
    parts = []
    for n in (1, 2, 3):
        h, at = grams(raw, offsets, n)
        parts.append((h, np.searchsorted(at, offsets)))
    data = _SHAPE[raw]
    fresh = np.ones(len(raw), bool)
    fresh[1:] = data[1:] != data[:-1]
    fresh[offsets[:-1][offsets[:-1] < len(raw)]] = True
    at = np.flatnonzero(fresh)
    shapes = Words(data[at], np.searchsorted(at, offsets))  # white space is kept as it is
    h = shapes.hashes
    parts.append(((h >> np.uint64(32)).astype(np.uint32), shapes.first))
    words = Words(raw, offsets).hashes
    for n, values in ((2, h), (REPEATS, words)):
        m = max(0, len(h) - n + 1)
        code = np.full(m, n, np.uint64)
        for k in range(1, n):
            code = code * np.uint64(3) + (values[k:k + m] == values[:m] if n == REPEATS else values[k:k + m] ^ values[:m] * np.uint64(5))
        ok = np.ones(m, bool)
        for k in range(1, n):  # not across documents
            cut = shapes.first[1:-1] - k
            ok[cut[(cut >= 0) & (cut < m)]] = False
        at = np.flatnonzero(ok)
        parts.append(((mix(code[at]) >> np.uint64(32)).astype(np.uint32), np.searchsorted(at, shapes.first)))
    return parts


def indicators(raw: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """The distinct n-gram buckets of each document of a piece."""
    seen = np.zeros(BUCKETS, bool)
    if len(offsets) == 2:  # one text, in slices if it is very long
        for lo, hi in slices(raw, 8 * PIECE, REPEATS):
            for h, _ in _grams(raw[lo:hi], np.array([0, hi - lo])):
                seen[h & np.uint32(BUCKETS - 1)] = True
        yield np.flatnonzero(seen)
        return
    parts = _grams(raw, offsets)
    for i in range(len(offsets) - 1):
        for h, first in parts:
            seen[h[first[i]:first[i + 1]] & np.uint32(BUCKETS - 1)] = True
        ids = np.flatnonzero(seen)
        seen[ids] = False
        yield ids


def labelled(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, text, y) of the documents that have a label."""
    one = (labels.filter(f"doc_id IS NOT NULL AND {label} IS NOT NULL").groupBy("doc_id")
           .agg((F.avg(label) > 0.5).cast("int").alias("y")))
    one = F.broadcast(one) if labels.count() <= BROADCAST_LABELS else one
    return docs.select("doc_id", "text").join(one, "doc_id")


def class_counts(rows: DataFrame) -> np.ndarray:
    """BUCKETS x 2 counts of texts with the n-gram, and last the texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((BUCKETS + 1, 2), np.int64)
        for batch in batches:
            y = batch.column("y").to_numpy()
            for a, _, raw, off in chunks(batch.column("text"), PIECE):
                for i, ids in enumerate(indicators(raw, off)):
                    count[ids, y[a + i]] += 1
                    count[BUCKETS, y[a + i]] += 1
        at = np.flatnonzero(count.any(axis=1))
        yield pa.record_batch([pa.array(at), pa.array(count[at, 0]), pa.array(count[at, 1])], ["id", "n0", "n1"])
    sums = (rows.select("text", "y").mapInArrow(run, "id long, n0 long, n1 long")
            .groupBy("id").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow())  # BUCKETS + 1 rows at most
    out = np.zeros((BUCKETS + 1, 2), np.int64)
    out[sums["id"].to_numpy(), 0] = sums["n0"].to_numpy()
    out[sums["id"].to_numpy(), 1] = sums["n1"].to_numpy()
    return out


def sampled(rows: DataFrame, size: int) -> list[tuple[int, np.ndarray]]:
    """(y, buckets) of at most ``size`` texts a class, first by a hash of
    doc_id, in that order.  Of rows with one id the text with the least hash
    counts, so repeated ids cannot grow the sample."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [batch.column(c) for c in names[:-1]]
            for a, b, raw, off in chunks(batch.column("text"), PIECE):
                ids = [x.astype(np.int32) for x in indicators(raw, off)]
                yield pa.record_batch([*[c.slice(a, b - a) for c in kept], pa.array(ids, pa.list_(pa.int32()))], names)
    names = ["doc_id", "y", "_key", "_text", "ids"]
    keyed = rows.select(F.col("doc_id").cast("string"), "y", F.xxhash64(F.col("doc_id").cast("string")).alias("_key"),
                        F.xxhash64("text").alias("_text"), "text")
    ids = None
    for y in (0, 1):
        one = keyed.filter(F.col("y") == y).select("doc_id", "_key").distinct().orderBy("_key", "doc_id").limit(size).select("doc_id")
        ids = one if ids is None else ids.union(one)
    got = (keyed.join(F.broadcast(ids), "doc_id", "left_semi").select(*names[:-1], "text")
           .mapInArrow(run, "doc_id string, y int, _key long, _text long, ids array<int>")
           .groupBy("_key", "doc_id").agg(F.min(F.struct("_text", "y", "ids")).alias("one"))
           .select("_key", "doc_id", "one.y", "one.ids").toArrow().sort_by([("_key", "ascending"), ("doc_id", "ascending")]))
    return list(zip(got["y"].to_pylist(), got["ids"].to_numpy(), strict=True))


def descend(xs: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: float = COST,
            epochs: int = EPOCHS, seed: int = 3) -> np.ndarray:
    """Weights of the hinge-loss model: dual coordinate descent on ratio-scaled
    indicators; y is -1 or 1."""
    rng = np.random.default_rng(seed)
    w, alpha = np.zeros(len(ratio)), np.zeros(len(xs))
    scaled = [ratio[x] for x in xs]
    norm = np.array([max(1e-9, float(s @ s)) for s in scaled])
    for _ in range(epochs):
        for i in rng.permutation(len(xs)):
            gradient = y[i] * float(w[xs[i]] @ scaled[i]) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), cost)
            if new != alpha[i]:
                w[xs[i]] += (new - alpha[i]) * y[i] * scaled[i]
                alpha[i] = new
    return w


def platt(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(-(a * margin + b))) by Newton steps."""
    scale = float(np.abs(margin).mean()) or 1.0
    x = np.stack([margin / scale, np.ones(len(margin))], 1)
    target = np.where(y > 0, 1 - 1 / (2 + (y > 0).sum()), 1 / (2 + (y <= 0).sum()))
    theta = np.array([1.0, 0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        g = x.T @ (weight * (p - target)) + 1e-3 * theta
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        theta -= step * min(1.0, 2 / max(1e-12, float(np.abs(step).max())))
    return float(theta[0] / scale), float(theta[1])


@dataclass
class Model:
    weights: np.ndarray     # of an n-gram's presence: SVM weight times ratio
    a: float
    b: float

    def score(self, margin: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.a * margin + self.b, -30, 30))))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model:
    rows = labelled(docs, labels, label)
    counts = class_counts(rows)
    n0, n1 = counts[BUCKETS]
    if not n0 or not n1:
        share = n1 / (n0 + n1) if n0 + n1 else 0.5
        return Model(np.zeros(BUCKETS), 0.0, float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    p, q = counts[:BUCKETS, 1] + ALPHA, counts[:BUCKETS, 0] + ALPHA
    ratio = np.log((p / (n1 + 2 * ALPHA)) / (q / (n0 + 2 * ALPHA)))
    data = sampled(rows, sample)
    y = np.array([1 if v else -1 for v, _ in data])
    xs = [np.asarray(x) for _, x in data]
    order = np.random.default_rng(5).permutation(len(xs))
    held, used = (order[:len(xs) // 5], order[len(xs) // 5:]) if len(xs) >= 40 else (order, order)
    w = descend([xs[i] for i in used], y[used], ratio) * ratio
    margin = np.array([float(w[xs[i]].sum()) for i in held])
    share = np.where(y[held] > 0, n1 / max(1, (y[held] > 0).sum()), n0 / max(1, (y[held] < 0).sum()))
    a, b = platt(margin, y[held], share / share.sum() * len(held))
    return Model(w, a, b)


def score(docs: DataFrame, model: Model, keep: list[str], only_good: bool = False) -> DataFrame:
    """``keep`` columns of every row with score and predicted; ``only_good``
    returns just the rows predicted 1, without those two columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    used = keep if "text" in keep else [*keep, "text"]
    keep = [c for c in keep if only_good or c not in ("score", "predicted")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            out = np.zeros(len(batch))
            for a, _, raw, off in chunks(batch.column("text"), PIECE):
                for i, ids in enumerate(indicators(raw, off)):
                    out[a + i] = m.score(float(m.weights[ids].sum()))
            cols = [batch.column(c) for c in keep]
            if only_good:
                yield pa.record_batch(cols, keep).filter(pa.array(out >= 0.5))
            else:
                yield pa.record_batch([*cols, pa.array(out), pa.array((out >= 0.5).astype(np.int32))], [*keep, "score", "predicted"])

    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    kinds += [] if only_good else ["score double", "predicted int"]
    return docs.select(*used).mapInArrow(run, ", ".join(kinds))


def learned(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of the registered query: learns where crc32(doc_id) mod 3 is not 1."""
    return train(docs.filter(bucket_of("doc_id", 3) != 1), labels.filter(bucket_of("doc_id", 3) != 1))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score, learned where crc32(doc_id) mod 3 is not 1."""
    docs = documents(spark, sf_dir)
    held: Column = bucket_of("doc_id", 3) == 1
    model = learned(docs, table(spark, sf_dir, "labels"))
    return score(docs.select("doc_id", "text", held.alias("held_out")), model, ["doc_id", "held_out"])
