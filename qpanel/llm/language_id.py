"""Language identification by averaged hashed subword embeddings.

A text's subwords are the runs of 2, 3 and 4 UTF-8 bytes (A-Z lower-cased,
white space and ASCII punctuation as one word edge, digits as one class) with
no word edge inside.  Each is hashed to one of ``BUCKETS`` embeddings; the
text is their mean; a linear softmax gives the languages.  Embeddings and
softmax are trained together by stochastic gradient descent in numpy, half of
the steps on small random draws from a text's subwords, so short texts work.

Calibration: a quarter of the training sample is kept out of the fit; on it a
temperature is fitted (least log loss), and the rejection threshold is the
smallest confidence above which accuracy is at least ``ACCURACY``.

Training reads a sample of at most ``SAMPLE`` labelled rows of each language,
the first by a hash of doc_id, so a rare language is learned too.  Prediction covers every row and whole texts, in pieces of
bounded size.

Edge cases: lang_pred is ``und`` with score 0 and accepted false for a NULL
text, one without a letter, or when nothing could be learned (an empty table
or no labels); NULL labels are not learned from; NULL doc_id is passed
through; repeated rows get equal results; extra columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from qpanel.llm.common import bucket_of, chunks, documents, grams, slices, sums_by_doc

BUCKETS, DIM = 1 << 15, 16
SIZES = (2, 3, 4)
SAMPLE = 1000               # rows a language
BROADCAST_LANGS = 10_000
EPOCHS, RATE = 12, 1.0
ACCURACY = 0.99
PIECE = 1 << 18

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[0x41:0x5B] += 32
_CLASS[:0x30] = 0x20
_CLASS[0x30:0x3A] = 0x30
_CLASS[0x3A:0x41] = _CLASS[0x5B:0x61] = _CLASS[0x7B:0x80] = 0x20
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True


def subwords(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size: bucket of each subword, and each document's first one."""
    data = _CLASS[raw]
    edge = data == 0x20
    for n in SIZES:
        h, at = grams(data, offsets, n)
        inner = np.zeros(len(at), bool)
        for k in range(1, n - 1):
            inner |= edge[at + k]
        keep = ~inner
        at = at[keep]
        yield (h[keep] & np.uint32(BUCKETS - 1)).astype(np.int64), np.searchsorted(at, offsets)


def has_letter(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    ascii_ = np.concatenate([[0], np.cumsum(_LETTER[raw])])
    out = ascii_[offsets[1:]] > ascii_[offsets[:-1]]
    for i in np.flatnonzero(~out):  # only other scripts left to look for
        out[i] = any(c.isalpha() for c in raw[offsets[i]:offsets[i + 1]].tobytes().decode("utf-8", "replace"))
    return out


def bags(docs: DataFrame) -> DataFrame:
    """(lang, ids, counts): the subword counts of whole texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = batch.column("lang")
            for a, b, raw, off in chunks(batch.column("text"), PIECE):
                parts = list(subwords(raw, off))
                ids, counts = [], []
                for i in range(b - a):
                    one = np.concatenate([x[f[i]:f[i + 1]] for x, f in parts])
                    u, c = np.unique(one, return_counts=True)
                    ids.append(u.astype(np.int32))
                    counts.append(c.astype(np.int32))
                yield pa.record_batch([lang.slice(a, b - a), pa.array(ids, pa.list_(pa.int32())),
                                       pa.array(counts, pa.list_(pa.int32()))], ["lang", "ids", "counts"])
    return docs.select("lang", "text").mapInArrow(run, "lang string, ids array<int>, counts array<int>")


@dataclass
class Model:
    langs: list[str]
    scores: np.ndarray      # BUCKETS x languages: embedding times softmax weights
    bias: np.ndarray
    temperature: float
    threshold: float

    def logits(self, sums: np.ndarray, n: np.ndarray) -> np.ndarray:
        return sums / np.maximum(n, 1)[:, None] + self.bias

    def confidence(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def fit(sample: list[tuple[str, np.ndarray, np.ndarray]], seed: int = 7) -> Model | None:
    """Stochastic gradient descent over (language, subword ids, counts)."""
    sample = [(y, np.asarray(i), np.asarray(c, float)) for y, i, c in sample if y is not None and len(i)]
    langs = sorted({y for y, _, _ in sample})
    if not langs:
        return None
    rng = np.random.default_rng(seed)
    index = {y: k for k, y in enumerate(langs)}
    order = rng.permutation(len(sample))
    cut = len(sample) // 4 if len(sample) >= 40 else 0
    held, used = order[:cut], order[cut:]
    emb = rng.normal(0, 0.1, (BUCKETS, DIM))
    out = rng.normal(0, 0.1, (DIM, len(langs)))
    bias = np.zeros(len(langs))
    steps, done = EPOCHS * len(used), 0
    for epoch in range(EPOCHS):
        for k in rng.permutation(used):
            y, ids, counts = sample[k]
            if epoch % 2:  # a short text: a few of its subwords
                size = int(rng.integers(3, 60))
                ids = ids[np.searchsorted(np.cumsum(counts), rng.random(size) * counts.sum(), "right").clip(max=len(ids) - 1)]
                ids, counts = np.unique(ids, return_counts=True)
            share = counts / counts.sum()
            v = share @ emb[ids]
            z = v @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[index[y]] -= 1
            rate = RATE * (1 - done / steps)
            back = out @ p
            out -= rate * np.outer(v, p)
            bias -= 0.02 * rate * p
            emb[ids] -= rate * np.outer(share, back)
            done += 1
    model = Model(langs, (emb @ out).astype(np.float32), bias, 1.0, 0.0)
    check = held if cut else used
    sums = np.array([sample[k][2] @ model.scores[sample[k][1]] for k in check])
    logits = model.logits(sums, np.array([sample[k][2].sum() for k in check]))
    truth = np.array([index[sample[k][0]] for k in check])
    loss = []
    temperatures = np.geomspace(0.05, 8, 60)
    for t in temperatures:
        model.temperature = t
        loss.append(-np.log(np.maximum(model.confidence(logits)[np.arange(len(check)), truth], 1e-12)).mean())
    model.temperature = float(temperatures[int(np.argmin(loss))])
    p = model.confidence(logits)
    best, right = p.max(axis=1), p.argmax(axis=1) == truth
    by = np.argsort(-best)
    good = np.cumsum(right[by]) / np.arange(1, len(by) + 1) >= ACCURACY
    model.threshold = float(best[by][np.flatnonzero(good)[-1]]) if good.any() else 1.0
    return model


def train(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Fits on at most ``sample`` rows a language, first by hash; repeated rows
    (same id and text) count once."""
    rows = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("string").alias("doc_id"), "lang", "text")
    rows = rows.withColumns({"_id": F.coalesce("doc_id", F.lit("")), "_text": F.xxhash64("text")})
    first = Window.partitionBy("lang").orderBy(F.xxhash64("_id"), "_id", "_text")
    keys = ["lang", "_id", "_text"]
    # the first by hash lie below four times their expected share, so a language's window sees few rows
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("_rows"))
    if sizes.count() <= BROADCAST_LANGS:    # else a shuffled join
        sizes = F.broadcast(sizes)
    share = F.shiftrightunsigned(F.xxhash64("_id"), 1).cast("double") / float(1 << 63)
    near = rows.select(*keys).join(sizes, "lang").filter(share * F.col("_rows") < 4 * sample + 100)
    picked = near.select(*keys).distinct().withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= sample).select(*keys)
    rows = rows.join(F.broadcast(picked), keys, "left_semi").groupBy(*keys).agg(F.first("text").alias("text")).orderBy(*keys)
    rows = bags(rows).toArrow()
    return fit(list(zip(rows["lang"].to_pylist(), rows["ids"].to_numpy(), rows["counts"].to_numpy(), strict=True)))


def predict(docs: DataFrame, model: Model | None, held_out: Column) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            n = len(batch)
            names, score, accepted = ["und"] * n, np.zeros(n), np.zeros(n, bool)
            for a, b, raw, off in chunks(batch.column("text"), PIECE):
                if m is None:
                    break
                sums, count = np.zeros((b - a, len(m.langs))), np.zeros(b - a)
                for lo, hi in slices(raw, 8 * PIECE):  # more than one for a very long text only
                    for ids, first in subwords(raw[lo:hi], np.clip(off, lo, hi) - lo):
                        sums += sums_by_doc(m.scores[ids], first)
                        count += np.diff(first)
                p = m.confidence(m.logits(sums, count))
                letter = has_letter(raw, off)
                best = p.argmax(axis=1)
                for i in np.flatnonzero(letter):
                    names[a + i] = m.langs[best[i]]
                score[a:b] = np.where(letter, p.max(axis=1), 0.0)
                accepted[a:b] = letter & (score[a:b] >= m.threshold)
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(names), pa.array(score),
                                   pa.array(accepted)], ["doc_id", "held_out", "lang_pred", "score", "accepted"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", held_out.alias("held_out")).mapInArrow(
        run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, accepted boolean")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned where crc32(doc_id) mod 4 is not 2."""
    docs = documents(spark, sf_dir)
    held_out = bucket_of("doc_id", 4) == 2
    return predict(docs, train(docs.filter(~held_out)), held_out)
