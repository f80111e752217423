"""N-gram language model in an Elias-Fano trie on shared files.

Level 1 holds the words of the training texts: sorted 63-bit hashes and running
sums of their counts (both monotone, both Elias-Fano), so a word's id is its
place and its count is exact.  Level k > 1 holds the n-grams of length k that
occur in them, those that occur once too: a monotone pointer from each context
(node of level k - 1, those without successors too) to its successors, the
successors as word ids relative to their context (made monotone by adding the
last value of the context before), and one byte each for the discounted probability of a
successor and the back-off weight of a context, on a logarithmic scale.

A level is cut into shards of about ``SHARD_TOKENS`` training tokens by ranges
of context ids; a context with more than that gets shards of its own, by ranges
of the next word.  Tasks count n-grams in sorted runs and send them to the
owners of the shards as compressed blocks; the owner merges them and writes the
shard's file to the shared folder.  Scoring tasks map the files into memory.

Probability of a word: absolute discounting, interpolated.  At the bottom the
word's smoothed relative frequency (c + 0.1) / (N + 0.1 (V + 1)); at each level
above, discounted frequency among the context's occurrences plus the back-off
weight (all mass not given to the level's own n-grams) times the lower level.

Nothing is pruned: n-grams and words that occur once are kept and counted like
any other, as what nearly repeats one training text has no others.

Edge cases: a NULL or empty text is one end token; without training texts V and
N are 0 and every probability is 1 / 1 (score 0); repeated rows count as often
as they occur; a NULL doc_id counts as the empty string in the split; extra
columns are ignored; an empty table gives an empty table.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from qpanel.llm.common import Words, bucket_of, chunks, documents, scratch
from qpanel.llm.elias_fano import EliasFano, read_arrays, write_arrays

ORDER = 3
DISCOUNT = 0.75
SHARD_TOKENS = 1 << 22
PIECE = 1 << 22
RUN = 1 << 21                    # n-grams a task counts before it sends them
END = np.int64(0x2545F4914F6CDD1D)   # the end token's place among the hashes
LOG_RANGE = 9.0                  # bytes cover probabilities from 1e-9 to 1


def to_code(p: np.ndarray) -> np.ndarray:
    return np.round(-np.log10(np.maximum(p, 10 ** -LOG_RANGE)) * 255 / LOG_RANGE).astype(np.uint8)


_FROM_CODE = 10 ** (-np.arange(256) * LOG_RANGE / 255)


@dataclass
class Level:
    """What every task knows of a level: its shards and its hot contexts."""
    path: str
    files: list[int]                     # nodes of each shard
    contexts: int                        # nodes of the level below (and the start)
    regular: int                         # shards by ranges of contexts
    hot: np.ndarray                      # contexts with shards of their own, sorted
    hot_first: np.ndarray                # the first of these shards, and one more entry
    hot_backoff: np.ndarray = field(default_factory=lambda: np.zeros(0))
    next_hot: list[tuple[int, int]] = field(default_factory=list)   # nodes above SHARD_TOKENS, counts

    @property
    def offsets(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.files)])


@dataclass
class Model:
    words: Level
    total: int                           # N: training tokens
    distinct: int                        # V
    levels: list[Level]

    def p1(self, count: np.ndarray) -> np.ndarray:
        return (count + 0.1) / (self.total + 0.1 * (self.distinct + 1))


def shard_of(level: Level, context: np.ndarray, word: np.ndarray, words: int) -> np.ndarray:
    out = context * level.regular // max(1, level.contexts)
    if len(level.hot):
        at = np.minimum(np.searchsorted(level.hot, context), len(level.hot) - 1)
        size = (level.hot_first[1:] - level.hot_first[:-1])[at]
        out = np.where(level.hot[at] == context, level.hot_first[at] + word * size // max(1, words), out)
    return out


def uniques(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values, and each value's place among them; only the
    distinct ones are sorted."""
    codes, distinct = pd.factorize(values)
    order = np.argsort(distinct)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return distinct[order], place[codes]


def pair_keys(major: np.ndarray, minor: np.ndarray, base: int) -> np.ndarray | None:
    """Pairs as single numbers in the same order (minor below ``base``), if they fit."""
    if base == 1:
        return major
    return major * base + minor if not len(major) or int(major.max()) < (1 << 63) // base - 1 else None


def lookup_words(level: Level, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Id (-1 if unknown) and training count of each word."""
    unique, back = uniques(hashes)
    ids, count = np.full(len(unique), -1, np.int64), np.zeros(len(unique), np.int64)
    shard = unique >> (63 - (level.regular.bit_length() - 1))
    offsets = level.offsets
    cut = np.searchsorted(shard, np.arange(level.regular + 1))  # sorted, as hashes are
    for s in range(level.regular):
        part = slice(cut[s], cut[s + 1])
        if cut[s] == cut[s + 1] or not level.files[s]:
            continue
        arrays = read_arrays(f"{level.path}/{s}")
        at = EliasFano(arrays, "hash").find(unique[part].astype(np.uint64))
        sums = EliasFano(arrays, "sums")
        hit = at >= 0
        c = np.zeros(len(at), np.int64)
        c[hit] = (sums.get(at[hit] + 1) - sums.get(at[hit])).astype(np.int64)
        ids[part], count[part] = np.where(hit, at + offsets[s], -1), c
    return ids[back], count[back]


def lookup(level: Level, context: np.ndarray, word: np.ndarray, words: int, nodes: bool = True,
           weights: bool = True) -> tuple[np.ndarray | None, np.ndarray | None, np.ndarray | None]:
    """Node (-1 if absent), discounted probability and back-off weight; None for
    what is not asked for (``nodes``, ``weights``).  Each distinct pair is looked
    up once, and each context once; in their order, so that neighbours are read
    one after the other."""
    able = np.flatnonzero(context >= 0)
    base = words + 2
    if level.contexts < (1 << 63) // base:
        pairs, inverse = uniques(context[able] * base + (word[able] + 1))
        c = pairs // base
        w = pairs - c * base - 1
    else:
        pairs, inverse = np.unique(np.stack([context[able], word[able]], 1), axis=0, return_inverse=True)
        c, w = pairs[:, 0], pairs[:, 1]
    own_node, own_p, own_back = np.full(len(c), -1, np.int64), np.zeros(len(c)), np.ones(len(c))
    shard = shard_of(level, c, np.maximum(w, 0), words)
    order = np.argsort(shard, kind="stable") if len(level.hot) else None  # else sorted, as contexts are
    if order is not None:
        c, w, shard = c[order], w[order], shard[order]
    cut = np.searchsorted(shard, np.arange(len(level.files) + 1))
    offsets = level.offsets
    for s in range(len(level.files)):
        if cut[s] == cut[s + 1] or not level.files[s]:
            continue
        part = slice(cut[s], cut[s + 1])
        arrays = read_arrays(f"{level.path}/{s}")
        mine = c[part]
        first = np.flatnonzero(np.append(True, mine[1:] != mine[:-1]))
        run = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(mine))))
        j = mine[first] - arrays["first"][0]
        j[(j < 0) | (j >= len(arrays["backoff"]))] = -1
        got = np.flatnonzero(j >= 0)
        if not len(got):
            continue
        pointers, successors = EliasFano(arrays, "pointers"), EliasFano(arrays, "successors")
        start, end, before, bit = (np.zeros(len(first), np.int64) for _ in range(4))
        start[got], end[got] = pointers.get_two(j[got])
        last = got[start[got] > 0]
        place = successors.place(start[last] - 1)
        before[last], bit[last] = successors.value(place, start[last] - 1), place + 1
        rows = np.flatnonzero((j[run] >= 0) & (w[part] >= 0))
        of = run[rows]
        at = successors.find((before[of] + w[part][rows]).astype(np.uint64), start[of], end[of], bit[of])
        hit = at >= 0
        rows, at = rows[hit] + cut[s], at[hit]
        if order is not None:
            rows = order[rows]
        if nodes:
            own_node[rows] = at + offsets[s]
        if weights:
            weight = np.ones(len(first))
            weight[got] = _FROM_CODE[arrays["backoff"][j[got]]]
            own_back[part if order is None else order[part]] = weight[run]
            own_p[rows] = _FROM_CODE[arrays["code"][at]]
    if len(level.hot):  # the weight of a context with several shards
        all_c = np.empty(len(c), np.int64)
        all_c[order] = c
        at = np.minimum(np.searchsorted(level.hot, all_c), len(level.hot) - 1)
        own_back = np.where(level.hot[at] == all_c, level.hot_backoff[at], own_back)

    def spread(own: np.ndarray, other: float) -> np.ndarray:
        if len(able) == len(word):
            return own[inverse]
        out = np.full(len(word), other, own.dtype)
        out[able] = own[inverse]
        return out

    return (spread(own_node, -1) if nodes else None,
            *((spread(own_p, 0), spread(own_back, 1)) if weights else (None, None)))


def tokens_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of a piece (the words of each document, then its
    end), and each document's first token."""
    words = Words(raw, offsets)
    docs = len(offsets) - 1
    out = np.full(len(words) + docs, END, np.int64)
    out[np.arange(len(words)) + words.doc()] = (words.hashes >> np.uint64(1)).view(np.int64)
    return out, words.first + np.arange(docs + 1)


def shifted(values: np.ndarray, first: np.ndarray, start: int) -> np.ndarray:
    """The value one token before; ``start`` at a document's first token."""
    out = np.empty_like(values)
    out[1:] = values[:-1]
    out[first[:-1]] = start
    return out


def nodes_of(model: Model, raw: np.ndarray, offsets: np.ndarray, scored: bool):
    """First-token indices; per token: word id, count, node of the last level
    (None if ``scored``); the node before a text; for each level p and back
    (None unless ``scored``)."""
    hashes, first = tokens_of(raw, offsets)
    ids, count = lookup_words(model.words, hashes)
    steps, below, start = [], ids, model.distinct  # the start of a text is a context of its own
    for k, level in enumerate(model.levels, 1):
        context = shifted(below, first, start)
        node, p, back = lookup(level, context, ids, model.distinct, not scored or k < len(model.levels), scored)
        steps.append((p, back))
        below, start = node, -1
    return first, ids, count, below, start, steps


def _packed(values: np.ndarray) -> bytes:
    """Sorted or small numbers: byte planes, compressed."""
    a = np.ascontiguousarray(values, np.uint64)
    return pa.compress(a.view(np.uint8).reshape(-1, 8).T.tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    raw = pa.decompress(data, decompressed_size=n * 8, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, n).T).view(np.uint64).ravel()


_BLOCK_NAMES = ["shard", "n", "major", "minor", "counts"]
_BLOCK = "shard long, n long, major binary, minor binary, counts binary"


def _counted(major: np.ndarray, minor: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct pairs and how often each occurs."""
    key = pair_keys(major, minor, base)
    if key is None:
        order = np.lexsort((minor, major))
        major, minor = major[order], minor[order]
        at = np.flatnonzero(np.append(True, (major[1:] != major[:-1]) | (minor[1:] != minor[:-1])))
        return major[at], minor[at], np.diff(np.append(at, len(major)))
    key = np.sort(key)
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    counts, key = np.diff(np.append(at, len(key))), key[at]
    return (key, np.zeros(len(key), np.int64), counts) if base == 1 else ((major := key // base), key - major * base, counts)


def _blocks(major: np.ndarray, minor: np.ndarray, base: int, shard_of_pairs: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> pa.RecordBatch:
    """Counted (major, minor) pairs, one row a shard."""
    major, minor, counts = _counted(major, minor, base)
    shard = shard_of_pairs(major, minor)
    if (shard[1:] < shard[:-1]).any():      # contexts with shards of their own
        order = np.argsort(shard, kind="stable")
        shard, major, minor, counts = shard[order], major[order], minor[order], counts[order]
    cut = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(shard) else np.zeros(0, np.int64)
    ends = np.append(cut[1:], len(shard))
    delta = lambda x: np.diff(x, prepend=x[:1] * 0)
    return pa.record_batch([pa.array(shard[cut]), pa.array(ends - cut),
                            pa.array([_packed(delta(major[a:b])) for a, b in zip(cut, ends, strict=True)], pa.binary()),
                            pa.array([_packed(minor[a:b]) for a, b in zip(cut, ends, strict=True)], pa.binary()),
                            pa.array([_packed(counts[a:b]) for a, b in zip(cut, ends, strict=True)], pa.binary())], _BLOCK_NAMES)


def _merged(table: pa.Table, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct pairs of a shard's blocks with their summed counts,
    joined two runs at a time."""
    runs = []
    for n, a, b, c in zip(*(table[k].to_pylist() for k in ("n", "major", "minor", "counts")), strict=True):
        runs.append(tuple(x.view(np.int64) for x in (np.cumsum(_unpacked(a, n)), _unpacked(b, n), _unpacked(c, n))))
        while len(runs) > 1 and len(runs[-1][0]) * 2 >= len(runs[-2][0]):
            runs.append(_joined(runs.pop(), runs.pop(), base))
    while len(runs) > 1:
        runs.append(_joined(runs.pop(), runs.pop(), base))
    return runs[0]


def _joined(x: tuple, y: tuple, base: int) -> tuple:
    major, minor, count = (np.concatenate(p) for p in zip(x, y, strict=True))
    key = pair_keys(major, minor, base)
    order = np.lexsort((minor, major)) if key is None else np.argsort(key, kind="stable")  # two sorted runs: merged
    major, minor, count = major[order], minor[order], count[order]
    new = np.ones(len(major), bool)
    new[1:] = (major[1:] != major[:-1]) | (minor[1:] != minor[:-1])
    at = np.flatnonzero(new)
    return major[at], minor[at], np.add.reduceat(count, at) if len(at) else count


def count_words(texts: DataFrame, path: str, shards: int) -> tuple[Level, int]:
    """Level 1 of the training ``texts`` (column text), and N."""
    bits = shards.bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for _, _, raw, off in chunks(batch.column("text"), PIECE):
                held.append(tokens_of(raw, off)[0])
                size += len(held[-1])
                if size > RUN:
                    h = np.concatenate(held)
                    yield _blocks(h, h, 1, lambda h, _: h >> (63 - bits))
                    held, size = [], 0
        if size:
            h = np.concatenate(held)
            yield _blocks(h, h, 1, lambda h, _: h >> (63 - bits))

    def own(table: pa.Table) -> pa.Table:
        h, _, count = _merged(table, 1)
        sums = np.concatenate([[0], np.cumsum(count)])
        write_arrays(f"{path}/{table['shard'][0].as_py()}", EliasFano.encode(h, "hash") | EliasFano.encode(sums, "sums"))
        large = np.flatnonzero(count > SHARD_TOKENS)
        return pa.table({"shard": table["shard"][:1], "nodes": [len(h)], "tokens": [int(sums[-1])],
                         "at": [large.tolist()], "count": [count[large].tolist()]}, schema=_owned)

    made = texts.select("text").mapInArrow(run, _BLOCK).groupBy("shard").applyInArrow(
        own, "shard long, nodes long, tokens long, at array<long>, count array<long>").collect()  # a row a shard
    files = [0] * shards
    for r in made:
        files[r["shard"]] = r["nodes"]
    level = Level(path, files, 0, shards, np.zeros(0, np.int64), np.zeros(1, np.int64))
    level.next_hot = sorted((int(level.offsets[r["shard"]]) + a, c) for r in made for a, c in zip(r["at"], r["count"], strict=True))
    return level, sum(r["tokens"] for r in made)


_owned = pa.schema([("shard", pa.int64()), ("nodes", pa.int64()), ("tokens", pa.int64()), ("at", pa.list_(pa.int64())), ("count", pa.list_(pa.int64()))])


def count_ngrams(texts: DataFrame, model: Model, path: str, shards: int, contexts: int,
                 hot: list[tuple[int, int]]) -> Level:
    """The next level above ``model``'s."""
    size = [-(-c // SHARD_TOKENS) for _, c in hot]
    level = Level(path, [0] * (shards + sum(size)), contexts, shards, np.array([n for n, _ in hot], np.int64),
                  shards + np.concatenate([[0], np.cumsum(size)]).astype(np.int64))
    shared = texts.sparkSession.sparkContext.broadcast((model, level))  # shard sizes and hot contexts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, new = shared.value
        held, n = [], 0

        def sent() -> pa.RecordBatch:
            context, word = (np.concatenate(x) for x in zip(*held, strict=True))
            return _blocks(context, word, known.distinct + 1, lambda c, w: shard_of(new, c, w, known.distinct))

        for batch in batches:
            for _, _, raw, off in chunks(batch.column("text"), PIECE):
                first, ids, _, below, start, _ = nodes_of(known, raw, off, False)
                context = shifted(below, first, start)
                able = context >= 0              # all but a text's first tokens
                held.append((context[able], ids[able]))
                n += int(able.sum())
                if n > RUN:
                    yield sent()
                    held, n = [], 0
        if n:
            yield sent()

    def own(table: pa.Table) -> pa.Table:
        known, new = shared.value
        shard = table["shard"][0].as_py()
        context, word, count = _merged(table, known.distinct + 1)
        starts = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
        kept = np.add.reduceat(count - DISCOUNT, starts)
        of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(context))))
        last = word[np.append(starts[1:], len(word)) - 1]
        base = np.concatenate([[0], np.cumsum(last)[:-1]])
        # all occurrences of a context: its own count where its words are split over shards, else the sum over its words
        total = np.full(1, dict(hot)[int(context[0])]) if shard >= new.regular else np.add.reduceat(count, starts)
        place = context[starts] - context[0]             # contexts between them have no successors here
        size = np.zeros(place[-1] + 1, np.int64)
        size[place] = np.diff(np.append(starts, len(word)))
        arrays = {"first": context[:1]} | EliasFano.encode(np.concatenate([[0], np.cumsum(size)]), "pointers")
        arrays |= EliasFano.encode(base[of] + word, "successors")
        arrays["code"] = to_code((count - DISCOUNT) / total[of])
        arrays["backoff"] = np.zeros(len(size), np.uint8)  # a weight of 1
        arrays["backoff"][place] = to_code(1 - kept / total)
        write_arrays(f"{path}/{shard}", arrays)
        large = np.flatnonzero(count > SHARD_TOKENS)
        return pa.table({"shard": [shard], "nodes": [len(word)], "kept": [float(kept[0])],
                         "at": [large.tolist()], "count": [count[large].tolist()]}, schema=_grown)

    made = texts.select("text").mapInArrow(run, _BLOCK).groupBy("shard").applyInArrow(
        own, "shard long, nodes long, kept double, at array<long>, count array<long>").collect()  # a row a shard
    kept = np.zeros(len(hot))
    for r in made:
        level.files[r["shard"]] = r["nodes"]
        if r["shard"] >= shards:
            kept[np.searchsorted(level.hot_first, r["shard"], "right") - 1] += r["kept"]
    level.hot_backoff = 1 - kept / np.array([c for _, c in hot], float) if hot else np.zeros(0)
    level.next_hot = sorted((int(level.offsets[r["shard"]]) + a, c) for r in made for a, c in zip(r["at"], r["count"], strict=True))
    return level


_grown = pa.schema([("shard", pa.int64()), ("nodes", pa.int64()), ("kept", pa.float64()),
                    ("at", pa.list_(pa.int64())), ("count", pa.list_(pa.int64()))])


def train(texts: DataFrame, order: int = ORDER) -> Model:
    """The model of all rows of ``texts`` (column text)."""
    path = scratch(texts.sparkSession, "lm")
    size = texts.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    about = (size[0] or 0) // 6 + (size[1] or 0)                       # tokens, roughly
    shards = 1 << max(0, (about // SHARD_TOKENS).bit_length())
    words, total = count_words(texts, f"{path}/1", shards)
    model = Model(words, total, sum(words.files), [])
    contexts, hot = model.distinct + 1, [*words.next_hot]              # and the start of a text
    if size[1] > SHARD_TOKENS:
        hot.append((model.distinct, size[1]))
    for n in range(2, order + 1):
        level = count_ngrams(texts, model, f"{path}/{n}", shards, contexts, hot)
        model.levels.append(level)
        contexts, hot = sum(level.files), level.next_hot
    return model


def score_texts(docs: DataFrame, model: Model, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # shard sizes and hot contexts
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            parts = []
            for _, _, raw, off in chunks(batch.column("text"), PIECE):
                first, _, count, _, _, steps = nodes_of(m, raw, off, True)
                base = p = m.p1(count) if m.total else np.ones(len(count))
                for discounted, back in steps:
                    p = discounted + back * p
                sums = [np.add.reduceat(x, first[:-1]) for x in (np.log10(base), np.log10(p), (count > 0).astype(np.int64))]
                parts.append((np.diff(first), *sums))
            n, base, full, known = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else [np.zeros(0)] * 4
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(n.astype(np.int64)), pa.array(known.astype(np.int64)),
                                   pa.array(np.full(len(n), m.total, np.int64)), pa.array(base.astype(float)), pa.array(full.astype(float))], names)

    return docs.select("doc_id", "text", held_out.alias("held_out")).mapInArrow(
        run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's log10 probability, learned where crc32(doc_id) mod 10 is not 0."""
    docs = documents(spark, sf_dir)
    held_out = bucket_of("doc_id", 10) == 0
    return score_texts(docs, train(docs.filter(~held_out)), held_out)
