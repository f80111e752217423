"""Exact n-gram Jaccard join with set-relation skipping.

A document's set is its distinct 5-word shingles (64-bit hashes).  Two
documents link when 100 * |A and B| >= 75 * |A or B|, that is when their
symmetric difference d has 7 * d <= |A| + |B|.

1. Equal sets are one set from here on, known by a 64-bit digest (``sid``).
   Each set also gets a parity sketch, four to eight bits a shingle: sketches
   differ in at most d bits, so a larger difference excludes a pair.
2. Shingles are ordered by how common they are (the counts of those that
   repeat within some task, at most ``HOT_TABLE`` of them, as a broadcast
   array; the rest first), then by hash.  Linked sets share a shingle among the
   first n - ceil(3n/4) + 1 of either: those make the index, without lists of
   one.  The order is the same everywhere, so whatever it is no link is lost.
3. First answers: in each block of a list (token and size class) the set that
   shares the largest part of its indexed shingles is the pivot (of edited copies
   that is the one nearest to their source).  Every set is compared with the pivot it shares most lists
   with, unless their sketches exclude it.  Links found give first components.
4. Skipping: a set's further answers start from those of its pivot.  Whatever is
   in its component already is not probed again; lists with one component are
   dropped.  Of the other lists, blocks that position and size rule out are
   skipped, and pairs whose counts of indexed shingles are too small.  A pair compared with one pivot is decided by the two known
   differences where the triangle inequality can; else by the sketches, and by
   the sets themselves if still open.
5. All links together give the components.

Every pair that shares an indexed shingle thus is in one component already or
is decided exactly; nothing is capped.

Texts are read a few times, each time as whole texts in pieces of bounded size;
what is shuffled are digests, index entries and the sets of pairs that survive
the sketches.

Edge cases: a NULL text, or one without words, has the empty set (n_shingles 0)
and links with nothing; with 1 to 4 words the sequence of words is the one
shingle; rows with equal sets link, repeated doc_ids included; a NULL doc_id is
never the least id (NULL if a component has no other); an empty table gives an
empty table; extra columns are ignored.  Rows are known by doc_id and a hash of
their text, so NULL and repeated ids are told apart.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from qpanel.llm.common import Words, chunks, documents, mix, unused, whole_text, written
from qpanel.llm.components import components

SHINGLE = 5
HOT_FROM = 3                 # a shingle counted so often has a rank of its own
HOT_TABLE = 1 << 20          # entries of the broadcast table at most (16 MB)
HOT_SALTS = 64
BROADCAST_IDS = 2_000_000    # ids whose sets are wanted: broadcast up to this many


def shingle_sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every text."""
    for a, b, raw, off in chunks(column):
        words = Words(raw, off)
        h, first = words.hashes, words.first
        m = max(0, len(h) - SHINGLE + 1)
        code = np.zeros(m, np.uint64)
        for k in range(SHINGLE):
            code = code * np.uint64(0x9E3779B97F4A7C15) + h[k:k + m]
        code = mix(code)
        for i in range(b - a):
            lo, hi = int(first[i]), int(first[i + 1])
            if hi - lo >= SHINGLE:
                yield a + i, np.unique(code[lo:hi - SHINGLE + 1])
            else:  # a short sequence: all its words, and how many
                one = np.full(min(1, hi - lo), hi - lo, np.uint64)
                for k in range(lo, hi):
                    one = one * np.uint64(0xC2B2AE3D27D4EB4F) + h[k]
                yield a + i, mix(one)


def digest(s: np.ndarray) -> int:
    """64-bit digest of a set; positive, so that it fits a long."""
    total = mix(s + np.uint64(0x632BE59BD9B4E019)).sum(dtype=np.uint64) ^ np.uint64(len(s))
    return int(mix(np.array([total], np.uint64))[0] >> np.uint64(1))


def sketch(s: np.ndarray) -> bytes:
    """Parity of the shingles in each of 2**k >= 4n cells, one bit a cell."""
    cells = max(64, 1 << (4 * max(1, len(s)) - 1).bit_length())
    odd = np.bincount((s & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def sketch_distance(a: bytes, b: bytes) -> int:
    """At most the symmetric difference of the sets."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) != len(y):  # fold the longer one
        if len(x) > len(y):
            x = x[:len(x) // 2] ^ x[len(x) // 2:]
        else:
            y = y[:len(y) // 2] ^ y[len(y) // 2:]
    return int(np.bitwise_count(x ^ y).sum())


def text_hash() -> Column:
    return F.xxhash64(whole_text())


def row_key(doc_id: str, h: Column) -> Column:
    """Equal for rows with one id (or none) and one text only."""
    return F.concat_ws(":", h, F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.col(doc_id).isNull())


def document_sets(docs: DataFrame) -> DataFrame:
    """doc_id, h, n, sid, sketch of every row (sid and sketch NULL if n is 0)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sid, bits = [], [], []
            for _, s in shingle_sets(batch.column("text")):
                n.append(len(s))
                sid.append(digest(s) if len(s) else None)
                bits.append(sketch(s) if len(s) else None)
            yield pa.record_batch([batch.column("doc_id"), batch.column("h"), pa.array(n, pa.int64()), pa.array(sid, pa.int64()),
                                   pa.array(bits, pa.binary())], ["doc_id", "h", "n", "sid", "sketch"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", text_hash().alias("h")).mapInArrow(run, f"doc_id {kind}, h long, n long, sid long, sketch binary")


def common_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles that repeat often, and their counts: those that occur in
    two sets of one task at least, summed over the tasks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, size = set(), [], 0

        def counted() -> pa.RecordBatch:
            u, c = np.unique(np.concatenate(held), return_counts=True)
            u, c = u[c > 1], c[c > 1]
            return pa.record_batch([pa.array(u.view(np.int64)), pa.array(c)], ["token", "n"])

        for batch in batches:
            for _, s in shingle_sets(batch.column("text")):
                key = digest(s)
                if key in seen:
                    continue
                seen.add(key)
                held.append(s)
                size += len(s)
                if size > 1 << 22:  # 32 MB
                    yield counted()
                    held, size = [], 0
        if held:
            yield counted()

    top = (docs.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
           .filter(F.col("n") >= HOT_FROM).orderBy(F.desc("n"), "token").limit(HOT_TABLE).toArrow())
    tokens = top["token"].to_numpy().view(np.uint64)
    by = np.argsort(tokens)
    return tokens[by], top["n"].to_numpy()[by]


def index_entries(docs: DataFrame, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(token, sid, n, pos, k): the first shingles of each set in the common
    order, without those that only one set has; k: how many of a set are left."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, counts = shared.value
        seen = set()
        names = ["token", "salt", "sid", "n", "pos"]
        for batch in batches:
            cols, size = [[] for _ in names], 0
            for _, s in shingle_sets(batch.column("text")):
                key = digest(s)
                if not len(s) or key in seen:
                    continue
                seen.add(key)
                n = len(s)
                take = n - (3 * n + 3) // 4 + 1
                rank = np.zeros(n, np.int64)
                if len(tokens):
                    at = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
                    rank = np.where(tokens[at] == s, counts[at], 0)
                first = np.argsort(rank, kind="stable")[:take]  # s is sorted by hash
                salt = np.where(rank[first] > 0, 1 + key % HOT_SALTS, 0)
                for col, values in zip(cols, (s[first].view(np.int64), salt, np.full(take, key), np.full(take, n), np.arange(take)), strict=True):
                    col.append(values)
                size += take
                if size > 1 << 17:
                    yield pa.record_batch([pa.array(np.concatenate(c).astype(t)) for c, t in zip(cols, types, strict=True)], names)
                    cols, size = [[] for _ in names], 0
            if size:
                yield pa.record_batch([pa.array(np.concatenate(c).astype(t)) for c, t in zip(cols, types, strict=True)], names)

    types = (np.int64, np.int32, np.int64, np.int32, np.int32)
    rows = docs.select("text").mapInArrow(run, "token long, salt int, sid long, n int, pos int")
    # one list lies in one task, but for common shingles, which are salted and kept
    rows = rows.repartition("token", "salt").sortWithinPartitions("token", "sid")
    rows = written(rows.mapInArrow(_shared_rows, "token long, sid long, n int, pos int"), "jaccard-lists")
    return written(rows.join(rows.groupBy("sid").agg(F.count(F.lit(1)).cast("int").alias("k")), "sid"), "jaccard-index")


def _shared_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by token and sid: those whose token another sid has too
    (or that is salted), each once."""
    names = ["token", "sid", "n", "pos"]
    carry: pa.Table | None = None

    def kept(t: pa.Table) -> pa.Table:
        token, sid, salt = (t[c].to_numpy() for c in ("token", "sid", "salt"))
        fresh = np.ones(len(token), bool)
        fresh[1:] = (token[1:] != token[:-1]) | (sid[1:] != sid[:-1])
        start = np.ones(len(token), bool)
        start[1:] = token[1:] != token[:-1]
        group = np.cumsum(start) - 1
        many = np.bincount(group, weights=fresh) > 1
        return t.filter(pa.array(fresh & (many[group] | (salt > 0)))).select(names)

    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([carry, t]) if carry is not None else t
        token = t["token"].to_numpy()
        cut = int(np.searchsorted(token, token[-1])) if len(token) else 0  # the last list may go on
        carry = t.slice(cut)
        if cut:
            yield from kept(t.slice(0, cut)).combine_chunks().to_batches()
    if carry is not None and len(carry):
        yield from kept(carry).combine_chunks().to_batches()


def size_class(n: str):
    return F.floor(F.log2(n) * 2).cast("int")  # linked sets are at most one class apart


def can_link(n1: str, n2: str, k1: str, k2: str):
    """By size, and by how many indexed shingles two sets can share at most:
    |A and B| is at most those and the rest of the larger set, while 7 times it
    must reach 3 * (n1 + n2)."""
    large = F.greatest(n1, n2)
    rest = F.ceil(large * 3 / 4) - 1
    return (4 * F.least(n1, n2) >= 3 * large) & (7 * (F.least(k1, k2) + rest) >= 3 * (F.col(n1) + F.col(n2)))


def sketched(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (a, b, ...) that the sketches do not exclude, with ``far``, the
    distance of the sketches."""
    one = lambda c: sets.select(F.col("sid").alias(c), F.col("n").alias(f"_n{c}"), F.col("sketch").alias(f"_s{c}"))
    rows = pairs.join(one("a"), "a").join(one("b"), "b")
    names, kinds = pairs.columns, ", ".join(f"{c} {t}" for c, t in pairs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("_sa"), batch.column("_sb")
            n = batch.column("_na").to_numpy() + batch.column("_nb").to_numpy()
            d = np.array([sketch_distance(x[i].as_py(), y[i].as_py()) for i in range(len(batch))], np.int64)
            keep = pa.array(7 * d <= n)
            yield pa.record_batch([*(batch.column(c) for c in names), pa.array(d)], [*names, "far"]).filter(keep)

    return rows.mapInArrow(run, f"{kinds}, far long")


def compared(docs: DataFrame, sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with ``d``, the exact symmetric difference, and
    ``linked``."""
    wanted = pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct()
    holders = written(sets.join(wanted, "sid").select(row_key("holder.id", F.col("holder.h")).alias("key"), "sid"), "jaccard-wanted")
    few = holders.count() <= BROADCAST_IDS
    rows = docs.select("text", row_key("doc_id", text_hash()).alias("key")).join(F.broadcast(holders) if few else holders, "key")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("sid").to_numpy()
            out, size = [], 0
            for i, s in shingle_sets(batch.column("text")):
                if digest(s) == ids[i]:
                    out.append((int(ids[i]), s.tobytes()))
                    size += s.nbytes
                if size > 1 << 23:
                    yield pa.record_batch([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.binary())], ["sid", "shingles"])
                    out, size = [], 0
            if out:
                yield pa.record_batch([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.binary())], ["sid", "shingles"])

    whole = written(rows.select("sid", "text").mapInArrow(read, "sid long, shingles binary").dropDuplicates(["sid"]), "jaccard-sets")
    one = lambda c: whole.select(F.col("sid").alias(c), F.col("shingles").alias(f"_{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, d, ok = batch.column("_a"), batch.column("_b"), [], []
            for i in range(len(batch)):
                p, q = np.frombuffer(x[i].as_py(), np.uint64), np.frombuffer(y[i].as_py(), np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                d.append(len(p) + len(q) - 2 * both)
                ok.append(100 * both >= 75 * (len(p) + len(q) - both))
            yield pa.record_batch([batch.column("a"), batch.column("b"), pa.array(d, pa.int64()), pa.array(ok, pa.bool_())], ["a", "b", "d", "linked"])

    out = pairs.select("a", "b").join(one("a"), "a").join(one("b"), "b").mapInArrow(run, "a long, b long, d long, linked boolean")
    return written(out, "jaccard-compared")


def first_answers(docs: DataFrame, sets: DataFrame, index: DataFrame) -> DataFrame:
    """(a, b, d, linked): every set a with the pivot b of nearest sketch."""
    blocks = index.withColumn("block", size_class("n"))
    whole = F.struct(F.col("k") / (F.col("n") - F.ceil(F.col("n") * 3 / 4) + 1), -F.col("sid"))
    pivots = blocks.groupBy("token", "block").agg(F.max_by(F.struct("sid", "n", "k"), whole).alias("p"))
    pivots = pivots.select("token", "block", F.col("p.sid").alias("b"), F.col("p.n").alias("n2"), F.col("p.k").alias("k2"))
    shared = (blocks.join(pivots, ["token", "block"]).filter("sid <> b").filter(can_link("n", "n2", "k", "k2"))
              .groupBy(F.col("sid").alias("a"), "b").agg(F.count(F.lit(1)).alias("tokens")))
    best = shared.groupBy("a").agg(F.max_by("b", F.struct("tokens", "b")).alias("b"))
    return compared(docs, sets, written(sketched(best, sets).select("a", "b"), "jaccard-pivots"))


def further_pairs(index: DataFrame, known: DataFrame) -> DataFrame:
    """(a, b) of different components that share an indexed shingle, but for
    blocks and pairs that size and position rule out."""
    rows = index.join(known, "sid", "left").select(
        "token", "sid", "n", "pos", "k", F.coalesce("root", "sid").alias("root"), size_class("n").alias("block"))
    mixed = rows.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("token")
    rows = written(rows.join(mixed, "token"), "jaccard-mixed")
    least = F.ceil(F.pow(F.lit(2.0), F.col("to") / 2) - 1e-6)           # sizes in block ``to``
    most = F.floor(F.pow(F.lit(2.0), (F.col("to") + 1) / 2) + 1e-6)
    probes = (rows.select(F.col("token"), F.col("sid").alias("a"), F.col("n").alias("n1"), F.col("pos").alias("p1"),
                          F.col("k").alias("k1"), F.col("root").alias("root1"), F.col("block").alias("own"),
                          F.explode(F.array(F.col("block"), F.col("block") + 1)).alias("to"))
              .filter(7 * F.least(F.col("n1") - F.col("p1"), most) >= 3 * (F.col("n1") + least)))  # skips whole blocks
    lists = rows.select(F.col("token"), F.col("sid").alias("b"), F.col("n").alias("n2"), F.col("pos").alias("p2"),
                        F.col("k").alias("k2"), F.col("root").alias("root2"), F.col("block").alias("to"))
    return (probes.join(lists, ["token", "to"])
            .filter("root1 <> root2 AND (own < to OR a < b)")
            .filter(can_link("n1", "n2", "k1", "k2"))
            .filter(7 * F.least(F.col("n1") - F.col("p1"), F.col("n2") - F.col("p2")) >= 3 * (F.col("n1") + F.col("n2")))
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col("n1") + F.col("n2")).alias("sizes"))
            .distinct())


def decided_by_pivot(pairs: DataFrame, answers: DataFrame) -> DataFrame:
    """``pairs`` with ``low`` and ``high`` bounds of their difference from the
    known ones to a common pivot; (0, NULL) without one."""
    own = answers.select(F.col("a").alias("s"), F.col("b").alias("pivot"), "d")
    pivots = answers.select(F.col("b").alias("s"), F.col("b").alias("pivot"), F.lit(0).cast("long").alias("d")).distinct()
    known = own.join(pivots.select("s"), "s", "left_anti").union(pivots)
    one = lambda c: known.select(F.col("s").alias(c), F.col("pivot").alias(f"p{c}"), F.col("d").alias(f"d{c}"))
    same = F.col("pa") == F.col("pb")
    return pairs.join(one("a"), "a", "left").join(one("b"), "b", "left").select(
        "a", "b", "sizes", F.when(same, F.abs(F.col("da") - F.col("db"))).otherwise(0).alias("low"),
        F.when(same, F.col("da") + F.col("db")).alias("high"))


def set_components(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """document_sets, and (sid, head): of every set the first row of its
    component (none: without a doc_id; these are last), id and h."""
    rows = written(document_sets(docs), "jaccard-rows")
    sets = written(rows.filter("n > 0").groupBy("sid").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "h")).alias("holder"), F.max("n").alias("n"), F.max("sketch").alias("sketch")), "jaccard-distinct")
    index = index_entries(docs, common_shingles(docs))
    answers = first_answers(docs, sets, index)
    links = answers.filter("linked").select("a", "b")
    known = components(links).withColumnRenamed("node", "sid")
    pairs = decided_by_pivot(further_pairs(index, known), answers).filter(7 * F.col("low") <= F.col("sizes"))
    pairs = written(pairs, "jaccard-pairs")
    sure = pairs.filter(7 * F.col("high") <= F.col("sizes")).select("a", "b")
    open_ = pairs.filter("high IS NULL OR 7 * high > sizes").select("a", "b")
    rest = compared(docs, sets, written(sketched(open_, sets).select("a", "b"), "jaccard-open"))
    found = components(links.union(sure).union(rest.filter("linked").select("a", "b")))
    # the first row of each component, and back to the sets
    least = sets.join(found.withColumnRenamed("node", "sid"), "sid", "left").select(
        "sid", "holder", F.coalesce("root", "sid").alias("root"))
    heads = least.groupBy("root").agg(F.min("holder").alias("head"))
    return rows, written(least.join(heads, "root").select("sid", "head"), "jaccard-ids")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    rows, ids = set_components(docs)
    ids = ids.select("sid", F.col("head.id").alias("component_id"))
    full = rows.filter("n > 0").join(ids, "sid").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    empty = rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return full.union(empty)


def one_per_component(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: the one with the least doc_id
    (NULL last), then the least text hash; rows without words stay."""
    name = unused(docs, "_key")
    _, ids = set_components(docs)
    heads = ids.select(row_key("head.id", F.col("head.h")).alias(name)).distinct()
    has_words = whole_text().rlike(r"[^\x20\x09-\x0D]")
    rows = docs.filter(has_words).withColumn(name, row_key("doc_id", text_hash()))
    kept = rows.join(heads, name, "left_semi").dropDuplicates([name]).drop(name)  # of repeated rows one
    return kept.unionByName(docs.filter(~has_words))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shingle count and near-duplicate component."""
    return jaccard_components(documents(spark, sf_dir))
