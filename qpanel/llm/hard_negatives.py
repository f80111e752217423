"""Hard-negative mining over Hilbert-ordered blocks with zone maps.

Vectors are integers (floor of ``UNIT`` times each component); a score is their
inner product.  For each anchor and each of its ``positives`` best rows of the
same label, the answers are the first ``negatives`` rows of another label whose
score lies in a window: low/100 to high/100 of the positive's score.

1. Order.  Directions of most variance and cell edges come from a sample of
   ``SAMPLE`` rows; every row's cell on a Hilbert curve over ``AXES`` of these
   directions is its place.  Rows are range-partitioned by place and written as
   Parquet blocks of ``BLOCK`` rows, each with the least and greatest value of
   every dimension (its zone map) and its labels.
2. Seeds.  An anchor reads the block it lies in; the k-th score it finds in a
   window is a floor for that window.
3. Choice.  Interval arithmetic on the zone maps bounds an anchor's scores in a
   block from above and below.  A block is chosen for an anchor if for one of
   its windows the bounds meet it at or above its floor, and the labels allow it.
4. Reading.  Chosen blocks meet groups of about ``GROUP`` anchors, in slices of
   about ``SLICE`` blocks; a task keeps the first k rows of each window, passes
   over blocks whose bounds fall below them, and slices are merged by rank.

Steps 2 to 4 run once for positives (one window without bounds) and once for
negatives.  Bounds only leave out what cannot be an answer, so results are exact
however well the vectors are clustered; how much is left out depends on that.

The anchors are a stated query set and meet the rows in tiles: rows travel once
a group of anchors, anchors once a slice.  No key holds more than one tile, so
labels, copies and ids may be as uneven as they like.

Edge cases: rows with a NULL label or vector, or a NULL or non-finite component
take no part.  A shorter vector is continued by zeros.  A row is another one
than the anchor if it is another row, also with the same vec_id; repeated rows
each count.  A NULL vec_id is never an anchor's and comes last among ties.
Scores beyond 64 bits count as the nearest long (not quite the last two).
An empty table gives an empty table; extra columns are ignored, whatever their
names.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qpanel.llm.common import table, written

UNIT = 256
BLOCK = 256             # rows of a block
GROUP = 2048            # anchors that meet a block together
SLICE = 64              # blocks of a tile
SAMPLE = 4096           # rows that the curve's directions and cells are taken from
AXES, BITS = 9, 7       # of the Hilbert curve: 63 bits
_EXACT = float(1 << 53)
_MOST = (1 << 63) - 2   # scores are clipped to this; _NONE is below all of them
_NONE = -(1 << 63) + 1


def packed(a: np.ndarray) -> tuple[str, bytes]:
    """Integers as bytes of the narrowest kind that holds them."""
    top = np.abs(a).max(initial=0)
    kind = "<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<f8"
    return kind, a.astype(kind).tobytes()


def unpacked(kind: str, raw: bytes, rows: int) -> np.ndarray:
    a = np.frombuffer(raw, kind).astype(np.float64)
    return a.reshape(rows, len(a) // rows if rows else 0)


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on a Hilbert curve of points (rows of ``cells``, integers under
    2**bits), after Skilling's transposition."""
    x = [c.astype(np.int64) for c in cells.T]
    n = len(x)
    if not n:
        return np.zeros(len(cells), np.int64)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        low = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap if i else x[0]
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros(len(cells), np.int64)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        turn = np.where(x[-1] & q, turn ^ (q - 1), turn)
    place = np.zeros(len(cells), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            place = (place << 1) | (((x[i] ^ turn) >> b) & 1)
    return place


def bounds(anchors: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, block): least and greatest score that the zone map allows."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    least, most = up @ lo.T + down @ hi.T, up @ hi.T + down @ lo.T
    size = np.abs(anchors) @ np.maximum(np.abs(lo), np.abs(hi)).T
    slack = np.where(size < _EXACT, 0.0, size * 1e-9)
    return least - slack, most + slack


def scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """(anchor, row): exact inner products, clipped to ``_MOST``."""
    if anchors.shape[1] * np.abs(anchors).max(initial=0) * np.abs(rows).max(initial=0) < _EXACT:
        return (anchors @ rows.T).astype(np.int64)
    exact = [[int(x) for x in r] for r in rows]
    return np.array([[max(-_MOST, min(_MOST, sum(int(x) * y for x, y in zip(a, r, strict=True)))) for r in exact] for a in anchors],
                    np.int64).reshape(len(anchors), len(rows))


def integer_rows(vectors: DataFrame) -> DataFrame:
    """row, vec_id, label, kind, vec of the rows that take part."""
    fit = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select("vec_id", "label", "embedding").filter("label IS NOT NULL AND embedding IS NOT NULL").filter(fit)
    dims = rows.agg(F.max(F.size("embedding"))).first()[0] or 0

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs = batch.column("embedding")
            size = vecs.value_lengths().to_numpy().astype(int)
            a = np.zeros((len(size), dims))
            a[np.arange(dims)[None, :] < size[:, None]] = np.floor(vecs.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * UNIT)
            both = [packed(r) for r in a]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("vec_id"), batch.column("label"), pa.array([k for k, _ in both], pa.string()),
                 pa.array([v for _, v in both], pa.binary())], names=["row", "vec_id", "label", "kind", "vec"])

    rows = rows.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("bigint").alias("vec_id"),
                       F.col("label").cast("bigint").alias("label"), "embedding")
    return rows.mapInArrow(whole, "row bigint, vec_id bigint, label bigint, kind string, vec binary")


def _vectors(rows: pa.Table | pa.RecordBatch) -> np.ndarray:
    kinds, vecs = rows.column("kind").to_pylist(), rows.column("vec").to_pylist()
    each = [np.frombuffer(v, k).astype(np.float64) for k, v in zip(kinds, vecs, strict=True)]
    return np.stack(each) if each else np.zeros((0, 0))


def make_blocks(rows: DataFrame, count: int) -> DataFrame:
    """block, row, vec_id, label (arrays), size, kind, vecs, zone_kind, zone, kinds."""
    sample = rows.orderBy(F.xxhash64("row"), "row").limit(SAMPLE).select("kind", "vec").toArrow()
    a = _vectors(sample)
    mean = a.mean(axis=0) if len(a) else np.zeros(a.shape[1])
    axes = np.linalg.eigh(np.cov(a.T).reshape(a.shape[1], -1))[1][:, ::-1][:, :AXES] if len(a) > 1 and a.shape[1] else np.zeros((a.shape[1], 0))
    edges = np.quantile((a - mean) @ axes, np.arange(1, 1 << BITS) / (1 << BITS), axis=0) if len(a) else np.zeros((0, 0))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = (_vectors(batch) - mean) @ axes if batch.num_rows else np.zeros((0, 0))
            cells = [np.searchsorted(edges[:, i], at[:, i]) for i in range(at.shape[1])]
            place = hilbert(np.stack(cells, axis=1), BITS) if cells else np.zeros(batch.num_rows, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place, pa.int64())], names=[*batch.schema.names, "place"])

    def blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= BLOCK:
                part = pa.Table.from_batches(held)
                full = part.num_rows // BLOCK * BLOCK
                for i in range(0, full, BLOCK):
                    yield block(part.slice(i, BLOCK))
                held = part.slice(full).combine_chunks().to_batches()
        if sum(b.num_rows for b in held):
            yield block(pa.Table.from_batches(held))

    def block(part: pa.Table) -> pa.RecordBatch:
        part = part.sort_by([("vec_id", "ascending"), ("row", "ascending")])   # NULL ids last
        v = _vectors(part)
        kind, vecs = packed(v)
        zone_kind, zone = packed(np.stack([v.min(axis=0), v.max(axis=0)]))
        lists = [part.column(c).to_pylist() for c in ("row", "vec_id", "label")]
        return pa.RecordBatch.from_arrays(
            [*[pa.array([x], pa.list_(pa.int64())) for x in lists], pa.array([kind]), pa.array([vecs], pa.binary()),
             pa.array([zone_kind]), pa.array([zone], pa.binary()), pa.array([sorted(set(lists[2]))], pa.list_(pa.int64()))],
            names=["row", "vec_id", "label", "kind", "vecs", "zone_kind", "zone", "kinds"])

    schema = "row array<bigint>, vec_id array<bigint>, label array<bigint>, kind string, vecs binary, zone_kind string, zone binary, kinds array<bigint>"
    parts = max(1, -(-count // (BLOCK * SLICE)))
    ordered = rows.mapInArrow(placed, "row bigint, vec_id bigint, label bigint, kind string, vec binary, place bigint")
    ordered = ordered.repartitionByRange(parts, "place", "row").sortWithinPartitions("place", "row")
    return written(ordered.mapInArrow(blocked, schema).select(F.monotonically_increasing_id().alias("block"), "*"), "vector-blocks")


def make_groups(blocks: DataFrame, every: int) -> tuple[DataFrame, int]:
    """Anchors (vec_id a multiple of ``every``) in groups of neighbours: g, and
    arrays block, row, vec_id, label with kind, vecs; and how many groups."""
    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                v = unpacked(b["kind"], b["vecs"], len(b["row"]))
                at = [i for i, x in enumerate(b["vec_id"]) if x is not None and x % every == 0]
                both = [packed(v[i]) for i in at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b["block"]] * len(at), pa.int64()), *[pa.array([b[c][i] for i in at], pa.int64()) for c in ("row", "vec_id", "label")],
                     pa.array([k for k, _ in both], pa.string()), pa.array([x for _, x in both], pa.binary())],
                    names=["block", "row", "vec_id", "label", "kind", "vec"])

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]   # one range partition: about GROUP anchors
        if held:
            part = pa.Table.from_batches(held)
            kind, vecs = packed(_vectors(part))
            names = ["block", "row", "vec_id", "label"]
            yield pa.RecordBatch.from_arrays(
                [*[pa.array([part.column(c).to_pylist()], pa.list_(pa.int64())) for c in names], pa.array([kind]), pa.array([vecs], pa.binary())],
                names=[*names, "kind", "vecs"])

    anchors = written(blocks.select("block", "row", "vec_id", "label", "kind", "vecs").mapInArrow(
        taken, "block bigint, row bigint, vec_id bigint, label bigint, kind string, vec binary"), "anchors")
    groups = max(1, -(-anchors.count() // GROUP))
    rows = anchors.repartitionByRange(groups, "block", "row").sortWithinPartitions("block", "row").mapInArrow(
        grouped, "block array<bigint>, row array<bigint>, vec_id array<bigint>, label array<bigint>, kind string, vecs binary")
    return written(rows.select(F.spark_partition_id().alias("g"), "*"), "anchor-groups"), groups


class Group:
    """A group of anchors with their windows: arrays (anchor, window)."""

    def __init__(self, row: dict, same: bool, low: int, high: int):
        self.g, self.same, self.row, self.ids = row["g"], same, np.array(row["row"], np.int64), row["vec_id"]
        self.label, self.block = np.array(row["label"], np.int64), np.array(row["block"], np.int64)
        self.vecs = unpacked(row["kind"], row["vecs"], len(self.row))
        n = len(self.row)
        self.partner: dict = {}
        if same:
            self.lo, self.hi = np.full((n, 1), -_MOST), np.full((n, 1), _MOST)
        else:
            found = row["positives"] or []
            width = max((p["w"] for p in found), default=-1) + 1
            self.lo, self.hi = np.full((n, width), _MOST), np.full((n, width), -_MOST)      # empty windows
            for p in found:
                self.lo[p["a"], p["w"]] = -(-low * p["score"] // 100)
                self.hi[p["a"], p["w"]] = high * p["score"] // 100
                self.partner[p["a"], p["w"]] = (p["id"], p["score"])
        self.floor = self.lo.copy()
        for s in row.get("floors") or []:
            self.floor[s["a"], s["w"]] = max(self.floor[s["a"], s["w"]], s["score"])

    def open(self, least: np.ndarray, most: np.ndarray, floor: np.ndarray) -> np.ndarray:
        """(anchor, block): may the block hold an answer to one of the windows?"""
        able = np.zeros(least.shape, bool)
        for w in range(self.lo.shape[1]):
            live = self.lo[:, w] <= self.hi[:, w]
            able |= live[:, None] & (most >= floor[:, w, None]) & (least <= self.hi[:, w, None])
        return able


def choose_blocks(blocks: DataFrame, groups: DataFrame, tiles: tuple[int, int], same: bool, low: int, high: int) -> DataFrame:
    """g, block, need (bits of the anchors that the block is chosen for)."""
    zones = (_sliced(blocks, tiles[1]).select("block", "slice", "zone_kind", "zone", "kinds")
             .withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(tiles[0] - 1)))))

    def chosen(zones: pa.Table, group: pa.Table) -> pa.Table:
        out: list[tuple[int, int, bytes]] = []
        if zones.num_rows and group.num_rows:
            grp = Group(_plain(group), same, low, high)
            rows = zones.to_pylist()
            both = [unpacked(z["zone_kind"], z["zone"], 2) for z in rows]
            least, most = bounds(grp.vecs, np.array([z[0] for z in both]), np.array([z[1] for z in both]))
            able = grp.open(least, most, grp.floor)
            for i, z in enumerate(rows):
                kinds = np.array(z["kinds"], np.int64)
                need = able[:, i] & (np.isin(grp.label, kinds) if same else (len(kinds) > 1) | (grp.label != kinds[0]))
                if need.any():
                    out.append((grp.g, z["block"], np.packbits(need).tobytes()))
        return pa.table({"g": pa.array([o[0] for o in out], pa.int32()), "block": pa.array([o[1] for o in out], pa.int64()),
                         "need": pa.array([o[2] for o in out], pa.binary())})

    return (zones.groupBy("g", "slice").cogroup(_dealt(groups, tiles[1]).groupBy("group_g", "group_slice"))
            .applyInArrow(chosen, "g int, block bigint, need binary"))


def own_blocks(groups: DataFrame) -> DataFrame:
    """g, block, need: every anchor's own block."""
    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                at = np.array(row["block"], np.int64)
                ids = np.unique(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["g"]] * len(ids), pa.int32()), pa.array(ids, pa.int64()),
                     pa.array([np.packbits(at == b).tobytes() for b in ids], pa.binary())], names=["g", "block", "need"])

    return groups.select("g", "block").mapInArrow(own, "g int, block bigint, need binary")


def read_blocks(blocks: DataFrame, groups: DataFrame, pairs: DataFrame, tiles: tuple[int, int], same: bool, k: int, low: int, high: int) -> DataFrame:
    """g, a, w, n (rank from 1), id, score, anchor_id, positive_id,
    positive_score: the first ``k`` rows of each window in the chosen blocks."""
    need = pairs.select("g", F.col("block").alias("need_block"), "need")
    left = (_sliced(blocks, tiles[1]).join(need, F.col("block") == F.col("need_block"))
            .select("g", "slice", "need", "row", "vec_id", "label", "kind", "vecs", "zone_kind", "zone"))

    def best(parts: pa.Table, group: pa.Table) -> pa.Table:
        grp = Group(_plain(group), same, low, high) if group.num_rows and parts.num_rows else None
        out: list[tuple] = []
        if grp is not None and grp.lo.shape[1]:
            shape = (*grp.lo.shape, k)
            top, ids, known = np.full(shape, _NONE), np.full(shape, _MOST), np.zeros(shape, bool)
            rows = parts.to_pylist()
            zone = [unpacked(r["zone_kind"], r["zone"], 2) for r in rows]
            least, most = bounds(grp.vecs, np.array([z[0] for z in zone]), np.array([z[1] for z in zone]))
            for i in np.argsort(-most.sum(axis=0), kind="stable"):
                floor = np.maximum(grp.floor, top[:, :, -1])
                need = np.unpackbits(np.frombuffer(rows[i]["need"], np.uint8), count=len(grp.row)) == 1
                use = np.flatnonzero(need & grp.open(least[:, i, None], most[:, i, None], floor)[:, 0])
                if len(use):
                    _take(grp, rows[i], use, top, ids, known, k)
            for a, w, j in np.argwhere(top != _NONE):
                partner = grp.partner.get((a, w), (None, None))
                out.append((grp.g, a, w, ids[a, w, j] if known[a, w, j] else None, top[a, w, j], grp.ids[a], *partner))
        kinds = [pa.int32(), pa.int32(), pa.int32(), *[pa.int64()] * 5]
        names = ["g", "a", "w", "id", "score", "anchor_id", "positive_id", "positive_score"]
        return pa.table({c: pa.array([None if o[i] is None else int(o[i]) for o in out], t) for i, (c, t) in enumerate(zip(names, kinds, strict=True))})

    found = left.groupBy("g", "slice").cogroup(_dealt(groups, tiles[1]).groupBy("group_g", "group_slice")).applyInArrow(
        best, "g int, a int, w int, id bigint, score bigint, anchor_id bigint, positive_id bigint, positive_score bigint")
    return found.selectExpr("*", "row_number() OVER (PARTITION BY g, a, w ORDER BY score DESC, id ASC NULLS LAST) AS n").filter(F.col("n") <= k)


def _take(grp: Group, block: dict, use: np.ndarray, top: np.ndarray, ids: np.ndarray, known: np.ndarray, k: int) -> None:
    """Put the block's rows into the first ``k`` of the windows of ``use``."""
    label, n = np.array(block["label"], np.int64), len(block["label"])
    s = scores(grp.vecs[use], unpacked(block["kind"], block["vecs"], n))
    alike = label[None, :] == grp.label[use][:, None]
    fit = alike & (np.array(block["row"], np.int64)[None, :] != grp.row[use][:, None]) if grp.same else ~alike
    s[~fit] = _NONE
    order = np.argsort(-s, axis=1, kind="stable")     # a block's rows stand by id
    s = np.take_along_axis(s, order, axis=1)
    there = np.array([x is not None for x in block["vec_id"]])
    names = np.array([_MOST if x is None else x for x in block["vec_id"]], np.int64)
    for w in range(grp.lo.shape[1]):
        first = (s > grp.hi[use, w][:, None]).sum(axis=1)
        at = first[:, None] + np.arange(min(k, n))
        got = np.take_along_axis(s, np.minimum(at, n - 1), axis=1)
        rows = np.take_along_axis(order, np.minimum(at, n - 1), axis=1)
        got[(at >= n) | (got < grp.lo[use, w][:, None])] = _NONE
        both = np.concatenate([top[use, w], got], axis=1)
        both_ids = np.concatenate([ids[use, w], names[rows]], axis=1)
        both_known = np.concatenate([known[use, w], there[rows]], axis=1)
        pick = np.lexsort((both_ids, ~both_known, -both), axis=1)[:, :k]
        for held, joined in ((top, both), (ids, both_ids), (known, both_known)):
            held[use, w] = np.take_along_axis(joined, pick, axis=1)


def _plain(group: pa.Table) -> dict:
    row = group.to_pylist()[0]
    return {c.removeprefix("group_"): v for c, v in row.items()}


def _sliced(blocks: DataFrame, slices: int) -> DataFrame:
    return blocks.withColumn("slice", F.pmod(F.xxhash64("block"), F.lit(slices)).cast("int"))


def _dealt(groups: DataFrame, slices: int) -> DataFrame:
    rows = groups.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    return rows.select(*[F.col(c).alias("group_" + c) for c in rows.columns])


def _with(groups: DataFrame, rows: DataFrame, name: str, *cols: str) -> DataFrame:
    """``groups`` with their rows of a small result as an array of structs."""
    lists = rows.groupBy("g").agg(F.collect_list(F.struct(*cols)).alias(name))
    return groups.join(lists, "g", "left")


def mine(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    rows = written(integer_rows(vectors), "integer-vectors")
    blocks = make_blocks(rows, rows.count())
    groups, count = make_groups(blocks, every)
    tiles = (count, max(1, -(-blocks.count() // SLICE)))

    def answers(groups: DataFrame, same: bool, k: int) -> DataFrame:
        seeds = read_blocks(blocks, groups, own_blocks(groups), tiles, same, k, low, high).filter(F.col("n") == k)
        aware = written(_with(groups, seeds, "floors", "a", "w", "score"), "floors")
        pairs = choose_blocks(blocks, aware, tiles, same, low, high)
        return read_blocks(blocks, aware, pairs, tiles, same, k, low, high)

    found = answers(groups, True, positives).select("g", "a", (F.col("n") - 1).alias("w"), "id", "score")
    groups = written(_with(groups, found, "positives", "a", "w", "id", "score"), "anchor-positives")
    out = answers(groups, False, negatives)
    return out.select("anchor_id", "positive_id", F.col("n").cast("int").alias("rank"), F.col("id").alias("negative_id"),
                      "positive_score", F.col("score").alias("negative_score"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the ids divisible by 100; ids divisible by 7 get the next label."""
    label = F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    return mine(table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), "embedding"))


ORACLE = """
WITH v AS (SELECT row_number() OVER () AS k, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.k AS ak, a.vec_id AS aid, a.label = b.label AS alike, a.k = b.k AS own, b.vec_id AS id,
    list_inner_product(a.e, b.e)::BIGINT AS score FROM v a, v b WHERE a.vec_id % 100 = 0),
pos AS (SELECT * FROM (SELECT ak, aid, id, score, row_number() OVER (PARTITION BY ak ORDER BY score DESC, id) AS n
    FROM s WHERE alike AND NOT own) WHERE n <= 5),
neg AS (SELECT p.ak, p.n, p.aid, p.id AS positive_id, p.score AS positive_score, s.id, s.score,
    row_number() OVER (PARTITION BY p.ak, p.n ORDER BY s.score DESC, s.id)::INTEGER AS rank
  FROM pos p JOIN s ON s.ak = p.ak AND NOT s.alike AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT aid AS anchor_id, positive_id, rank, id AS negative_id, positive_score, score AS negative_score FROM neg WHERE rank <= 10
"""
