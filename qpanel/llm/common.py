"""Helpers shared by the training-data operators.

* ``documents`` reads the table; ``scratch`` names a fresh folder under the
  shared ``spark.checkpoint.dir``.
* ``chunks`` walks an Arrow string column in pieces of bounded size and hands
  out the raw UTF-8 bytes with document offsets, so numpy code never builds a
  Python string per row.
* ``Words`` finds the words of such a piece and hashes all of them at once.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z.
"""
from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from qpanel.session import ensure_checkpoint_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CHUNK_BYTES = 1 << 20

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
TO_LOWER = np.arange(256, dtype=np.uint8)
TO_LOWER[0x41:0x5B] += 32

_PRIME = np.uint64(0x9E3779B97F4A7C15)          # odd: has an inverse modulo 2**64
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts lineage, survives executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that ``df`` does not have (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def whole_text(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def bucket_of(col: str, buckets: int) -> Column:
    """crc32 of the id as text, modulo ``buckets`` (fixed train/held-out split)."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % buckets


def mix(h: np.ndarray) -> np.ndarray:
    """Final scrambling of 64-bit hashes (in place on a fresh array)."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        for k, base in (("up", _PRIME), ("down", _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) pieces of about ``limit`` bytes; a
    longer document is a piece of its own.  Null counts as empty."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not (pa.types.is_string(arr.type) or pa.types.is_large_string(arr.type)):
        arr = arr.cast(pa.large_string())
    arr = arr.fill_null("") if arr.null_count else arr
    n = len(arr)
    if not n:
        return
    wide = pa.types.is_large_string(arr.type)
    off = np.frombuffer(arr.buffers()[1], np.int64 if wide else np.int32, n + 1, arr.offset * (8 if wide else 4)).astype(np.int64)
    data = arr.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        yield a, b, raw[off[a]:off[b]], off[a:b + 1] - off[a]
        a = b


def slices(raw: np.ndarray, limit: int, again: int = 0) -> Iterator[tuple[int, int]]:
    """(start, end) parts of one long text of about ``limit`` bytes, cut at
    white space, which belongs to both parts.  Each part begins ``again`` words
    before the end of the last one, for n-grams over the cut.  A word longer
    than ``limit`` is not cut."""
    lo, n = 0, len(raw)
    while True:
        hi = lo + limit
        while hi < n and not IS_SPACE[raw[hi]]:
            hi += 1
        if hi >= n:
            yield lo, n
            return
        yield lo, hi + 1
        lo, left = hi, again
        while left and lo > 0:
            lo -= 1
            while lo > 0 and not IS_SPACE[raw[lo]]:
                lo -= 1
            left -= 1
        lo = max(lo, hi - limit // 2)  # goes on, however long the words are


class Words:
    """Words of a piece: byte spans, 64-bit hashes, and ``first``: index of
    each document's first word (one more entry for the end)."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, block: int = 4 * CHUNK_BYTES):
        n = len(raw)
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        space = IS_SPACE[raw]
        before = np.ones(n, bool)
        before[1:] = space[:-1]
        after = np.ones(n, bool)
        after[:-1] = space[1:]
        self.starts = np.flatnonzero(~space & (before | edge[:n]))
        self.ends = np.flatnonzero(~space & (after | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, offsets)
        out, i = [], 0
        while i < len(self.starts):  # one block unless a text is very long
            j = max(i + 1, int(np.searchsorted(self.ends, self.starts[i] + block, "right")))
            lo, hi = self.starts[i], self.ends[j - 1]
            up, down = powers(hi - lo + 1)
            total = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum(_BYTE[TO_LOWER[raw[lo:hi]]] * up[:hi - lo], out=total[1:])
            a, b = self.starts[i:j] - lo, self.ends[i:j] - lo
            out.append(mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64)))
            i = j
        self.hashes = np.concatenate(out) if out else np.zeros(0, np.uint64)

    def __len__(self) -> int:
        return len(self.starts)

    def doc(self) -> np.ndarray:
        """Index of the document of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def grams(raw: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of all runs of ``n`` bytes that lie within one document,
    and where each begins."""
    if len(raw) < n:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    m = len(raw) - n + 1
    h = np.full(m, 2166136261 + n, np.uint32)
    for k in range(n):
        h *= np.uint32(0x01000193)
        h ^= raw[k:k + m]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(12)
    ok = np.ones(m, bool)
    for k in range(1, n):  # a run may not reach over the end of its document
        cut = offsets[1:-1] - k
        ok[cut[(cut >= 0) & (cut < m)]] = False
    at = np.flatnonzero(ok)
    return h[at], at


def sums_by_doc(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` (rows) over [first[i], first[i + 1])."""
    total = np.zeros((len(values) + 1, *values.shape[1:]))
    np.cumsum(values, axis=0, dtype=np.float64, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
