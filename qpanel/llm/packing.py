"""Vector bin packing of examples into training sequences.

An example needs a vector: tokens, one segment, loss-bearing tokens.  A
sequence has a limit on each.  A task keeps a pool of ``POOL`` waiting
examples and fills one sequence at a time: of those that fit, the one with the
largest dot product of its need and the room left (both as shares of the
limits) goes in, until none fits.

Where cutting is allowed (plain documents), the largest waiting example is cut
to fill the rest, examples longer than a sequence give full sequences first,
and a sequence that cannot be filled (limit on segments, or the end of a task's
rows) is trimmed to a power of two, which needs no padding; what is cut off
waits on.  So nothing is padded, however the rows are split over tasks.

Where it is not (instruction data), an example stays whole; one that is over a
limit by itself gets a sequence of its own, marked ``oversize``.

One pass over the input without a shuffle: each task packs its own input
split, so a retried task makes the same sequences.  sequence_id is the
partition's number times 2**32 plus a running number.

Ids are those of the byte-level BPE vocabulary ``byte_bpe_50k`` (read as ranks;
a test compares them with the json form), then id 0 after each document.  The
json form's added tokens are cut out of a text first and give their own ids.

Edge cases: a NULL or empty text is the one id 0; NULL and repeated doc_ids are
rows like others; an empty table gives an empty table; extra columns are
ignored.
"""
from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qpanel.llm.common import documents, whole_text

TOKENS, SEGMENTS, LOSS = 1024, 32, 1024
POOL = 256
END = 0
_loaded: dict[tuple[str, str], object] = {}


def added_tokens(vocabulary: str) -> dict[str, int]:
    """Texts of the json form's added tokens, with their ids."""
    with open(vocabulary, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f).get("added_tokens") or []}


def encoder(ranks: str | None = None, vocabulary: str | None = None):
    """The byte-level BPE from a file of ranks and the added tokens of its json
    form; loaded once a process."""
    import public_tokenizers
    import tiktoken

    path, whole = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    if (path, whole) not in _loaded:
        with open(path, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _loaded[path, whole] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table,
                                                 special_tokens=added_tokens(whole))
    return _loaded[path, whole]


class Packer:
    """Fills sequences from a pool.  ``emit(items)`` gets each sequence's
    items in order; an item is (key, start, length, loss)."""

    def __init__(self, emit: Callable[[list[tuple], bool], None], cut: bool,
                 limits: tuple[int, int, int] = (TOKENS, SEGMENTS, LOSS), pool: int = POOL):
        self.emit, self.cut, self.size = emit, cut, pool
        self.limits = np.array(limits, float)
        self.items: list[tuple] = []
        self.needs = np.zeros((2 * pool + 2, 3))

    def add(self, key, start: int, length: int, loss: int) -> None:
        most = int(self.limits[0])
        if self.cut:
            while length >= most:
                self.emit([(key, start, most, min(loss, most - 1))], False)
                start, length, loss = start + most, length - most, max(0, length - most - 1)
            if not length:
                return
        elif length > most or loss > self.limits[2]:
            self.emit([(key, start, length, loss)], True)
            return
        self._wait((key, start, length, loss))
        if len(self.items) >= self.size:
            self.fill()

    def finish(self) -> None:
        while self.items:
            self.fill()

    def _wait(self, item: tuple) -> None:
        self.needs[len(self.items)] = (item[2], 1, item[3])
        self.items.append(item)

    def _take(self, i: int) -> tuple:
        item, last = self.items[i], self.items.pop()
        if i < len(self.items):  # the last one moves into the gap
            self.items[i] = last
            self.needs[i] = self.needs[len(self.items)]
        return item

    def fill(self) -> None:
        """One sequence."""
        room, placed = self.limits.copy(), []
        while self.items and room[0] > 0:
            need = self.needs[:len(self.items)]
            gain = (need / self.limits) @ (room / self.limits)
            gain[(need > room).any(axis=1)] = -1
            best = int(gain.argmax())
            if gain[best] < 0:
                break
            item = self._take(best)
            placed.append(item)
            room -= (item[2], 1, item[3])
        if self.cut:
            if self.items and room[0] > 0 and room[1] > 0:
                placed.append(self._take(int(self.needs[:len(self.items), 0].argmax())))
                room[0] -= placed[-1][2]
            used = sum(p[2] for p in placed)
            goal = int(self.limits[0]) if used >= self.limits[0] else 1 << (used.bit_length() - 1)
            while used > goal:  # trim the end to the goal; the rest waits
                key, start, length, _ = placed.pop()
                off = min(length, used - goal)
                used -= off
                if length > off:
                    placed.append((key, start, length - off, length - off - 1))
                self._wait((key, start + length - off, off, off - 1))
        self.emit(placed, False)


_PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, ranks: str | None = None, with_ids: bool = False,
                   limits: tuple[int, int, int] = (TOKENS, SEGMENTS, LOSS)) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, and with ``with_ids`` the ids themselves.  A piece's
    first token has nothing to be predicted from and bears no loss."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(ranks)
        base, made = TaskContext.get().partitionId() << 32, 0
        rows: list[tuple] = []

        def emit(items: list[tuple], _over: bool) -> None:
            nonlocal made
            at = 0
            for (doc, ids, shift, total), start, length, _ in items:
                part = ids[start - shift:start - shift + length]
                rows.append((doc, start, length, zlib.crc32(part.tobytes()), total, base + made, at, *([part] if with_ids else [])))
                at += length
            made += 1

        def out() -> pa.RecordBatch:
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])]
            types = [id_type] + [pa.int64()] * 6 + [pa.list_(pa.int32())] * with_ids
            cols = list(zip(*rows, strict=True)) or [[]] * len(names)
            rows.clear()
            return pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

        packer, id_type = Packer(emit, True, limits), None
        for batch in batches:
            ids_column = batch.column("doc_id")
            id_type = ids_column.type
            for doc, text in zip(ids_column.to_pylist(), batch.column("text"), strict=True):
                ids = np.array([*bpe.encode(text.as_py(), allowed_special="all"), END], "<u4")
                whole = len(ids) // limits[0] * limits[0]
                if whole:  # full sequences at once; the tail is copied, so that the rest can go
                    packer.add((doc, ids, 0, len(ids)), 0, whole, whole - 1)
                if len(ids) > whole:
                    packer.add((doc, ids[whole:].copy(), whole, len(ids)), whole, len(ids) - whole, len(ids) - whole - 1)
                if len(rows) >= 4096:
                    yield out()
        packer.finish()
        if rows:
            yield out()

    schema = f"doc_id {kind}, {_PIECES}" + (", ids array<int>" if with_ids else "")
    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(run, schema)


def pack_examples(examples: DataFrame, limits: tuple[int, int, int] = (TOKENS, SEGMENTS, LOSS)) -> DataFrame:
    """Instruction data: ``examples`` (example_id, tokens, loss_tokens) packed
    whole.  Returns example_id, tokens, loss_tokens, sequence_id, offset,
    oversize.  NULL counts are 0."""
    kind = examples.schema["example_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 32, 0
        rows: list[tuple] = []

        def emit(items: list[tuple], over: bool) -> None:
            nonlocal made
            at = 0
            for key, _, length, loss in items:
                rows.append((key, length, loss, base + made, at, over))
                at += length
            made += 1

        packer, id_type = Packer(emit, False, limits), None
        for batch in batches:
            id_type = batch.column("example_id").type
            for key, tokens, loss in zip(*(batch.column(c).to_pylist() for c in ("example_id", "tokens", "loss_tokens")), strict=True):
                packer.add(key, 0, tokens, loss)
        packer.finish()
        if rows:
            types = [id_type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)],
                                  ["example_id", "tokens", "loss_tokens", "sequence_id", "offset", "oversize"])

    count = lambda c: F.greatest(F.coalesce(F.col(c).cast("long"), F.lit(0)), F.lit(0)).alias(c)
    return examples.select("example_id", count("tokens"), count("loss_tokens")).mapInArrow(
        run, f"example_id {kind}, tokens long, loss_tokens long, sequence_id long, offset long, oversize boolean")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids in sequences of at most 1024 tokens."""
    return pack_documents(documents(spark, sf_dir))
