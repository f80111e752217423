"""Exact dedup over an extendible-hash index on shared files.

1. Keys: (row, id, 64-bit hash, sha256) of every row go to the shared folder.
2. Directory: the top ``depth`` bits of a hash pick a slot.  The directory is
   doubled (depth + 1) while some bucket holds more than ``capacity`` distinct
   hashes; a bucket that was never overfull keeps its smaller local depth and
   is shared by several slots.
3. Buckets: whole texts meet by (hash, text).  Rows of one hash chain are told
   apart by their bytes, and copies collapse inside each map task before the
   shuffle, so a text with a third of all rows costs one row a task.
4. Owner tasks each take a range of (bucket, hash) and write that part of the
   index, sorted, to the shared folder, with each entry's place in its chain.
5. Every row looks its entry up by (hash, sha256), on narrow rows only.

Main path: DataFrame functions only.

Edge cases: a NULL text counts as empty; of equal texts the largest id stays, a
NULL id ranks below all; of repeated rows with that id exactly one stays; a
group of NULL ids has a NULL keep_id; an empty table gives an empty table.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from qpanel.llm.common import documents, scratch, unused, whole_text, written

CAPACITY = 8192                 # distinct hashes a bucket holds before it splits
MAX_DEPTH = 40
BROADCAST_SLOTS = 1 << 20       # directory slots (16 bytes each) that are broadcast at most


def slot(h: str, depth: int) -> Column:
    return F.shiftrightunsigned(F.col(h), 64 - depth) if depth else F.lit(0).cast("long")


def directory(keys: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, int, int]:
    """(slot, bucket, local_depth), the global depth, and the slots in use."""
    hashes = written(keys.select("h").distinct(), "dedup-hashes")
    n = hashes.count()
    depth = max(0, math.ceil(math.log2(max(1, n) / capacity)))
    while True:
        slots = hashes.groupBy(slot("h", depth).alias("slot")).agg(F.count(F.lit(1)).alias("n"))
        most, used = slots.agg(F.max("n"), F.count(F.lit(1))).first()
        if (most or 0) <= capacity or depth >= MAX_DEPTH:
            break
        depth += 1
    local = F.lit(depth)
    for d in reversed(range(depth)):  # the smallest depth at which the bucket fits
        fits = F.sum("n").over(Window.partitionBy(F.shiftright("slot", depth - d))) <= capacity
        local = F.when(fits, F.lit(d)).otherwise(local)
    slots = slots.withColumn("local_depth", local)
    bucket = F.concat_ws("/", F.col("local_depth"), F.expr(f"shiftright(slot, {depth} - local_depth)"))
    return slots.select("slot", bucket.alias("bucket"), "local_depth"), depth, used


def build_index(docs: DataFrame, keys: DataFrame, text_col: str = "text", capacity: int = CAPACITY,
                id_col: str = "doc_id") -> DataFrame:
    """The index: one row per distinct text, written by the owners of its key
    ranges: bucket, h, chain, sha, keep_id, group_size."""
    slots, depth, used = directory(keys, capacity)
    entries = (docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
               .withColumn("h", F.xxhash64("text"))
               .groupBy("h", "text").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
               .select("h", F.sha2(F.col("text").cast("binary"), 256).alias("sha"), "keep_id", "group_size",
                       slot("h", depth).alias("slot")))
    slots = F.broadcast(slots) if used <= BROADCAST_SLOTS else slots
    owned = entries.join(slots, "slot").repartitionByRange("bucket", "h")
    chain = F.row_number().over(Window.partitionBy("bucket", "h").orderBy("sha"))
    path = scratch(docs.sparkSession, "dedup-index")
    out = owned.withColumn("chain", chain.cast("long")).select("bucket", "h", "chain", "sha", "keep_id", "group_size")
    out.sortWithinPartitions("bucket", "h").write.parquet(path)
    return docs.sparkSession.read.schema(out.schema).parquet(path)


def row_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = whole_text(text_col)
    return written(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"),
                               F.xxhash64(text).alias("h"), F.sha2(text.cast("binary"), 256).alias("sha")), "dedup-keys")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                capacity: int = CAPACITY) -> DataFrame:
    """One row per row of ``docs``: <id>, keep_id, group_size, kept, text_sha256."""
    keys = row_keys(docs, id_col, text_col)
    index = build_index(docs, keys, text_col, capacity, id_col)
    # of repeated rows with the id that stays, one row number stays
    winner = keys.groupBy("h", "sha").agg(F.max_by("row", F.coalesce("id", F.lit(-(1 << 63)))).alias("winner"))
    # written, so that the last join stands alone and a hot text's rows can be split
    entry = written(index.join(winner, ["h", "sha"]).select("h", "sha", "keep_id", "group_size", "winner"), "dedup-entries")
    return keys.join(entry, ["h", "sha"]).select(
        F.col("id").alias(id_col), "keep_id", "group_size", (F.col("row") == F.col("winner")).alias("kept"),
        F.col("sha").alias("text_sha256"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row per text: the one whose id the index keeps, and
    one of those if rows with that id and text repeat."""
    def key(ident: str, sha: Column) -> Column:
        return F.concat_ws(":", sha, F.coalesce(F.col(ident).cast("string"), F.lit("null")))
    name = unused(docs, "_key")
    keep = exact_dedup(docs).filter("kept").select(key("doc_id", F.col("text_sha256")).alias(name))
    rows = docs.withColumn(name, key("doc_id", F.sha2(whole_text().cast("binary"), 256)))
    return rows.join(keep, name, "left_semi").dropDuplicates([name]).drop(name)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one of its equal texts that stays."""
    return exact_dedup(documents(spark, sf_dir))


ORACLE = """
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM (
  SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256,
         max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
         count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size
  FROM documents)"""
