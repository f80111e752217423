"""Document fingerprints: invertible Bloom lookup sketches of paragraphs.

A text's paragraphs are its lines, cut by content: a piece ends where the hash
of a word hits (one word in ``EVERY``, whatever the text's length), and after
``LONGEST`` words at the latest, so a text has as many pieces as it needs and
cuts meet again after an edit.  A paragraph's digest is 40 bits of a hash and a
check of 24.  A sketch has three parts of equally many cells; each digest goes
into one cell of each part: count and xor of digests.  A text's fingerprint is
such a sketch of its distinct paragraphs, with ``SEGMENT`` cells a part.

Two versions are compared by subtracting cell from cell: what both hold
vanishes.  A cell that holds one digest (count 1 or -1, check right) gives it
away; taking it out of its cells in the other parts uncovers more (peeling).  A
generation peels one part, in which no digest can be met twice, and the parts
take turns for ``GENERATIONS``.  If cells of the fingerprints are left over, the
answer is that of a sketch with about as many cells a part as both versions have
digests; if that fails too, the comparison is repeated with sketches ``LARGER``
times the size, up to ``RETRIES`` times.  If the largest fails, the digests
themselves are compared, so the answer is always whole; the column ``tries`` says
how far each row went (0 fingerprints, 1 sketch, 2 and more retries, -1 digests).

Likeness: 1 - (recovered digests) / (digests of either), 1 for two empty texts.

Main path: DataFrame functions only.  The next document comes from a window over
buckets of consecutive ids; the first row of each bucket is also sent to the
bucket before.  So texts and their digests are shuffled once.  Sketches are sums
and xors by (row, part, segment of the cells), all within that partitioning: no
aggregate and no generation shuffles again, and each is generated code.

Edge cases: a NULL text is empty (a fingerprint of empty cells); NULL ids come
first in order; rows with one id are ordered by text and lie in one bucket; very
long texts are cut whole and their sketches grow with them; ties (equal texts)
have equal fingerprints; a single row is its own next one; an empty table gives
an empty table; extra columns are ignored, whatever their names.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from qpanel.llm.common import documents, whole_text, written

SEGMENT = 8                    # cells that are summed in one row, and cells a part of a fingerprint
PARTS = 3
CHECK = (1 << 24) - 1
GENERATIONS = 6
RETRIES, LARGER = 3, 8
LEAST_CELLS = 32               # a part of a sketch that follows the fingerprints; one more for each digest
EVERY, LONGEST = 4, 16         # words a piece: expected, at most
BUCKET_BYTES = 1 << 20
COARSE = 128                   # quantiles of the ids that are gathered at most
FINE = 4096                    # equal ranges between two of them at most
LOWEST = -(1 << 63)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.transform(F.array(value), body)[0]


def paragraphs(text: Column) -> Column:
    """Hashes of the distinct paragraphs: the pieces of each line.  A word counts
    with the blanks behind it; blanks before a line's first word do not count."""
    def pieces(h: Column) -> Column:
        n = F.size(h)
        ends = F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | (F.get(h, i - 1) % EVERY == 0))
        starts = let(ends, lambda at: F.flatten(F.transform(at, lambda e, k: F.sequence(
            F.when(k == 0, 1).otherwise(F.get(at, k - 1) + 1), e, F.lit(LONGEST)))))
        return let(starts, lambda at: F.transform(at, lambda s, k: F.xxhash64(F.slice(
            h, s, F.coalesce(F.get(at, k + 1), n + 1) - s))))

    def cut(line: Column) -> Column:
        words = F.regexp_extract_all(line, F.lit(r"\S+\s*"), F.lit(0))
        return let(F.transform(words, lambda w: F.xxhash64(w)), pieces)

    lines = F.filter(F.transform(F.split(text, "\n"), lambda s: F.trim(s)), lambda s: s.rlike(r"\S"))
    return F.array_distinct(F.flatten(F.transform(lines, cut)))


def digest(h: Column) -> Column:
    """40 bits of a hash, and a check of them in the low 24 bits."""
    top = F.shiftrightunsigned(h, 24)
    return F.shiftleft(top, 24).bitwiseOR(F.shiftrightunsigned(F.xxhash64(top), 9).bitwiseAND(F.lit(CHECK)))


def digests(text: Column) -> Column:
    return F.array_distinct(F.transform(paragraphs(text), digest))


# What a sketch is of.  OWN: the fingerprint of the text, of the edited text, of the
# next one.  BY_OWN: differences of fingerprints.  BY_SIZE: sketches as large as needed.
TEXT, EDITED, NEXT = 0, 1, 2
BY_OWN = {EDITED: 3, NEXT: 4}
BY_SIZE = {EDITED: 5, NEXT: 6}
FOUND, INFO = PARTS, PARTS + 1     # parts of rows that are no cells
_KEY = ["bucket", "k", "info", "of", "cells", "part", "segment"]


def place(x: Column, part: Column | int, cells: Column) -> Column:
    """A digest's cell in a part of ``cells`` cells."""
    part = F.lit(part) if isinstance(part, int) else part
    return F.pmod(F.xxhash64(F.shiftrightunsigned(x, 24), part), cells)


def pure(n: Column, x: Column) -> Column:
    check = F.shiftrightunsigned(F.xxhash64(F.shiftrightunsigned(x, 24)), 9).bitwiseAND(F.lit(CHECK))
    return (F.abs(n) == 1) & (x.bitwiseAND(F.lit(CHECK)) == check)


def _sums(rows: DataFrame) -> DataFrame:
    """Count and xor of SEGMENT cells in each row."""
    j = F.col("j")
    return rows.groupBy(*_KEY).agg(*[F.sum(F.when(j == i, F.col("n")).otherwise(F.lit(0).cast("long"))).alias(f"n{i}") for i in range(SEGMENT)],
                                   *[F.bit_xor(F.when(j == i, F.col("x")).otherwise(F.lit(0).cast("long"))).alias(f"x{i}") for i in range(SEGMENT)])


def sketches(rows: DataFrame, larger: int) -> DataFrame:
    """Cells of all sketches of ``rows`` (bucket, k, info, a, e, b)."""
    def version(of: int, sign: int, items: str, cells: Column) -> Column:
        return F.struct(F.lit(of).alias("of"), F.lit(sign).alias("n"), cells.cast("long").alias("cells"), F.col(items).alias("items"))

    def by_size(other: str) -> Column:
        return (F.size("a") + F.size(other) + LEAST_CELLS) * larger

    own = F.lit(SEGMENT)
    versions = F.array(version(TEXT, 1, "a", own), version(EDITED, 1, "e", own), version(NEXT, 1, "b", own),
                       version(BY_SIZE[EDITED], 1, "a", by_size("e")), version(BY_SIZE[EDITED], -1, "e", by_size("e")),
                       version(BY_SIZE[NEXT], 1, "a", by_size("b")), version(BY_SIZE[NEXT], -1, "b", by_size("b")),
                       F.struct(F.lit(TEXT).alias("of"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("cells"), F.array(F.lit(0).cast("long")).alias("items")))
    items = (rows.select("bucket", "k", "info", F.explode(versions).alias("v"))
             .select("bucket", "k", F.when(F.col("v.n") == 0, F.col("info")).alias("info"), "v.of", "v.n", "v.cells", F.explode("v.items").alias("x")))
    # arrays of literals are exploded, and cells chosen by CASE, so that no row is built on the way
    rows = items.withColumn("part", _numbers(PARTS)).filter("n <> 0 OR part = 0")
    rows = rows.withColumn("at", F.when(F.col("n") == 0, F.lit(0).cast("long")).otherwise(place(F.col("x"), F.col("part"), F.col("cells"))))
    return rows.select("bucket", "k", "info", "of", "cells", F.when(F.col("n") == 0, INFO).otherwise(F.col("part")).alias("part"),
                       F.shiftrightunsigned("at", 3).alias("segment"), F.col("at").bitwiseAND(SEGMENT - 1).cast("int").alias("j"),
                       F.col("n").cast("long").alias("n"), "x")


def _numbers(n: int) -> Column:
    return F.explode(F.array(*map(F.lit, range(n))))


def _left_over() -> Column:
    out = F.lit(False)
    for j in range(SEGMENT):
        out = out | (F.col(f"n{j}") != 0) | (F.col(f"x{j}") != 0)
    return out


def peeled(cells: DataFrame, whole: bool = False) -> DataFrame:
    """Sums after all generations: cells left over, and how many digests were
    found (part FOUND; n0 in the first version only, n1 in the second); if
    ``whole``, one row for each digest, which is its segment."""
    j, n, x, of, part, copy = (F.col(c) for c in ("j", "n", "x", "of", "part", "copy"))
    for g in range(GENERATIONS):
        turn = g % PARTS
        first, second = (p for p in range(PARTS) if p != turn)
        rows = _sums(cells).filter(_left_over() | F.col("info").isNotNull()).withColumn("j", _numbers(SEGMENT))

        def chosen(name: str) -> Column:
            out = F.when(j == 0, F.col(f"{name}0"))
            for i in range(1, SEGMENT):
                out = out.when(j == i, F.col(f"{name}{i}"))
            return out

        rows = rows.select(*_KEY, "j", chosen("n").alias("n"), chosen("x").alias("x")).filter("n <> 0 OR x <> 0 OR info IS NOT NULL AND j = 0")
        rows = rows.withColumn("alone", (of > NEXT) & (part == turn) & pure(n, x)).withColumn("copy", _numbers(PARTS))
        # a digest that lies alone: it is found, and taken out of the other parts
        goes = F.col("alone")
        if g == 0:  # fingerprints are subtracted once they are summed
            goes = goes | (copy == 1) & (of == EDITED) | (of == TEXT) & F.col("info").isNull()
        rows = rows.filter((copy == 0) | goes)
        to = F.when(F.col("alone"), F.when(copy == 0, FOUND).when(copy == 1, first).otherwise(second)).otherwise(part)
        rows = rows.withColumn("to", to)
        rows = rows.withColumn("at", F.when(F.col("alone") & (copy > 0), place(x, F.col("to"), F.col("cells"))))
        own = of
        if g == 0:
            own = (F.when((of == TEXT) & (copy == 1), BY_OWN[EDITED]).when((of == TEXT) & (copy == 2), BY_OWN[NEXT])
                   .when((of == EDITED) & (copy == 1), BY_OWN[EDITED]).when(of == NEXT, BY_OWN[NEXT]).otherwise(of))
        taken = F.when(F.col("alone"), F.when(copy == 0, F.lit(1).cast("long")).otherwise(-n))
        if g == 0:
            taken = taken.when((of == EDITED) & (copy == 1) | (of == NEXT), -n)
        none, digest_found = F.lit(0).cast("long"), F.col("alone") & (copy == 0)
        cells = rows.select(
            "bucket", "k", "info", own.cast("int").alias("of"), "cells", F.col("to").alias("part"),
            F.when(digest_found, x if whole else none).when(F.col("alone"), F.shiftrightunsigned("at", 3)).otherwise(F.col("segment")).alias("segment"),
            F.when(digest_found, F.when(n > 0, 0).otherwise(1)).when(F.col("alone"), F.col("at").bitwiseAND(SEGMENT - 1).cast("int")).otherwise(j).alias("j"),
            taken.otherwise(n).alias("n"), F.when(digest_found, none).otherwise(x).alias("x"))
    return _sums(cells)


def compared(rows: DataFrame, larger: int = 1) -> DataFrame:
    """bucket, k, info, the texts of both fingerprints, and for the edited and the
    next text: 0 if the fingerprints told the difference, 1 if the larger sketch
    did, NULL if none, and how many digests are only in one version."""
    sums = peeled(sketches(rows, larger))
    of, part = F.col("of"), F.col("part")
    hexed = F.concat_ws(",", *[F.concat(F.hex(F.col(f"n{j}")), F.lit("."), F.lower(F.hex(F.col(f"x{j}")))) for j in range(SEGMENT)])
    printed = (of <= EDITED) & (part < PARTS)
    ways = {f"{name}_{k}": sketch for k, kind in enumerate((BY_OWN, BY_SIZE)) for name, sketch in (("edited", kind[EDITED]), ("next", kind[NEXT]))}
    counts = [c for name, w in ways.items() for c in (
        F.sum(F.when((of == w) & (part == FOUND), F.col("n0") + F.col("n1")).otherwise(0)).alias(f"found_{name}"),
        F.sum(F.when((of == w) & (part < PARTS) & _left_over(), 1).otherwise(0)).alias(f"left_{name}"))]
    sums = sums.groupBy("bucket", "k", "info", F.when(printed, of).alias("of"), F.when(printed, part).alias("part"), F.when(printed, hexed).alias("text")).agg(*counts)
    # a few rows for each document are left
    empty = ",".join(["0.0"] * SEGMENT)
    texts = [F.concat_ws(",", *[F.coalesce(F.max(F.when((F.col("of") == v) & (F.col("part") == p), F.col("text"))), F.lit(empty)) for p in range(PARTS)]).alias(c)
             for v, c in ((TEXT, "fingerprint"), (EDITED, "edited_fingerprint"))]
    got = sums.groupBy("bucket", "k").agg(F.max("info").alias("info"), *texts, *[F.sum(f"{a}_{w}").alias(f"{a}_{w}") for w in ways for a in ("found", "left")])
    out = ["bucket", "k", "info", "fingerprint", "edited_fingerprint"]
    for name in ("edited", "next"):
        own, sized = F.col(f"left_{name}_0") == 0, F.col(f"left_{name}_1") == 0
        out += [F.when(own, 0).when(sized, 1).alias(f"way_{name}"), F.when(own, F.col(f"found_{name}_0")).when(sized, F.col(f"found_{name}_1")).alias(f"differ_{name}")]
    return got.select(*out)


def recovered(rows: DataFrame, larger: int = 1) -> DataFrame:
    """bucket, k, which ('edited' or 'next'), only_text, only_other, whole: the
    digests that the larger sketches give away, and whether nothing is left."""
    sums = peeled(sketches(rows, larger), whole=True).filter(F.col("of").isin(*BY_SIZE.values()))
    part = F.col("part")
    which = F.when(F.col("of") == BY_SIZE[EDITED], "edited").otherwise("next").alias("which")
    return sums.groupBy("bucket", "k", which).agg(
        F.collect_list(F.when((part == FOUND) & (F.col("n0") > 0), F.col("segment"))).alias("only_text"),
        F.collect_list(F.when((part == FOUND) & (F.col("n1") > 0), F.col("segment"))).alias("only_other"),
        (F.sum(F.when((part < PARTS) & _left_over(), 1).otherwise(0)) == 0).alias("whole"))


def with_versions(rows: DataFrame) -> DataFrame:
    """bucket, k, info and the digests a, e, b of the text, its edited version and
    the next one, of rows (bucket, k, doc_id, text, digests, next_*)."""
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    tail = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - tail).cast("int")), F.substring("next_text", F.lit(1), tail))
    rows = rows.withColumn("edited", edited)
    rows = rows.select("bucket", "k", "doc_id", "next_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                       F.xxhash64("text").alias("h"), F.xxhash64("next_text").alias("next_h"),
                       F.col("digests").alias("a"), digests(F.col("edited")).alias("e"), F.col("next_digests").alias("b"))
    info = F.struct("doc_id", "next_id", "n_chars", "edited_sha256", "h", "next_h", F.size("a").alias("a"), F.size("e").alias("e"), F.size("b").alias("b"))
    return rows.select("bucket", "k", info.alias("info"), "a", "e", "b")


def _again(docs: DataFrame, failed: DataFrame) -> DataFrame:
    """The rows of ``failed`` with their texts and the next ones, read once more."""
    texts = docs.select("doc_id", whole_text().alias("text")).withColumn("h", F.xxhash64("text"))
    ids = failed.select("bucket", "k", "info.*")
    one = texts.join(ids.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).distinct(),
                     F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left_semi").distinct()
    two = texts.join(ids.select(F.col("next_id").alias("_id"), F.col("next_h").alias("_h")).distinct(),
                     F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left_semi").distinct()
    keys = ids.select("bucket", "k", F.col("doc_id").alias("_id"), F.col("h").alias("_h"), F.col("next_id").alias("_next"), F.col("next_h").alias("_next_h"))
    rows = keys.join(one, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h"))).drop("h")
    two = two.select(F.col("doc_id").alias("next_id"), F.col("text").alias("next_text"), F.col("h").alias("next_h"))
    rows = rows.join(two, F.col("next_id").eqNullSafe(F.col("_next")) & (F.col("next_h") == F.col("_next_h")))
    rows = rows.withColumns({"digests": digests(F.col("text")), "next_digests": digests(F.col("next_text"))})
    return rows.select("bucket", "k", "doc_id", "text", "digests", "next_id", "next_text", "next_digests").repartition("bucket")


def likeness(differ: str, a: str, b: str) -> Column:
    total = F.col(a) + F.col(b)
    return F.when(total == 0, 1.0).otherwise(1 - F.col(differ).cast("double") / total)


def with_next(docs: DataFrame) -> DataFrame:
    """bucket, k (the row's place in it), doc_id, text, digests of every row, and
    next_id, next_text, next_digests of the row after it; partitioned by bucket."""
    rows = docs.select("doc_id", whole_text().alias("text")).withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)))
    size = docs.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    buckets = max(1, (size[0] or 0) // BUCKET_BYTES)
    coarse, fine = min(COARSE, buckets), min(FINE, -(-buckets // COARSE))
    at = [i / coarse for i in range(coarse + 1)]
    found = rows.agg(F.percentile_approx("_id", F.array(*map(F.lit, at)), 10 * COARSE), F.min("_id"), F.max("_id")).first()
    bounds = sorted({found[1], *(found[0] or []), found[2]}) if size[1] else [0]
    edges = F.array(*[F.lit(b).cast("long") for b in bounds])

    def bucket(k: Column) -> Column:
        ends = F.struct(F.element_at(edges, k).cast("double").alias("low"),
                        F.element_at(edges, F.least(k + 1, F.lit(len(bounds)))).cast("double").alias("high"))
        share = let(ends, lambda e: F.when(e["high"] > e["low"], (F.col("_id") - e["low"]) / (e["high"] - e["low"])).otherwise(0.0))
        return k.cast("long") * FINE + F.least(F.floor(share * fine), F.lit(fine - 1))

    rows = rows.withColumn("_bucket", let(F.size(F.filter(edges, lambda e: e <= F.col("_id"))), bucket))
    # one row a bucket: its first id goes to the bucket before as well, the very first one to the last
    order = Window.orderBy("_bucket")
    firsts = rows.groupBy("_bucket").agg(F.min("_id").alias("_first"))
    last = firsts.agg(F.max("_bucket").alias("l")).first()["l"]
    firsts = firsts.select(F.col("_first").alias("_id"), F.coalesce(F.lag("_bucket").over(order), F.lit(last)).alias("_before"))
    rows = rows.join(F.broadcast(firsts), "_id", "left")  # COARSE * FINE rows at most
    rows = rows.withColumn("digests", digests(F.col("text"))).withColumn("_to", F.explode(F.array(
        F.struct(F.lit(0).alias("extra"), F.col("_bucket").alias("bucket")),
        F.struct(F.lit(1).alias("extra"), F.col("_before").alias("bucket"))))).filter("_to.bucket IS NOT NULL")
    rows = rows.withColumns({"bucket": F.col("_to.bucket"), "_extra": F.col("_to.extra")})
    window = Window.partitionBy("bucket").orderBy("_extra", "_id", "text")
    rows = rows.select("bucket", F.row_number().over(window).alias("k"), "doc_id", "text", "digests", "_extra",
                       *[F.lead(c).over(window).alias(n) for c, n in (("doc_id", "next_id"), ("text", "next_text"), ("digests", "next_digests"))])
    return rows.filter("_extra = 0").drop("_extra")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, tries."""
    done, size = [], 1
    got = written(compared(with_versions(with_next(docs))), "fingerprints")
    for attempt in range(RETRIES + 1):
        told = F.col("way_edited").isNotNull() & F.col("way_next").isNotNull()
        tries = F.greatest("way_edited", "way_next") if attempt == 0 else F.lit(attempt + 1)
        done.append(got.filter(told).withColumn("tries", tries))
        failed = got.filter(~told)
        if failed.isEmpty():
            break
        rows = with_versions(_again(docs, failed))
        if attempt < RETRIES:
            size *= LARGER
            got = written(compared(rows, size), "fingerprints-again")
        else:
            exact = rows.select("bucket", "k", *[
                (F.size(F.array_except("a", other)) + F.size(F.array_except(other, "a"))).cast("long").alias(f"exact_{name}")
                for other, name in (("e", "edited"), ("b", "next"))])
            last = failed.join(exact, ["bucket", "k"])
            done.append(last.select("bucket", "k", "info", "fingerprint", "edited_fingerprint", "way_edited", F.col("exact_edited").alias("differ_edited"),
                                    "way_next", F.col("exact_next").alias("differ_next"), F.lit(-1).alias("tries")))
    rows = done[0]
    for more in done[1:]:
        rows = rows.unionByName(more)
    rows = rows.select("info.*", "fingerprint", "edited_fingerprint", "differ_edited", "differ_next", "tries")
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                       likeness("differ_edited", "a", "e").alias("near_edited"), likeness("differ_next", "a", "b").alias("near_next"), "tries")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, compared with an edited text's and the
    next document's."""
    return fingerprints(documents(spark, sf_dir))
