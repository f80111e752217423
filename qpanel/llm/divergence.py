"""Source divergence audit: which sources of a language differ, and by which terms.

Terms are runs of ASCII letters and of code points from U+0080 on, A-Z
lower-cased.  A language keeps the terms found in at least ``MIN_DOCS`` of its
documents.  In a group (language, source) or in a whole language with N kept
occurrences and V kept terms, a term counted c times has the smoothed share

    p = 1 + floor(SCALE * (c + PRIOR) / (N + PRIOR * V))

in decimal arithmetic, exact whatever the counts.

* pairs: for each two sources of a language the sum of ``|p - q|`` over all
  kept terms.  Kept terms are dealt by hash to tiles of about ``TILE_TERMS``
  terms and ``TILE_SOURCES`` x ``TILE_SOURCES`` sources; a tile's matrix of
  shares gives all its sums, and tiles are added up.
* terms: for each group the ``TOP`` terms whose share exceeds the language's
  most.  A term with a higher count in the group, a lower count in the language
  and an earlier name than another (ties allowed) ranks before it, so only terms
  dominated by fewer than ``TOP`` others can be answers.  Each partition keeps
  that skyband of its rows and passes it on; the skybands meet, are thinned
  again, and what is left is ranked exactly.  A skyband over ``KEEP`` rows is
  passed on and a new one begun, so a task's memory is bounded and no answer
  is lost.

Texts are counted where they are read; a task adds up to ``HELD`` entries before
it passes them on, so a hot source or language reaches a shuffle as counts.

Edge cases: a NULL text, lang or source is ''.  A group without terms, or of a
language without kept terms, has pairs of value 0 and no term rows.  Very long
texts are counted in pieces, whole.  Repeated rows count as often as they occur;
doc_id is not read.  Ties rank by the item's UTF-8 bytes.  An empty table gives
an empty table; extra columns are ignored, whatever their names.
"""
from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from qpanel.llm.common import documents, whole_text, written

MIN_DOCS = 30
PRIOR = 5
SCALE = 1_000_000_000
TOP = 50
HELD = 400_000          # entries that a counting task holds before it passes them on
KEEP = 20_000           # rows of a group's skyband that a task holds
PIECE = 4 << 20         # bytes of a text that are split at once
TILE_TERMS, TILE_SOURCES = 4096, 256

# other ASCII bytes become blanks, A-Z lower case; bytes of other code points stay
_TERM = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def _terms(text: bytes) -> Iterator[list[bytes]]:
    """The text's terms, in lists of bounded size."""
    a = 0
    while a < len(text):
        b = min(len(text), a + PIECE)
        while b < len(text) and _TERM[text[b]] != 0x20:
            b += 1
        yield text[a:b].translate(_TERM).split(b" ")
        a = b


def count_terms(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with the term); and a
    row with the empty term for every group."""
    rows = docs.select(whole_text("lang").alias("lang"), whole_text("source").alias("source"),
                       whole_text("text").cast("binary").alias("text"))
    schema = "lang string, source string, term string, n bigint, docs bigint"

    def packed(held: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, d) in held.items():
            n[b""] = d[b""] = 0
            terms = list(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()),
                 pa.array(terms, pa.binary()).cast(pa.string()), pa.array([n[t] for t in terms], pa.int64()),
                 pa.array([d[t] for t in terms], pa.int64())], names=["lang", "source", "term", "n", "docs"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = defaultdict(lambda: (Counter(), Counter()))
        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                n, d = held[lang, source]
                own: set[bytes] = set()
                for terms in _terms(text.as_py()):
                    n.update(terms)
                    own.update(terms)
                d.update(own)
            if sum(len(n) for n, _ in held.values()) > HELD:
                yield from packed(held)
                held.clear()
        yield from packed(held)

    return rows.mapInArrow(counted, schema).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: str, total: str, kept: str) -> Column:
    """The smoothed share, as a long of at most SCALE + 1."""
    return F.expr(f"1 + (CAST({SCALE} AS decimal(20, 0)) * CAST({count} + {PRIOR} AS decimal(18, 0))) "
                  f"div (CAST({total} AS decimal(20, 0)) + CAST({PRIOR} * {kept} AS decimal(20, 0)))")


def skyband(count: np.ndarray, whole: np.ndarray, name: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the rows dominated by fewer than ``k`` others: count as high or
    higher, whole as low or lower, name as early or earlier (names differ)."""
    order = np.lexsort((name, whole, -count))       # whoever dominates a row stands before it
    whole, name = whole[order], name[order]
    kept: list[int] = []
    w, m = np.empty(len(order), whole.dtype), np.empty(len(order), np.int64)
    place = np.empty(len(order), np.int64)
    place[np.argsort(name, kind="stable")] = np.arange(len(order))
    for i in range(len(order)):
        # rows outside the skyband need not be counted: their own k dominators dominate this row too
        s = len(kept)
        if s < k or np.count_nonzero((w[:s] <= whole[i]) & (m[:s] <= place[i])) < k:
            w[s], m[s] = whole[i], place[i]
            kept.append(i)
    return order[kept]


def _thinned(df: DataFrame, k: int) -> DataFrame:
    """Rows (lang, source, term, n, whole) of each partition's skybands."""
    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], pa.Table] = {}

        def banded(part: pa.Table) -> pa.Table:
            name = np.array([t.encode() for t in part.column("term").to_pylist()], object)
            return part.take(skyband(part.column("n").to_numpy(), part.column("whole").to_numpy(), name, k))

        waiting: dict[tuple[str, str], list[pa.Table]] = defaultdict(list)
        for batch in batches:
            part = pa.Table.from_batches([batch]).combine_chunks()
            groups = part.select(["lang", "source"]).to_pylist()
            at: dict[tuple[str, str], list[int]] = defaultdict(list)
            for i, g in enumerate(groups):
                at[g["lang"], g["source"]].append(i)
            for g, rows in at.items():
                waiting[g].append(part.take(rows))
                if sum(p.num_rows for p in waiting[g]) >= KEEP // 4:
                    mine = banded(pa.concat_tables([*([held[g]] if g in held else []), *waiting.pop(g)]))
                    if mine.num_rows > KEEP:
                        yield from mine.combine_chunks().to_batches()
                        held.pop(g, None)
                    else:
                        held[g] = mine
            if sum(p.num_rows for p in held.values()) + sum(p.num_rows for ps in waiting.values() for p in ps) > 8 * KEEP:
                for g in list({**held, **waiting}):
                    mine = banded(pa.concat_tables([*([held.pop(g)] if g in held else []), *waiting.pop(g, [])]))
                    yield from mine.combine_chunks().to_batches()
        for g in list({**held, **waiting}):
            yield from banded(pa.concat_tables([*([held[g]] if g in held else []), *waiting.get(g, [])])).combine_chunks().to_batches()

    return df.mapInArrow(thin, df.schema)


def _pair_sums(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value of every two sources of a language that has
    kept terms.  ``groups``: lang, source, zero (share of a count of 0), v, sources."""
    tiles = F.greatest(F.lit(1), F.ceil(F.col("v") / TILE_TERMS)).cast("int")
    parts = F.ceil(F.col("sources") / TILE_SOURCES).cast("int")
    part = F.pmod(F.xxhash64("source"), F.col("parts")).cast("int")
    # a source's own part meets every part; both orders of a pair come from one tile
    meets = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(
        F.least(o, F.col("part")).alias("a"), F.greatest(o, F.col("part")).alias("b")))
    groups = groups.withColumn("tiles", tiles).withColumn("parts", parts).withColumn("part", part)
    left = (shares.join(groups.select("lang", "source", "zero", "tiles", "parts", "part"), ["lang", "source"])
            .withColumn("tile", F.pmod(F.xxhash64("term"), F.col("tiles")).cast("int")).withColumn("meet", F.explode(meets))
            .select("lang", "tile", "meet.a", "meet.b", "source", "term", "p"))
    right = (groups.withColumn("meet", F.explode(meets)).withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
             .select(F.col("lang").alias("of_lang"), F.col("tile").alias("of_tile"), F.col("meet.a").alias("of_a"), F.col("meet.b").alias("of_b"),
                     F.col("source").alias("of_source"), F.col("part").alias("of_part"), "zero"))

    def sums(rows: pa.Table, known: pa.Table) -> pa.Table:
        lang, source, item, value = [], [], [], []
        if known.num_rows and rows.num_rows:
            names = known.column("of_source").to_pylist()
            where = {s: i for i, s in enumerate(names)}
            terms = rows.column("term").combine_chunks().dictionary_encode()
            zero = known.column("zero").to_numpy()
            p = np.repeat(zero[:, None], len(terms.dictionary), axis=1)
            p[[where[s] for s in rows.column("source").to_pylist()], terms.indices.to_numpy()] = rows.column("p").to_numpy()
            a, b = known.column("of_a")[0].as_py(), known.column("of_b")[0].as_py()
            of = known.column("of_part").to_numpy()
            here, there = np.flatnonzero(of == a), np.flatnonzero(of == b)
            for i in here:
                total = np.abs(p[there] - p[i]).sum(axis=1)
                for j, t in zip(there, total, strict=True):
                    if i != j:
                        source.append(names[i])
                        item.append(names[j])
                        value.append(int(t))
                        if a != b:
                            source.append(names[j])
                            item.append(names[i])
                            value.append(int(t))
            lang = [known.column("of_lang")[0].as_py()] * len(source)
        return pa.table({"lang": pa.array(lang, pa.string()), "source": pa.array(source, pa.string()),
                         "item": pa.array(item, pa.string()), "value": pa.array(value, pa.int64())})

    pairs = left.groupBy("lang", "tile", "a", "b").cogroup(right.groupBy("of_lang", "of_tile", "of_a", "of_b"))
    found = pairs.applyInArrow(sums, "lang string, source string, item string, value bigint")
    return found.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit_sources(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank."""
    counts = written(count_terms(docs), "term-counts")
    # rows (lang, term) of a language are not split further: at most one row a source
    whole = counts.filter("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("whole"), F.sum("docs").alias("docs"))
    kept = whole.filter(F.col("docs") >= min_docs).select("lang", "term", "whole")
    rows = written(counts.filter("term <> ''").select("lang", "source", "term", "n").join(kept, ["lang", "term"])
                   .select("lang", "source", "term", "n", "whole"), "kept-terms")
    names = counts.filter("term = ''").select("lang", "source")
    langs = (rows.groupBy("lang", "term").agg(F.first("whole").alias("whole"))
             .groupBy("lang").agg(F.sum("whole").alias("lang_total"), F.count(F.lit(1)).alias("v")))
    sizes = names.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"))
    totals = rows.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = written(names.join(totals, ["lang", "source"], "left").join(sizes, "lang").join(langs, "lang", "left")
                     .select("lang", "source", "sources", F.coalesce("total", F.lit(0)).alias("total"), "lang_total", "v"), "groups")

    known = groups.filter("v IS NOT NULL").withColumn("zero", share("0", "total", "v"))
    shares = rows.join(known.select("lang", "source", "total", "v"), ["lang", "source"]).withColumn("p", share("n", "total", "v"))
    sums = _pair_sums(shares.select("lang", "source", "term", "p"), known)
    others = groups.select("lang", F.col("source").alias("item"))
    pairs = (groups.select("lang", "source").join(others, "lang").filter("source <> item")
             .join(sums, ["lang", "source", "item"], "left")
             .select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("bigint").alias("value")))

    band = _thinned(_thinned(rows, top).repartition("lang", "source", F.pmod(F.xxhash64("term"), F.lit(4))), top)
    terms = (band.join(known.select("lang", "source", "total", "lang_total", "v"), ["lang", "source"])
             .withColumn("value", share("n", "total", "v") - share("whole", "lang_total", "v")).filter("value > 0")
             .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [df.withColumn("rank", F.row_number().over(order)) for df in (pairs, terms)]
    return ranked[0].unionByName(ranked[1].filter(F.col("rank") <= top))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of sources and the terms that set each source apart, per language."""
    return audit_sources(documents(spark, sf_dir))


ORACLE = r"""
WITH docs AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
terms AS (SELECT k, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS whole FROM terms GROUP BY ALL HAVING count(DISTINCT k) >= 30),
grp AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n FROM terms SEMI JOIN kept USING (lang, term) GROUP BY ALL),
langs AS (SELECT lang, sum(whole)::HUGEINT AS lt, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
totals AS (SELECT grp.lang, grp.source, coalesce(sum(n), 0)::HUGEINT AS t FROM grp LEFT JOIN counts USING (lang, source) GROUP BY ALL),
p AS (SELECT lang, source, term, coalesce(n, 0) AS n,
        1 + (1000000000::HUGEINT * (coalesce(n, 0) + 5)) // (t + 5 * v) AS p,
        1 + (1000000000::HUGEINT * (whole + 5)) // (lt + 5 * v) AS q
      FROM totals JOIN langs USING (lang) JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM found)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
