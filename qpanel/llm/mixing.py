"""Mixing sources to target weights by Poisson replication.

Every source gets a mean repetition rate: target rows of the source divided
by its rows.  A document's number of copies is a Poisson draw with that mean,
found by inverting the distribution function at a uniform number hashed from
(seed, doc_id), so a rerun or a retried task draws the same.  Copies are
exploded and dealt out by a hash of (seed, doc_id, copy): the whole result is
one pseudo-random permutation, in one shuffle.

Rates above ``PART`` are split into equal parts, each drawn on its own (a sum
of independent Poisson draws is a Poisson draw), so exp(-rate) never vanishes.

Only the per-source table is gathered; it is broadcast when it has at most
``BROADCAST_SOURCES`` rows, else joined on (source, salt) so that a hot source
spreads over ``SALTS`` tasks.

Edge cases: a NULL source is a source of its own; a NULL text is kept as is; a
NULL doc_id hashes as the empty string; repeated rows with one doc_id draw the
same number; a source without a weight (or weight 0) gets no copies; an empty
table gives an empty table; extra columns are carried along, and a column
called like an added one is replaced.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from qpanel.llm.common import documents, unused, written

SEED = "mix-1"
PART = 16.0
TAIL = 64              # largest count of one part; P(more | mean 16) < 1e-17
BROADCAST_SOURCES = 50_000
SALTS = 64
ADDED = ("copy", "n_copies", "rate", "shuffle_key")


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of an md5."""
    digest = F.md5(F.concat_ws(":", *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52) + 0.5 ** 53


def source_rates(docs: DataFrame, weights: DataFrame | None = None, total: int | None = None) -> DataFrame:
    """(source, rate, parts, cdf): ``weights`` is (source, weight long); the
    default is the square root of a source's rows, which flattens hot ones.
    ``total``: expected rows of the mix, by default the rows there are."""
    counts = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        counts = counts.withColumn("w", F.floor(F.sqrt("n") * 1e6).cast("long"))
    else:
        w = weights.select(F.col("source").alias("_s"), F.col("weight").cast("long").alias("_w"))
        counts = counts.join(w, counts.source.eqNullSafe(w._s), "left").select(
            "source", "n", F.coalesce("_w", F.lit(0)).alias("w"))
    counts = written(counts, "mix-sources")
    all_w, all_n = counts.agg(F.sum("w"), F.sum("n")).first()
    goal = float(all_n if total is None else total) if all_w else 0.0
    rate = F.lit(goal) * F.col("w").cast("double") / float(all_w or 1) / F.col("n").cast("double")
    counts = counts.withColumn("rate", rate).withColumn(
        "parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART)).cast("int"))
    mean = F.col("rate") / F.col("parts")
    # running sums of exp(-m) * m^k / k!, for k = 0 .. TAIL
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("c"))
    step = lambda acc, k: F.struct(
        (acc["p"] * mean / k).alias("p"),
        F.concat(acc["c"], F.array(F.element_at(acc["c"], -1) + acc["p"] * mean / k)).alias("c"))
    cdf = F.aggregate(F.sequence(F.lit(1), F.lit(TAIL)), start, step, lambda acc: acc["c"])
    return counts.select("source", "rate", "parts", cdf.alias("cdf"))


def mix_sources(docs: DataFrame, weights: DataFrame | None = None, total: int | None = None,
                seed: str = SEED) -> DataFrame:
    """``docs`` with each row repeated its Poisson number of times, plus copy
    (1, 2, ...), n_copies, rate and shuffle_key, dealt out by shuffle_key."""
    rows = docs.drop(*ADDED)
    rates = written(source_rates(rows, weights, total), "mix-rates")
    source, parts, cdf, salt, own_salt = (unused(docs, c) for c in ("_source", "_parts", "_cdf", "_salt", "_salt0"))
    few = rates.count() <= BROADCAST_SOURCES
    right = rates.select(F.col("source").alias(source), "rate", F.col("parts").alias(parts), F.col("cdf").alias(cdf))
    ident = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    if few:
        joined = rows.join(F.broadcast(right), rows["source"].eqNullSafe(right[source]))
    else:
        right = right.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn(own_salt, F.pmod(F.xxhash64(ident), F.lit(SALTS)).cast("int"))
        joined = rows.join(right, rows["source"].eqNullSafe(right[source]) & (rows[own_salt] == right[salt])).drop(salt, own_salt)
    draw = lambda j: F.size(F.filter(cdf, lambda c: c < uniform(F.lit(seed), ident, j.cast("string"))))
    n = F.aggregate(F.sequence(F.lit(1), F.col(parts)), F.lit(0), lambda acc, j: acc + draw(j))
    copies = (joined.withColumn("n_copies", F.when(F.col("rate") > 0, n).otherwise(0).cast("long"))
              .filter("n_copies > 0")
              .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_copies"))))
              .withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(seed), ident, F.lit("copy"), F.col("copy").cast("string")).cast("binary"))))
    out = copies.select(*[c for c in docs.columns if c not in ADDED], "copy", "n_copies", "rate", "shuffle_key")
    return out.repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def op8_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table mixed to square-root source weights: one row per copy."""
    return mix_sources(documents(spark, sf_dir)).select(
        "doc_id", "source", "text", "copy", "n_copies", "rate", "shuffle_key")


def mix_sql(docs: str, columns: str) -> str:
    """DuckDB SQL of ``mix_sources`` over the relation ``docs``."""
    return f"""
WITH RECURSIVE d0 AS (SELECT * FROM {docs}),
cnt AS (SELECT source, count(*) AS n, CAST(floor(sqrt(count(*)) * 1e6) AS BIGINT) AS w FROM d0 GROUP BY source),
tot AS (SELECT CAST(sum(w) AS BIGINT) AS W_, CAST(sum(n) AS BIGINT) AS N_ FROM cnt),
rates AS (SELECT source, CAST(N_ AS DOUBLE) * CAST(w AS DOUBLE) / CAST(W_ AS DOUBLE) / CAST(n AS DOUBLE) AS rate FROM cnt, tot),
parts AS (SELECT *, CAST(greatest(1, ceil(rate / {PART})) AS INTEGER) AS parts FROM rates),
cdf(source, parts, rate, k, p, c) AS (
  SELECT source, parts, rate, 0, exp(-(rate / parts)), exp(-(rate / parts)) FROM parts
  UNION ALL
  SELECT source, parts, rate, k + 1, p * (rate / parts) / (k + 1), c + p * (rate / parts) / (k + 1) FROM cdf WHERE k < {TAIL}),
lists AS (SELECT source, parts, rate, list(c) AS cdf FROM cdf GROUP BY source, parts, rate),
drawn AS (
  SELECT d0.*, l.rate, l.parts, l.cdf, coalesce(CAST(d0.doc_id AS VARCHAR), '') AS ident
  FROM d0 JOIN lists l ON d0.source IS NOT DISTINCT FROM l.source),
counted AS (
  SELECT *, CAST(list_sum(list_transform(range(1, parts + 1), lambda j: len(list_filter(cdf, lambda c: c <
      CAST(CAST('0x' || substr(md5('{SEED}:' || ident || ':' || CAST(j AS VARCHAR)), 1, 13) AS BIGINT) AS DOUBLE) / {float(1 << 52)!r} + {0.5 ** 53!r})))) AS BIGINT) AS n_copies
  FROM drawn),
mixed AS (SELECT * EXCLUDE (parts, cdf, ident), md5('{SEED}:' || ident || ':copy:' || CAST(copy AS VARCHAR)) AS shuffle_key
  FROM (SELECT *, unnest(range(1, n_copies + 1)) AS copy FROM counted WHERE n_copies > 0))
SELECT {columns} FROM mixed"""


ORACLE = mix_sql("documents", "doc_id, source, text, copy, n_copies, rate, shuffle_key")
