import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# names that operators add or use inside
CLASH = ("score", "kept", "keep_id", "component_id", "copy", "rate", "sid", "h", "row", "n", "_text", "held_out", "rank", "token",
         "_key", "_source", "_parts", "_cdf", "_salt", "_salt0", "bucket", "k", "info", "digests")

PROSE = ("The quick brown fox jumps over the lazy dog and runs far away into the green forest near the old river bank "
         "where many other animals live together in peace until the winter comes and covers everything with white snow")


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows."""
    long = " ".join(f"word{i % 977} w{i % 31}." for i in range(30_000))
    rows = [
        (1, PROSE, "en", "a", 1), (2, PROSE, "en", "a", 1), (2, PROSE, "en", "a", 1),          # equal texts, a repeated row
        (3, PROSE + " today", "en", "b", 1), (4, PROSE.upper(), None, None, None),              # near and case copies
        (5, None, "en", "a", 0), (6, "", "fr", "a", 0), (7, "   \n\t ", "fr", "b", 3),          # null, empty, white space
        (8, long, "de", "b", len(long)), (9, "x" * 200_000, "de", "b", 200_000),                # very long, no white space
        (None, "ein kurzer Satz ohne Nummer, aber mit Wörtern", "de", None, 44), (10, "été là-bas", "fr", "c", 10),
        (11, "one two", "en", "c", 7), (12, "one two", "en", "c", 7), (13, "123 456 !!", None, "c", 10),
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3, F.coalesce("doc_id", F.lit(0)))


@pytest.fixture(scope="session")
def wide(edge):
    """The same with columns that clash with names used inside."""
    return edge.select("*", *[F.lit("z").alias(c) for c in CLASH])


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
