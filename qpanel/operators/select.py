"""Row selection helpers: first-N series, samples, slices, null rules,
duplicates, history unions (S3/P22, T5, P15-P16, P19-P20, P24-P25, U2, U4,
J6, J7, A17)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qpanel import schema as S
from qpanel.functions.dates import quarter_label


def first_n_series(panel: DataFrame, n: int, key: str = S.UID) -> DataFrame:
    """The first ``n`` series in key order (a top-n of the
    distinct keys: each task keeps its own n, one merge), then a left-semi
    join keeps their rows."""
    keys = panel.select(key).distinct().orderBy(key).limit(n)
    # the key list has at most n rows: broadcast it only when n is small
    return panel.join(F.broadcast(keys) if n <= 1_000_000 else keys, key, "left_semi")


def hash_sample(df: DataFrame, fraction_hex: str = "1a", salt: str = "sample",
                key: str = S.UID, ds: str = S.DS) -> DataFrame:
    """T5: repeatable sample of cells: md5(salt|id|quarter) below a hex
    threshold ('1a' ~ 10.2 %).  Same rows on any engine and partitioning."""
    h = F.md5(F.concat_ws("|", F.lit(salt), F.col(key), quarter_label(ds)))
    return df.filter(F.substring(h, 1, 2) < F.lit(fraction_hex))


def nonzero(df: DataFrame, col: str = "actual") -> DataFrame:
    """Keep rows whose value is > 0."""
    return df.filter(F.col(col) > 0)


def drop_missing(df: DataFrame, cols) -> DataFrame:
    """Drop rows with a NULL in any of ``cols``."""
    return df.dropna(subset=list(cols))


def zero_as_missing(df: DataFrame, cols) -> DataFrame:
    """P20: 0 -> NULL in the named columns."""
    return df.select(*[F.nullif(F.col(c), F.lit(0.0)).alias(c) if c in cols else F.col(c)
                       for c in df.columns])


def fill_missing(df: DataFrame, cols, value: float = 0.0) -> DataFrame:
    """NULL -> value."""
    return df.na.fill(value, subset=list(cols))


def to_number(c) -> Column:
    """Text -> double, unparsable -> NULL (never an error)."""
    return F.expr(f"try_cast(`{c}` AS DOUBLE)") if isinstance(c, str) else c.try_cast("double")


def series_slice(df: DataFrame, uid: str, key: str = S.UID) -> DataFrame:
    """P25: the rows of one example series."""
    return df.filter(F.col(key) == uid)


def distinct_pairs(df: DataFrame, a: str = S.REP, b: str = S.CP) -> DataFrame:
    """U4: one row per (a, b)."""
    return df.select(a, b).dropDuplicates([a, b])


def history_union(train: DataFrame, predictions: DataFrame, key: str = S.UID,
                  ds: str = S.DS, value: str = S.Y) -> DataFrame:
    """Training history plus own predictions, one row per (series,
    quarter): a prediction never duplicates a known quarter (Q10)."""
    p = predictions.select(key, ds, F.col("forecast").alias(value)) \
        .join(train.select(key, ds), [key, ds], "left_anti")
    return train.select(key, ds, value).unionByName(p)


def align(actuals: DataFrame, forecasts: DataFrame, key: str = S.UID, ds: str = S.DS) -> DataFrame:
    """Outer alignment of actual and forecast series on the date."""
    return actuals.select(key, ds, F.col(S.Y).alias("actual")) \
        .join(forecasts.select(key, ds, "forecast"), [key, ds], "full_outer")


def horizon_of(test: DataFrame, ds: str = S.DS) -> int:
    """Number of distinct test quarters (one scalar aggregate)."""
    return int(test.agg(F.countDistinct(ds)).first()[0])
