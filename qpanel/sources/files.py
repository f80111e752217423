"""CSV panels, prediction files and sinks.

Readers use explicit schemas (no inference pass over the data): the
header is read once to find the period columns, then the file is read
with descriptors as text and periods as doubles.  ``NA`` stays text
(Q2): only empty fields are NULL.
"""
from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qpanel import schema as S
from qpanel.functions.dates import label_to_quarter_end
from qpanel.functions.numeric import finite_or_null
from qpanel.operators.clean import require_columns
from qpanel.operators.reshape import make_uid, split_uid


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV file (header only, no type inference)."""
    return spark.read.option("header", True).csv(path).columns


def read_panel(spark: SparkSession, path: str, period_re: str = S.QUARTER_COL_RE) -> DataFrame:
    """A wide CSV with text descriptors and one double column per
    period (names matching ``period_re`` after trimming)."""
    cols = csv_header(spark, path)
    schema = T.StructType([
        T.StructField(c, T.DoubleType() if re.match(period_re, c.strip()) else T.StringType())
        for c in cols])
    df = (spark.read.option("header", True).option("nullValue", "").option("nanValue", "NaN")
          .option("mode", "PERMISSIVE").schema(schema).csv(path))
    return df.toDF(*[c.strip() for c in cols])


def read_long(spark: SparkSession, path: str) -> DataFrame:
    """Long panel CSV (ds, unique_id, y) with ds parsed as a date."""
    schema = "ds string, unique_id string, y double"
    df = spark.read.option("header", True).schema(schema).csv(path)
    return df.select(F.expr("try_cast(ds AS DATE)").alias(S.DS), S.UID, finite_or_null(S.Y).alias(S.Y))


# ---------------------------------------------------------------------------
# Column aliases of the prediction files of each model family.
ACTUAL_ALIASES = ["actual", "y_true", "y", "value", "exposure"]
FORECAST_ALIASES = ["forecast", "y_pred", "yhat", "prediction", "exposure_pred"]
KEY_COLS = ["L_REP_CTY", "L_CP_COUNTRY", "CBS_BASIS"]
LAYOUTS = {
    # model family: (date column, how to read it, id columns, actual, forecast)
    "arima": ("ds", "date", None, ["actual"], ["forecast"]),
    "lightgbm": ("period", "quarter", KEY_COLS, ACTUAL_ALIASES, FORECAST_ALIASES),
    "lightgbm_iterative": ("period", "quarter", KEY_COLS, ["exposure"], ["exposure_pred"]),
    "naive": ("ds", "date", None, ACTUAL_ALIASES, FORECAST_ALIASES),
    "seasonal_naive": ("ds", "date", None, ["y"], ["SeasonalNaive"]),
    "seasonal_wa": ("ds", "date", None, ["y"], ["SeasWA"]),
    "sequence": ("row", "row", None, ACTUAL_ALIASES, FORECAST_ALIASES),
}
MODEL_TO_READER = {
    "arima": "arima", "lightgbm": "lightgbm", "lightgbm_iterative": "lightgbm_iterative",
    "naive": "naive", "seasonal_naive": "seasonal_naive",
    "seasonal_window_average": "seasonal_wa",
}
SEQUENCE_PREFIXES = ("lstm1_", "lstm2_", "vector_lstm_", "lstm_blocks_")
# ---------------------------------------------------------------------------


def _quarter_text_end(c: str):
    """'2020Q1' or '2020-Q1' -> quarter-end date."""
    lab = F.regexp_replace(F.col(c).cast("string"), r"^(\d{4})-?Q([1-4])$", "$1-Q$2")
    return label_to_quarter_end(lab)


def read_predictions(spark: SparkSession, path: str, layout: str, sep: str = "_",
                     meta: DataFrame | None = None) -> DataFrame:
    """Any prediction file -> (ds, unique_id, key1, key2,
    key3, actual, forecast).  The first alias present names each value
    column (S8); a file without one, or without its id columns, raises
    ``ValueError`` (P21).  Text that is no number or date is NULL (P24).
    The row-indexed layout (S7) takes ids and dates from ``meta`` (row,
    unique_id, ds) by its explicit row column (J3, Q11)."""
    date_col, kind, ids, act, fc = LAYOUTS[layout]
    df = spark.read.option("header", True).csv(path)
    cols = df.columns

    def pick(aliases, what):
        for a in aliases:
            if a in cols:
                return a
        raise ValueError(f"no {what} column in {path}; columns are {cols}")
    a, f = pick(act, "actual"), pick(fc, "forecast")
    require_columns(df, ids or ([date_col, S.UID] if kind != "row" else [date_col]))
    if kind == "row":
        if meta is None:
            raise ValueError(f"layout {layout!r} needs the metadata of its rows")
        df = attach_keys(df.withColumn(date_col, F.expr(f"try_cast(`{date_col}` AS BIGINT)")), meta, date_col)
        ds = F.col(S.DS)
    else:
        ds = (F.expr(f"try_cast(`{date_col}` AS DATE)") if kind == "date"
              else _quarter_text_end(date_col))  # bad text -> NULL, never an ANSI error
    if ids:
        df = make_uid(df, ids, sep)
    out = df.select(ds.alias(S.DS), F.col(S.UID).cast("string").alias(S.UID),
                    finite_or_null(F.expr(f"try_cast(`{a}` AS DOUBLE)")).alias("actual"),
                    finite_or_null(F.expr(f"try_cast(`{f}` AS DOUBLE)")).alias("forecast"))
    return split_uid(out, ["key1", "key2", "key3"], sep) \
        .select(S.DS, S.UID, "key1", "key2", "key3", "actual", "forecast")


def check_files(spark: SparkSession, files: dict[str, tuple[str, list[str]]], fmt: str = "csv") -> DataFrame:
    """P21 as data: for each file (name -> (path, required columns)) whether it
    is refused, its missing columns in the stated order (comma-joined, NULL if
    none) and the rows of those accepted.  Headers are read on the driver, rows
    are counted by Spark; a path that does not exist raises."""
    out = None
    for name, (path, required) in files.items():
        df = spark.read.option("header", True).format(fmt).load(path)
        missing = [c for c in required if c not in df.columns]
        count = F.lit(None).cast("long") if missing else F.count(F.lit(1))
        one = (spark.range(1) if missing else df).agg(count.alias("rows")).select(
            F.lit(name).alias("file"), F.lit(bool(missing)).alias("refused"),
            F.lit(",".join(missing) or None).cast("string").alias("missing"), "rows")
        out = one if out is None else out.unionByName(one)
    if out is None:
        return spark.createDataFrame([], "file string, refused boolean, missing string, rows long")
    return out


def attach_keys(row_preds: DataFrame, meta: DataFrame, row: str = "row") -> DataFrame:
    """Row-indexed predictions get (unique_id, ds) from a metadata
    table by an explicit row key column (never by file position, Q11)."""
    return row_preds.drop(S.UID, S.DS).join(meta.select(row, S.UID, S.DS), row, "left")


def reader_of(model: str) -> str:
    """The layout of a model's file; the sequence-model family shares one."""
    if model in MODEL_TO_READER:
        return MODEL_TO_READER[model]
    if model.startswith(SEQUENCE_PREFIXES):
        return "sequence"
    raise ValueError(f"no reader for model {model!r}")


def read_all_predictions(spark: SparkSession, files: dict[str, str], meta: DataFrame | None = None) -> DataFrame:
    """S11 + U1: every model's file through its reader, stacked."""
    out = None
    for model, path in files.items():
        d = read_predictions(spark, path, reader_of(model), meta=meta) \
            .withColumn("model", F.lit(model))
        out = d if out is None else out.unionByName(d)
    return out


# ---------------------------------------------------------------------------
# Sinks.

def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None) -> None:
    """S14 (overwrite) / S15 (append) / S16 (one folder per method)."""
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def write_text(path: str, text: str) -> None:
    """One small text file of a given name on any file system (a report or a
    timing file; Spark names its own files)."""
    from pyarrow import fs
    system, inner = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(inner) as out:
        out.write(text.encode())


def save_model(model, path: str) -> None:
    """Persist a fitted ``pyspark.ml`` model or pipeline."""
    model.write().overwrite().save(path)


def write_panel(panel: DataFrame, path: str, ds: str = S.DS, mode: str = "overwrite") -> None:
    """Store a long panel partitioned by year of ``ds`` so that date-bounded
    reads prune whole folders (partition pruning, SURVEY §4)."""
    (panel.withColumn("year", F.year(ds)).repartition("year")
     .write.mode(mode).partitionBy("year").parquet(path))


def read_panel_range(spark: SparkSession, path: str, start: str | None = None,
                     end: str | None = None, ds: str = S.DS) -> DataFrame:
    """Read a year-partitioned panel between two dates (inclusive); the
    bounds are also stated on ``year`` so only those folders are listed and
    read, and on ``ds`` for the exact cut (pushed to the parquet reader)."""
    df = spark.read.parquet(path)
    if start is not None:
        df = df.filter((F.col("year") >= int(start[:4])) & (F.col(ds) >= F.to_date(F.lit(start))))
    if end is not None:
        df = df.filter((F.col("year") <= int(end[:4])) & (F.col(ds) <= F.to_date(F.lit(end))))
    return df
