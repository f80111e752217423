"""Wide <-> long reshaping and composite ids."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qpanel import schema as S
from qpanel.functions.dates import label_to_quarter_end, quarter_label
from qpanel.functions.numeric import finite_or_null


def wide_to_long(df: DataFrame, id_cols, value_cols, keep_nulls: bool = True,
                 var: str = "quarter", value: str = S.Y) -> DataFrame:
    """R1 (keep_nulls) / R2 (drop NULL, NaN): one row per id x period.

    ``unpivot`` is a row-local Expand, so this adds no shuffle.  Adds ``ds``
    (quarter-end date) parsed from the column name.
    """
    v = [f"`{c}`" for c in value_cols]
    long = (df.select(*[F.col(f"`{c}`") for c in id_cols],
                      *[F.col(c).cast("double").alias(c.strip("`")) for c in v])
            .unpivot(list(id_cols), list(value_cols), var, value))
    if not keep_nulls:
        long = long.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value)))
    return long.withColumn(S.DS, label_to_quarter_end(var))


def long_to_wide(df: DataFrame, id_cols, quarters: list[str],
                 ds: str = S.DS, value: str = S.Y) -> DataFrame:
    """Inverse of R1: one column per 'YYYY-Qn' label of the list.

    ``calendar_labels`` gives the list that holds every cell; cells outside
    the list have no column.  The pivot is a single aggregate of conditional maxima (one value per
    cell) keyed by the ids: one shuffle, deterministic.
    """
    d = df.withColumn("_q", quarter_label(ds))
    return d.groupBy(*id_cols).agg(*[F.max(F.when(F.col("_q") == q, F.col(value))).alias(q)
                                     for q in quarters])


def calendar_labels(df: DataFrame, ds: str = S.DS) -> list[str]:
    """Labels from the first to the last quarter of the data (one scalar
    aggregate)."""
    lo, hi = df.select(quarter_label(F.min(ds)), quarter_label(F.max(ds))).first()
    return quarter_labels(lo, hi) if lo else []


def quarter_labels(start: str, end: str) -> list[str]:
    """Calendar of 'YYYY-Qn' labels between two labels (inclusive)."""
    y0, q0 = int(start[:4]), int(start[-1])
    y1, q1 = int(end[:4]), int(end[-1])
    out = []
    i, j = y0 * 4 + q0 - 1, y1 * 4 + q1 - 1
    while i <= j:
        out.append(f"{i // 4}-Q{i % 4 + 1}")
        i += 1
    return out


def make_uid(df: DataFrame, keys=S.KEYS, sep: str = "_", out: str = S.UID) -> DataFrame:
    """Composite id from the key columns."""
    return df.withColumn(out, F.concat_ws(sep, *keys))


def split_uid(df: DataFrame, keys=S.KEYS, sep: str = "_", col: str = S.UID) -> DataFrame:
    """Key columns back from the composite id (NULL if short)."""
    parts = F.split(F.col(col), rf"\Q{sep}\E")
    return df.select("*", *[F.try_element_at(parts, F.lit(i + 1)).alias(k)
                            for i, k in enumerate(keys)])


def standardize_predictions(df: DataFrame, id_cols=S.KEYS, sep: str = "_",
                            actual: str = "actual", forecast: str = "forecast") -> DataFrame:
    """Fixed record (ds, unique_id, keys..., actual, forecast).

    Builds ``unique_id`` from the keys when absent, or the keys from the id.
    """
    if S.UID not in df.columns:
        df = make_uid(df, id_cols, sep)
    missing = [k for k in id_cols if k not in df.columns]
    if missing:
        df = split_uid(df, missing if len(missing) == len(id_cols) else id_cols, sep)
    return df.select(F.to_date(S.DS).alias(S.DS), S.UID, *id_cols,
                     finite_or_null(actual).alias("actual"),
                     finite_or_null(forecast).alias("forecast"))


def explode_steps(df: DataFrame, keys, actual_arr: str = "actuals",
                  forecast_arr: str = "forecasts") -> DataFrame:
    """Arrays of per-step values -> one row per step."""
    z = F.arrays_zip(F.col(actual_arr).alias("actual"), F.col(forecast_arr).alias("forecast"))
    return (df.select(*keys, F.posexplode(z).alias("pos", "z"))
            .select(*keys, (F.col("pos") + 1).alias("step"),
                    F.col("z.actual").alias("actual"), F.col("z.forecast").alias("forecast")))


def series_arrays(df: DataFrame, key: str = S.UID, ds: str = S.DS,
                  value: str = S.Y) -> DataFrame:
    """One row per series with its values ordered by date.

    The array length is bounded by the calendar (quarters per series), not
    by the data volume, so the per-group buffer stays small.
    """
    return (df.groupBy(key)
            .agg(F.sort_array(F.collect_list(F.struct(ds, value))).alias("_s"))
            .select(key, F.col("_s")[ds].alias("dates"),
                    F.col("_s")[value].alias("values")))
