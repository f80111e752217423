"""Output shaping shared by the registered queries."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def round_doubles(df: DataFrame, digits: int = 4,
                  overrides: dict[str, int] | None = None) -> DataFrame:
    """Round every double column (sums are order-dependent across engines);
    ``overrides`` gives other digit counts for named columns."""
    ov = overrides or {}
    return df.select(*[
        (F.round(F.col(f"`{f.name}`"), ov.get(f.name, digits)) + F.lit(0.0)).alias(f.name)
        if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`")
        for f in df.schema.fields])
