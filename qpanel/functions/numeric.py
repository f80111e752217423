"""Null-safe numeric helpers."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite_or_null(c) -> Column:
    """NaN, +inf and -inf become NULL; the panel knows only NULL as missing."""
    x = _col(c)
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)) \
        .otherwise(x).cast("double")


def clip(c, lower=None, upper=None) -> Column:
    """Bound a value; NULL stays NULL (greatest/least would skip it)."""
    x = _col(c)
    out = x
    if lower is not None:
        out = F.when(out.isNull(), None).otherwise(F.greatest(out, F.lit(lower) if not isinstance(lower, Column) else lower))
    if upper is not None:
        out = F.when(out.isNull(), None).otherwise(F.least(out, F.lit(upper) if not isinstance(upper, Column) else upper))
    return out


def safe_div(num, den) -> Column:
    """num / den, NULL when den is 0 or NULL (ANSI-safe)."""
    return F.try_divide(_col(num), _col(den))
