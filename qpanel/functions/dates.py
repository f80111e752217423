"""Quarter arithmetic as Column expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def quarter_start(c) -> Column:
    """First day of the quarter holding ``c`` (date or timestamp)."""
    return F.trunc(F.to_date(_col(c)), "quarter")


def quarter_end(c) -> Column:
    """Last day of the quarter holding ``c``; idempotent on quarter ends."""
    return F.last_day(F.add_months(quarter_start(c), 2))


def quarter_label(c) -> Column:
    """'YYYY-Qn' label of a date."""
    d = F.to_date(_col(c))
    return F.format_string("%d-Q%d", F.year(d), F.quarter(d))


def label_to_quarter_end(c) -> Column:
    """'YYYY-Qn' -> quarter-end date (NULL for text that is no label)."""
    lab = _col(c)
    ok = lab.rlike(r"^\d{4}-Q[1-4]$")
    y = F.substring(lab, 1, 4).cast("int")
    q = F.substring(lab, 7, 1).cast("int")
    return F.when(ok, F.last_day(F.make_date(y, q * 3, F.lit(1))))


def quarter_index(c) -> Column:
    """Integer year*4 + quarter - 1: consecutive quarters differ by 1."""
    d = F.to_date(_col(c))
    return F.year(d) * 4 + F.quarter(d) - 1


def seconds_to_hms(c) -> Column:
    """Seconds -> struct(h, m, s) of whole numbers."""
    s = F.floor(_col(c)).cast("long")
    return F.struct(
        F.floor(s / 3600).cast("long").alias("h"),
        F.floor((s % 3600) / 60).cast("long").alias("m"),
        (s % 60).cast("long").alias("s"),
    )
