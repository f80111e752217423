"""Cleaning and consolidation of the claims table.

Filters are plain predicates, so Catalyst combines them into one Filter and
pushes what it can into the scan.  ``filter_audit`` counts the rows each
step removes in a single pass (first failing step per row), instead of one
materialised copy per filter.
"""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qpanel import schema as S


def trim_columns(df: DataFrame) -> DataFrame:
    """Strip blanks around column names."""
    return df.toDF(*[c.strip() for c in df.columns])


def quarter_columns(df: DataFrame, rule: str = "strict") -> list[str]:
    """Names of the period columns of a wide table.

    ``strict``: ``^YYYY-Qn$``; ``suffix``: ends with -Q1..-Q4; ``contains``:
    has '-Q'; ``year``: mentions a year 2005..2024 (the cleaning rule).
    """
    cols = df.columns
    if rule == "strict":
        return [c for c in cols if re.match(S.QUARTER_COL_RE, c)]
    if rule == "suffix":
        return [c for c in cols if c.endswith(tuple(f"-Q{i}" for i in range(1, 5)))]
    if rule == "contains":
        return [c for c in cols if "-Q" in c]
    if rule == "year":
        return [c for c in cols if any(str(y) in c for y in range(2005, 2025))]
    raise ValueError(f"unknown rule {rule!r}")


def require_columns(df: DataFrame, cols) -> None:
    """Raise when any required column is missing."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")


def _norm(c) -> Column:
    return F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))


def is_aggregate_entity(col: str, entities=S.AGGREGATE_ENTITIES) -> Column:
    """True when the (lower, trimmed) name is an aggregate, not a country;
    NULL names count as ''."""
    return _norm(col).isin([e.lower().strip() for e in entities])


def exclude_entities(df: DataFrame, cols=("Reporting country", "Counterparty country"),
                     entities=S.AGGREGATE_ENTITIES) -> DataFrame:
    """Drop rows naming an aggregate entity in any of ``cols``."""
    cond = None
    for c in cols:
        e = ~is_aggregate_entity(c, entities)
        cond = e if cond is None else cond & e
    return df.filter(cond)


def any_value(cols) -> Column:
    """True when at least one of ``cols`` holds a value."""
    cols = list(cols)
    if len(cols) == 1:
        return F.col(f"`{cols[0]}`").isNotNull()
    return F.greatest(*[F.col(f"`{c}`").isNotNull() for c in cols])


def drop_all_null(df: DataFrame, cols) -> DataFrame:
    """Drop rows with no value in any of the time columns."""
    return df.filter(any_value(list(cols)))


def keep_unequal(col: str, value: str) -> Column:
    """P5: ``col != value`` that keeps NULLs (pandas semantics, Q1)."""
    return ~F.col(f"`{col}`").eqNullSafe(F.lit(value))


def keep_normalised_equal(col: str, value: str) -> Column:
    """lower(trim(col)) == value; NULL is dropped."""
    return F.lower(F.trim(F.col(f"`{col}`"))) == F.lit(value)


def keep_bank_types(col: str = "CBS_BANK_TYPE", types=S.BANK_TYPES) -> Column:
    """Membership in the bank types in scope (after upper/trim)."""
    return F.upper(F.trim(F.col(f"`{col}`"))).isin(list(types))


def cleaning_steps(df: DataFrame, time_cols=None) -> list[tuple[str, Column]]:
    """The ordered (step name, keep-predicate) list for the columns present."""
    steps: list[tuple[str, Column]] = []
    ent = [c for c in ("Reporting country", "Counterparty country") if c in df.columns]
    if ent:
        cond = None
        for c in ent:
            e = ~is_aggregate_entity(c)
            cond = e if cond is None else cond & e
        steps.append(("aggregate_entity", cond))
    tcols = list(time_cols) if time_cols is not None else quarter_columns(df, "year")
    if tcols:
        steps.append(("all_periods_missing", any_value(tcols)))
    for col, v in S.EXCLUDE_EQUAL.items():
        if col in df.columns:
            steps.append((f"{col} = {v}", keep_unequal(col, v)))
    for col, v in S.REQUIRE_NORMALISED.items():
        if col in df.columns:
            steps.append((f"{col} <> {v}", keep_normalised_equal(col, v)))
    if "CBS_BANK_TYPE" in df.columns:
        steps.append(("bank_type_out_of_scope", keep_bank_types("CBS_BANK_TYPE")))
    return steps


def clean_claims(df: DataFrame, time_cols=None) -> DataFrame:
    """P3-P7 in one conjunctive filter over the columns present."""
    df = trim_columns(df)
    cond = None
    for _, c in cleaning_steps(df, time_cols):
        cond = c if cond is None else cond & c
    return df if cond is None else df.filter(cond)


def filter_audit(df: DataFrame, time_cols=None) -> DataFrame:
    """P10: rows removed by each step (first failing step), plus 'kept'.

    One scan and one small aggregate; the removal counts per step add up
    to before - after, exactly like the reference's sequential prints.
    """
    df = trim_columns(df)
    steps = cleaning_steps(df, time_cols)
    label = None
    for name, keep in steps:
        fails = ~F.coalesce(keep, F.lit(False))
        label = F.when(fails, name) if label is None else label.when(fails, name)
    label = F.lit("kept") if label is None else label.otherwise("kept")
    return df.groupBy(label.alias("step")).agg(F.count(F.lit(1)).alias("rows"))


def normalise_codes(df: DataFrame, cols) -> DataFrame:
    """upper(trim()) of code columns."""
    return df.select(*[F.upper(F.trim(F.col(f"`{c}`"))).alias(c) if c in cols
                       else F.col(f"`{c}`") for c in df.columns])


def filter_codes(df: DataFrame, equalities: dict) -> DataFrame:
    """Conjunction of code equalities."""
    cond = None
    for c, v in equalities.items():
        e = F.col(f"`{c}`") == F.lit(v)
        cond = e if cond is None else cond & e
    return df.filter(cond)


def filter_and_sum_extract(df: DataFrame, time_cols=None,
                           by=("Reporting country", "Counterparty country")) -> DataFrame:
    """P9 + A1: keep rows matching the fixed reporting codes and bank types,
    then sum every period per (reporter, counterparty); a group whose
    values are all missing sums to 0 (Q14).  One filter, one aggregate."""
    tcols = list(time_cols) if time_cols is not None else quarter_columns(df)
    d = filter_codes(df, S.REPORTING_CODES).filter(F.col("CBS_BANK_TYPE").isin(S.EXTRACT_BANK_TYPES))
    keys = [c for c in by if c in df.columns]
    return d.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(
        *[F.coalesce(F.sum(F.col(f"`{q}`")), F.lit(0.0)).alias(q) for q in tcols])


def pivot_bank_types(long_df: DataFrame, keys, bank_col: str = S.BANK_TYPE,
                     value_col: str = "exposure", types=S.BANK_TYPES) -> DataFrame:
    """Sum per key x bank type, one column per type, absent -> 0.

    The type list is fixed, so the pivot is one aggregate of conditional
    sums (a single shuffle, no distinct-values job); a missing bank type
    yields a 0 column instead of an error (Q16).  Rows whose key or bank
    type is NULL are dropped first (Q2).
    """
    keys = list(keys)
    df = long_df.dropna(subset=keys).filter(F.col(bank_col).isin(list(types)))
    return df.groupBy(*keys).agg(*[
        F.coalesce(F.sum(F.when(F.col(bank_col) == t, F.col(value_col))), F.lit(0.0)).alias(t)
        for t in types])


def consolidate(df: DataFrame, b="4B", r="4R", c="4C", o="4O",
                out: str = "consolidated") -> DataFrame:
    """If 4C + 4O = 0 then 4B else (4B - 4R) + (4C + 4O)."""
    foreign = F.col(c) + F.col(o)
    return df.withColumn(out, F.when(foreign == 0, F.col(b))
                         .otherwise(F.col(b) - F.col(r) + foreign))


def pair_totals(long_df: DataFrame, a: str = S.REP, b: str = S.CP,
                period: str = S.DS, value: str = S.Y) -> DataFrame:
    """A1: sum over all rows per (a, b, period); an all-missing group is 0."""
    return long_df.groupBy(a, b, period).agg(
        F.coalesce(F.sum(value), F.lit(0.0)).alias("total"))


def period_label(ds: str = S.DS, train=("2005-01-01", "2019-12-31"),
                 valid=None, test=("2020-01-01", None)) -> Column:
    """P12/P13: 'train' / 'valid' / 'test' label by date; NULL = dropped."""
    d = F.col(ds)

    def rng(lo, hi):
        c = F.lit(True)
        if lo:
            c = c & (d >= F.to_date(F.lit(lo)))
        if hi:
            c = c & (d <= F.to_date(F.lit(hi)))
        return c
    lab = F.when(rng(*train), "train")
    if valid:
        lab = lab.when(rng(*valid), "valid")
    return lab.when(rng(*test), "test")


def split_by_period(df: DataFrame, **kw):
    """(train, test) DataFrames; earlier years are dropped."""
    lab = period_label(**kw)
    return df.filter(lab == "train"), df.filter(lab == "test")
