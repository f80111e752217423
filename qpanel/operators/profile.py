"""Profiles of the panel: coverage, missingness, distributions (A2-A14,
T1, U3/A5, U4, C12, G12).

All are aggregates on the long form (time is data, not schema), so each
runs with partial aggregation and one small shuffle.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qpanel import schema as S


def value_counts(df: DataFrame, col: str, name: str = "n") -> DataFrame:
    """A2: rows per category (sorting is left to the consumer)."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias(name))


def country_counts(df: DataFrame, a: str = "Reporting country",
                   b: str = "Counterparty country") -> DataFrame:
    """A2 + J4: rows per country as reporter and as counterparty (rows
    missing either country dropped first, P16); full outer join, missing
    side 0, counts as int."""
    df = df.dropna(subset=[a, b])
    ra = df.groupBy(F.col(f"`{a}`").alias("country")).agg(F.count(F.lit(1)).alias("n_reporting"))
    rb = df.groupBy(F.col(f"`{b}`").alias("country")).agg(F.count(F.lit(1)).alias("n_counterparty"))
    j = ra.join(rb, "country", "full_outer")
    return j.select("country", F.coalesce("n_reporting", F.lit(0)).cast("int").alias("n_reporting"),
                    F.coalesce("n_counterparty", F.lit(0)).cast("int").alias("n_counterparty"))


def column_values(df: DataFrame, cols) -> DataFrame:
    """(column, value) pairs of the named columns as text (Expand, no shuffle)."""
    cols = list(cols)
    return df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in cols]) \
        .unpivot([], cols, "column", "value")


# Hash buckets per column for the two-level top-k below.
TOPK_BUCKETS = 64


def top_k_per_group(df: DataFrame, group: str, order, k: int,
                    buckets: int = TOPK_BUCKETS, salt_col: str = "value") -> DataFrame:
    """Top ``k`` rows per ``group`` by ``order`` without one task per group:
    first the top k inside each (group, hash bucket of ``salt_col``), then
    the top k of those at most k x buckets survivors.  Adds ``rank``."""
    b = F.pmod(F.xxhash64(F.col(salt_col)), F.lit(buckets))
    w1 = Window.partitionBy(group, "_b").orderBy(*order)
    pre = (df.withColumn("_b", b).withColumn("_r1", F.row_number().over(w1))
           .filter(F.col("_r1") <= k).drop("_r1", "_b"))
    w2 = Window.partitionBy(group).orderBy(*order)
    return pre.withColumn("rank", F.row_number().over(w2)).filter(F.col("rank") <= k)


def column_profile(df: DataFrame, cols, top: int = 10, all_if_at_most: int = 20):
    """A3 + T1: per column non-null and distinct counts, and the top values
    (all of them when the column has at most ``all_if_at_most``).

    Returns (summary, top_values).  Value counts are a partial aggregate;
    the ranking is a two-level top-k, so no task holds all distinct values
    of a high-cardinality column.
    """
    cv = column_values(df, cols)
    counts = cv.filter(F.col("value").isNotNull()).groupBy("column", "value") \
        .agg(F.count(F.lit(1)).alias("n"))
    summary = counts.groupBy("column").agg(F.sum("n").alias("non_null"),
                                           F.count(F.lit(1)).alias("unique_count"))
    k = max(top, all_if_at_most)
    ranked = top_k_per_group(counts, "column", [F.desc("n"), F.asc("value")], k)
    topv = (ranked.join(summary.select("column", "unique_count"), "column")
            .filter((F.col("unique_count") <= all_if_at_most) | (F.col("rank") <= top))
            .select("column", "value", "n", "rank"))
    return summary, topv


# Fixed value: label of the appended totals row of the column profile.
TOTAL_ROW = "Total Filled Datapoints"


def profile_with_coverage(summary: DataFrame, wide: DataFrame, quarters,
                          rep: str = "L_REP_CTY", cp: str = "L_CP_COUNTRY") -> DataFrame:
    """J10 + A5: per-quarter distinct reporters, counterparties and pairs
    among the rows of the same wide table that fill that quarter, looked up
    into the column profile by column name (descriptor columns get NULL),
    plus a totals row with the filled cells over all quarter columns."""
    qs = list(quarters)
    cells = (wide.select(rep, cp, *[F.col(f"`{q}`") for q in qs])
             .unpivot([rep, cp], qs, "column", "_v").filter(F.col("_v").isNotNull()))
    cov = cells.groupBy("column").agg(F.countDistinct(rep).alias("num_reporters"),
                                      F.countDistinct(cp).alias("num_counterparties"),
                                      F.countDistinct(rep, cp).alias("num_pairs"))
    prof = summary.join(cov, "column", "left")
    total = (summary.filter(F.col("column").isin(qs))
             .agg(F.sum("non_null").alias("non_null"))
             .select(F.lit(TOTAL_ROW).alias("column"), "non_null",
                     F.lit(None).cast("long").alias("unique_count"),
                     F.lit(None).cast("long").alias("num_reporters"),
                     F.lit(None).cast("long").alias("num_counterparties"),
                     F.lit(None).cast("long").alias("num_pairs")))
    return prof.unionByName(total)


def coverage_by_quarter(panel: DataFrame, a: str = S.REP, b: str = S.CP,
                        ds: str = S.DS) -> DataFrame:
    """Distinct reporters, counterparties and pairs per
    quarter, with a tick flag every 3rd year and the coverage chart's events."""
    g = panel.groupBy(ds).agg(F.countDistinct(a).alias("n_reporters"),
                              F.countDistinct(b).alias("n_counterparties"),
                              F.countDistinct(a, b).alias("n_pairs"))
    return g.select(F.year(ds).alias("year"), F.quarter(ds).alias("quarter"), ds,
                    "n_reporters", "n_counterparties", "n_pairs",
                    ((F.quarter(ds) == 2) & (F.year(ds) % 3 == 0)).alias("tick"),
                    event_labels(ds, S.COVERAGE_EVENTS).alias("event"))


def tick_labels(df: DataFrame, ds: str = S.DS, every_years: int = 3, quarter: int = 2,
                events: DataFrame | None = None) -> DataFrame:
    """Axis ticks every ``every_years`` years at one quarter
    (``tick``), and the label of an event on that date when an events
    table (date ``ds``, ``event``) is given (left join; the events table
    is small by nature, a list of dated annotations)."""
    out = df.withColumn("tick", (F.quarter(ds) == quarter) & (F.year(ds) % every_years == 0))
    if events is not None:
        out = out.join(events.select(ds, "event"), ds, "left")
    return out


def event_labels(ds: str = S.DS, events: dict[str, str] = S.INFLECTIONS):
    """The fixed event annotation of a quarter (NULL when none)."""
    from qpanel.functions.dates import quarter_label
    lab = quarter_label(ds)
    expr = None
    for q, text in events.items():
        expr = F.when(lab == q, text) if expr is None else expr.when(lab == q, text)
    return expr


def coverage_approx(panel: DataFrame, a: str = S.REP, b: str = S.CP,
                    ds: str = S.DS, rsd: float = 0.01) -> DataFrame:
    """A4 variant with HyperLogLog sketches (no per-group distinct sets)."""
    return panel.groupBy(ds).agg(
        F.approx_count_distinct(a, rsd).alias("n_reporters"),
        F.approx_count_distinct(b, rsd).alias("n_counterparties"),
        F.approx_count_distinct(F.concat_ws("\u0001", a, b), rsd).alias("n_pairs"))


def filled_cells_with_total(panel: DataFrame, ds: str = S.DS, value: str = S.Y) -> DataFrame:
    """Filled cells per quarter plus a grand-total row (ds NULL)."""
    return panel.rollup(ds).agg(F.count(value).alias("filled"),
                                F.grouping(ds).cast("int").alias("is_total"))


def missing_share(dense: DataFrame, by, value: str = S.Y, zero_is_missing: bool = True) -> DataFrame:
    """Percent of empty cells per group of the densified panel;
    by default a 0 counts as missing too (P20), as in the reference."""
    v = F.col(value)
    empty = (v.isNull() | (v == 0)) if zero_is_missing else v.isNull()
    return dense.groupBy(*by).agg((F.avg(F.coalesce(empty, F.lit(True)).cast("double")) * 100)
                                  .alias("missing_pct"))


def reporter_missing_rank(dense: DataFrame, rep: str = S.REP, ds: str = S.DS,
                          value: str = S.Y, zero_is_missing: bool = True) -> DataFrame:
    """Mean over quarters of each reporter's missing percent."""
    per_q = missing_share(dense, [rep, ds], value, zero_is_missing)
    return per_q.groupBy(rep).agg(F.avg("missing_pct").alias("mean_missing_pct"))


def total_by_quarter(panel: DataFrame, ds: str = S.DS, value: str = S.Y) -> DataFrame:
    """A10."""
    return panel.groupBy(ds).agg(F.sum(value).alias("total"))


def cell_counts(dense: DataFrame, value: str = S.Y) -> DataFrame:
    """Total / missing / zero cells and their shares."""
    v = F.col(value)
    return dense.agg(F.count(F.lit(1)).alias("cells"),
                     F.count_if(v.isNull()).alias("missing"),
                     F.count_if(v == 0).alias("zeros")) \
        .withColumn("missing_share", F.col("missing") / F.col("cells")) \
        .withColumn("zero_share", F.col("zeros") / F.col("cells"))


def average_by_quarter_and_basis(panel: DataFrame, ds: str = S.DS, basis: str = S.BASIS,
                                 value: str = S.Y) -> DataFrame:
    """Mean per quarter overall and per (quarter, basis) in one
    GROUPING SETS aggregate; ``basis`` is NULL on the overall rows."""
    return (panel.groupingSets([[ds], [ds, basis]], ds, basis)
            .agg(F.avg(value).alias("mean"), F.grouping(basis).cast("int").alias("overall")))


def histogram(df: DataFrame, value: str = S.Y, bins: int = 50,
              log_positive: bool = False) -> DataFrame:
    """Equal-width histogram between min and max (last bin closed).

    The bounds are a one-row aggregate read back as two scalars; the
    binning itself is a partial aggregate.
    """
    x = F.col(value)
    d = df.select(F.log1p(x).alias("x") if log_positive else x.alias("x"))
    if log_positive:
        d = d.filter(F.col("x") > 0)
    d = d.filter(F.col("x").isNotNull())
    lo, hi = d.agg(F.min("x"), F.max("x")).first()
    if lo is None:
        return d.sparkSession.createDataFrame([], "bin int, lower double, upper double, n long")
    width = (hi - lo) / bins if hi > lo else 1.0
    b = F.greatest(F.least(F.floor((F.col("x") - F.lit(lo)) / F.lit(hi - lo if hi > lo else 1.0) * bins),
                           F.lit(bins - 1)), F.lit(0)).cast("int")
    return (d.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
            .select("bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("lower"),
                    (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("upper"), "n"))


# Fixed value: text for a column with too many distinct values to list.
TOO_MANY = "%d unique values (too many to display)"


def unique_value_summary(df: DataFrame, cols, numeric_cols=(), max_list: int = 250,
                         max_distinct: int = 1000) -> DataFrame:
    """Per column, numeric -> 'n instances'; fewer than ``max_distinct``
    distinct values -> the first ``max_list`` values; else a count text.
    Rows have no order in Spark, so "first" means smallest in value order
    (the reference lists them in file order).  The listed values come from
    a two-level top-k (bounded per task)."""
    cv = column_values(df, cols).filter(F.col("value").isNotNull())
    d = cv.groupBy("column", "value").agg(F.count(F.lit(1)).alias("_n"))
    g = d.groupBy("column").agg(F.count(F.lit(1)).alias("distinct_count"),
                                F.sum("_n").alias("instances"))
    first = (top_k_per_group(d, "column", [F.asc("value")], max_list)
             .groupBy("column").agg(F.sort_array(F.collect_list("value")).alias("_vals")))
    num = F.col("column").isin(list(numeric_cols)) if numeric_cols else F.lit(False)
    return g.join(first, "column", "left").select(
        "column", "distinct_count",
        F.when(num, F.format_string("%d instances", "instances"))
        .when(F.col("distinct_count") < max_distinct, F.array_join("_vals", ", "))
        .otherwise(F.format_string(TOO_MANY, "distinct_count")).alias("summary"))


def distribution_summary(df: DataFrame, value: str = S.Y, median=None) -> DataFrame:
    """Mean, (exact) median and population std of the values."""
    out = df.agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std_pop"),
                 F.count(value).alias("n"))
    return out.withColumn("median", F.lit(median).cast("double"))
