"""The panel concepts mapped onto the driver's star-schema tables.

* reporter = supplier's region (coarse) or nation (fine)
* counterparty = customer's region or nation
* basis = l_returnflag
* bank type = o_orderpriority (1-URGENT 4B, 2-HIGH 4R, 3-MEDIUM 4C,
  4-NOT SPECIFIED 4O; 5-LOW out of scope)
* quarter = quarter of l_shipdate, ds = its last day
* exposure = sum(l_extendedprice)

Plan shape: lineitem and orders are the only large inputs; they meet in
one join on the order key.  Supplier and customer are first reduced to
key -> name maps.  Every lookup (orders -> customer map, lineitem ->
orders, lineitem -> supplier map) is broadcast only when the optimizer's
size estimate of the lookup side's base scan is under the session's
broadcast threshold; otherwise it is a shuffled join, in which adaptive
execution splits the partition of a hot key.  The final aggregate runs
partial (map-side) before its shuffle, so a hot (rep, cp, basis, quarter)
group never reaches one task as raw rows.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qpanel import schema as S
from qpanel.functions.dates import quarter_end
from qpanel.plans.joins import fixed_small, lookup_join
from qpanel.plans.ordered import cut_lineage
from qpanel.sources.tables import read_table, spread_if_narrow


def _geo(spark: SparkSession, sf_dir: str, level: str) -> DataFrame:
    """nationkey -> display name at the requested level (25 rows, fixed)."""
    nation = read_table(spark, sf_dir, "nation",
                        ["n_nationkey", "n_name", "n_regionkey"])
    if level == "nation":
        return nation.select("n_nationkey", F.col("n_name").alias("geo"))
    if level != "region":
        raise ValueError(f"level must be 'region' or 'nation', not {level!r}")
    region = read_table(spark, sf_dir, "region", ["r_regionkey", "r_name"])
    return (nation.join(fixed_small(region),
                        nation.n_regionkey == region.r_regionkey)
            .select("n_nationkey", F.col("r_name").alias("geo")))


def supplier_geo(spark, sf_dir, level) -> DataFrame:
    """s_suppkey -> reporter name (one row per supplier)."""
    sup = read_table(spark, sf_dir, "supplier", ["s_suppkey", "s_nationkey"])
    geo = _geo(spark, sf_dir, level)
    return (sup.join(fixed_small(geo), sup.s_nationkey == geo.n_nationkey)
            .select("s_suppkey", F.col("geo").alias(S.REP)))


def customer_geo(spark, sf_dir, level) -> DataFrame:
    """c_custkey -> counterparty name (one row per customer)."""
    cus = read_table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey"])
    geo = _geo(spark, sf_dir, level)
    return (cus.join(fixed_small(geo), cus.c_nationkey == geo.n_nationkey)
            .select("c_custkey", F.col("geo").alias(S.CP)))


def bank_type_expr(priority_col: str = "o_orderpriority"):
    """CASE over the fixed priority -> bank type mapping (NULL otherwise)."""
    c = F.col(priority_col)
    expr = None
    for prio, bt in S.PRIORITY_TO_BANK_TYPE.items():
        expr = (F.when(c == prio, bt) if expr is None
                else expr.when(c == prio, bt))
    return expr


def exposures(spark: SparkSession, sf_dir: str, level: str = "region",
              by_bank_type: bool = False, start: str | None = None,
              end: str | None = None) -> DataFrame:
    """(rep, cp, basis[, bank_type], ds, exposure) summed over lines.

    With ``by_bank_type`` the out-of-scope priority is kept with a NULL
    bank type so the cleaning step can be seen removing it.  ``start`` /
    ``end`` (dates, inclusive) bound the ship date directly on the scan, so
    the range reaches the parquet reader (PushedFilters, row-group and
    partition pruning) instead of filtering after the aggregate.
    """
    li = read_table(spark, sf_dir, "lineitem",
                    ["l_orderkey", "l_suppkey", "l_returnflag", "l_shipdate",
                     "l_extendedprice"])
    if start is not None:
        li = li.filter(F.col("l_shipdate") >= F.to_timestamp(F.lit(start)))
    if end is not None:
        li = li.filter(F.col("l_shipdate") < F.date_add(F.to_date(F.lit(end)), 1))
    li = spread_if_narrow(li)
    ocols = ["o_orderkey", "o_custkey"] + (["o_orderpriority"] if by_bank_type else [])
    orders = read_table(spark, sf_dir, "orders", ocols)
    cmap = customer_geo(spark, sf_dir, level)
    smap = supplier_geo(spark, sf_dir, level)
    cus = read_table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey"])
    sup = read_table(spark, sf_dir, "supplier", ["s_suppkey", "s_nationkey"])
    # each lookup is broadcast when its base scan is small, else a shuffled join
    orders_cp = lookup_join(orders, cmap, "o_custkey", "c_custkey", probe=cus)
    lines = lookup_join(li, orders_cp, "l_orderkey", "o_orderkey", probe=orders)
    lines = lookup_join(lines, smap, "l_suppkey", "s_suppkey", probe=sup)
    group = [S.REP, S.CP, F.col("l_returnflag").alias(S.BASIS)]
    if by_bank_type:
        group.append(bank_type_expr().alias(S.BANK_TYPE))
    group.append(quarter_end("l_shipdate").alias(S.DS))
    return lines.groupBy(*group).agg(
        F.sum("l_extendedprice").alias("exposure"))


def with_uid(df: DataFrame) -> DataFrame:
    """Add unique_id = rep_cp_basis."""
    return df.withColumn(S.UID, F.concat_ws("_", S.REP, S.CP, S.BASIS))


def long_panel(spark: SparkSession, sf_dir: str, level: str = "region",
               start: str | None = None, end: str | None = None) -> DataFrame:
    """Long panel (unique_id, rep, cp, basis, ds, y); one row per filled
    cell; optional ship-date bounds are pushed to the scan."""
    e = exposures(spark, sf_dir, level, start=start, end=end)
    return with_uid(e).select(S.UID, S.REP, S.CP, S.BASIS, S.DS,
                              F.col("exposure").alias(S.Y))


def coarse_panel(spark, sf_dir, start=None, end=None) -> DataFrame:
    """5 x 5 regions x 3 bases = 75 series over 28 quarters."""
    return long_panel(spark, sf_dir, "region", start, end)


def fine_panel(spark, sf_dir) -> DataFrame:
    """25 x 25 nations x 3 bases = 1,875 series with natural gaps."""
    return long_panel(spark, sf_dir, "nation")


# Train / test split of the test mapping: 1995-1999 train, 2000-2001 test.
TRAIN_END = "1999-12-31"
TRAIN_END_INDEX = 1999 * 4 + 3  # its quarter index
TEST_START = "2000-01-01"
TEST_END = "2001-12-31"


def split_train_test(panel: DataFrame, train_end: str = TRAIN_END,
                     test_start: str = TEST_START, test_end: str = TEST_END):
    """(train, test) by date filter on the long panel."""
    d = F.col(S.DS)
    train = panel.filter(d <= F.to_date(F.lit(train_end)))
    test = panel.filter((d >= F.to_date(F.lit(test_start))) &
                        (d <= F.to_date(F.lit(test_end))))
    return train, test


def shared(df: DataFrame) -> DataFrame:
    """Materialise an input that several branches of one query read (the
    panel, the claims table): the raw tables are scanned and joined once
    and every branch reads the checkpoint (reliable storage in
    ``spark.checkpoint.dir``), instead of one scan per branch, which is
    what Catalyst plans once column pruning makes the branches differ."""
    return cut_lineage(df)
