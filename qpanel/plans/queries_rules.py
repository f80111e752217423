"""Registered queries: filters and rules on rows that trigger them (P3-P6, P9,
P11, P16, P17, P19, P23, P25, A17, K7, R8, C11).

The descriptors of the claims come from the driver's columns: some countries
carry an aggregate's name, codes are padded and in mixed case, descriptors are
NULL for some values, and quarters of 2001 are no period columns, so that rows
with data in 2001 only have no period at all.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from qpanel import schema as S
from qpanel.functions.dates import quarter_label
from qpanel.functions.numeric import finite_or_null
from qpanel.operators import clean as C
from qpanel.operators import features as FE
from qpanel.operators import reshape as R
from qpanel.operators import select as SL
from qpanel.operators import trees as TR
from qpanel.plans import panels as P
from qpanel.plans.catalog import register
from qpanel.plans.joins import lookup_join
from qpanel.plans.output import round_doubles
from qpanel.plans.sql import panel_sql, r
from qpanel.sources.tables import read_table

PERIODS = R.quarter_labels("1995-Q1", "2000-Q4")
FINE = f"WITH panel AS ({panel_sql('nation')})"

# column: SQL (the same in Spark and DuckDB) over the driver's columns
DESCRIPTORS = {
    "Reporting country": "CASE WHEN s_nationkey = 3 THEN '  EURO area' ELSE concat('Country ', s_nationkey) END",
    "Counterparty country": "CASE WHEN c_nationkey = 5 THEN 'Residents/Local ' WHEN c_nationkey <> 7 THEN concat('Country ', c_nationkey) END",
    "FREQ": "CASE WHEN c_mktsegment = 'MACHINERY' THEN 'A' ELSE 'Q' END",
    "CURR_TYPE_BOOK": "'TO1'",
    "L_MEASURE": "CASE WHEN l_linestatus = 'F' AND o_orderstatus = 'P' THEN 'B' WHEN o_orderstatus <> 'O' THEN 'S' END",
    "L_POSITION": "CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'L' ELSE 'C' END",
    "L_INSTR": "'A'", "REM_MATURITY": "'A'", "L_CP_SECTOR": "'A'",
    "Type of instruments": "CASE c_mktsegment WHEN 'BUILDING' THEN 'Derivatives' WHEN 'FURNITURE' THEN NULL ELSE 'Loans' END",
    "Remaining maturity": "CASE o_orderstatus WHEN 'P' THEN 'Up to and including 1 year' WHEN 'O' THEN NULL ELSE 'All' END",
    "Currency type of booking location": "CASE o_orderpriority WHEN '2-HIGH' THEN 'Local currency' WHEN '1-URGENT' THEN NULL ELSE 'Foreign' END",
    "Counterparty sector": "CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Banks' WHEN 'HOUSEHOLD' THEN NULL ELSE ' All SECTORS ' END",
    "Balance sheet position": "CASE WHEN l_linestatus = 'O' THEN 'Total liabilities' ELSE 'TOTAL claims' END",
    "CBS_BASIS": "CASE l_returnflag WHEN 'A' THEN 'F' WHEN 'N' THEN ' f ' ELSE 'U' END",
    "CBS_BANK_TYPE": "CASE o_orderpriority WHEN '1-URGENT' THEN ' 4b' WHEN '2-HIGH' THEN '4R' WHEN '3-MEDIUM' THEN '4C' WHEN '4-NOT SPECIFIED' THEN '4O ' END",
}


def described_claims(spark, sf_dir):
    """The wide claims table with all descriptors, one column per period."""
    li = read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_shipdate", "l_extendedprice"])
    orders = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"])
    cus = read_table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey", "c_mktsegment"])
    sup = read_table(spark, sf_dir, "supplier", ["s_suppkey", "s_nationkey"])
    rows = lookup_join(li, lookup_join(orders, cus, "o_custkey", "c_custkey"), "l_orderkey", "o_orderkey", probe=orders)
    rows = lookup_join(rows, sup, "l_suppkey", "s_suppkey")
    rows = rows.select(*[F.expr(e).alias(c) for c, e in DESCRIPTORS.items()], quarter_label("l_shipdate").alias("q"), "l_extendedprice")
    return rows.groupBy(*[F.col(f"`{c}`") for c in DESCRIPTORS]).agg(*[
        F.round(F.sum(F.when(F.col("q") == q, F.col("l_extendedprice"))), 4).alias(q) for q in PERIODS])


_ROWS = f"""WITH x AS (SELECT {', '.join(f'{e} AS "{c}"' for c, e in DESCRIPTORS.items())},
  year(l_shipdate) || '-Q' || quarter(l_shipdate) AS q, l_extendedprice AS v
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey),
w AS (SELECT {', '.join(f'"{c}"' for c in DESCRIPTORS)}, {', '.join(f"round(sum(v) FILTER (WHERE q = '{q}'), 4) AS \"{q}\"" for q in PERIODS)}
  FROM x GROUP BY ALL)"""
_ENTITIES = ", ".join("'" + e.lower().strip().replace("'", "''") + "'" for e in S.AGGREGATE_ENTITIES)


def _step_sql() -> str:
    out = f"""CASE WHEN lower(trim(coalesce("Reporting country", ''))) IN ({_ENTITIES})
      OR lower(trim(coalesce("Counterparty country", ''))) IN ({_ENTITIES}) THEN 'aggregate_entity'
    WHEN coalesce({', '.join(f'"{q}"' for q in PERIODS)}) IS NULL THEN 'all_periods_missing'"""
    for c, v in S.EXCLUDE_EQUAL.items():
        out += f"""\n    WHEN "{c}" IS NOT DISTINCT FROM '{v}' THEN '{c} = {v}'"""
    for c, v in S.REQUIRE_NORMALISED.items():
        out += f"""\n    WHEN NOT coalesce(lower(trim("{c}")) = '{v}', false) THEN '{c} <> {v}'"""
    return out + """\n    WHEN NOT coalesce(upper(trim(CBS_BANK_TYPE)) IN ('4B', '4R', '4C', '4O'), false) THEN 'bank_type_out_of_scope' ELSE 'kept' END"""


def filter_audit_all_steps(spark, sf_dir):
    """Rows removed by each cleaning step; every step removes some."""
    return C.filter_audit(described_claims(spark, sf_dir), time_cols=PERIODS)


register("filter_audit_all_steps", f"{_ROWS} SELECT {_step_sql()} AS step, count(*) AS rows FROM w GROUP BY 1")(filter_audit_all_steps)


def cleaned_claims(spark, sf_dir):
    """The rows that all steps keep, with normalised codes."""
    kept = C.clean_claims(described_claims(spark, sf_dir), time_cols=PERIODS)
    kept = C.normalise_codes(kept, ["CBS_BASIS", "CBS_BANK_TYPE", "Counterparty sector"])
    return kept.select(*[F.col(f"`{c}`") for c in [*DESCRIPTORS, *PERIODS]])


register("cleaned_claims", f"""{_ROWS} SELECT {', '.join(f'upper(trim("{c}")) AS "{c}"' if c in ('CBS_BASIS', 'CBS_BANK_TYPE', 'Counterparty sector') else f'"{c}"' for c in DESCRIPTORS)},
  {', '.join(f'"{q}"' for q in PERIODS)} FROM w WHERE {_step_sql()} = 'kept'""")(cleaned_claims)


def reporting_extract(spark, sf_dir):
    """The fixed reporting codes, summed by country pair and period."""
    claims = C.normalise_codes(described_claims(spark, sf_dir), ["CBS_BASIS", "CBS_BANK_TYPE"])
    return round_doubles(C.filter_and_sum_extract(claims, PERIODS), 2)


register("reporting_extract", f"""{_ROWS} SELECT "Reporting country", "Counterparty country",
  {', '.join(f'round(coalesce(sum("{q}"), 0), 2) AS "{q}"' for q in PERIODS)} FROM w
WHERE {' AND '.join((f"upper(trim({c})) = '{v}'" if c == 'CBS_BASIS' else f"{c} = '{v}'") for c, v in S.REPORTING_CODES.items())}
  AND upper(trim(CBS_BANK_TYPE)) IN ({', '.join(f"'{b}'" for b in S.EXTRACT_BANK_TYPES)}) GROUP BY ALL""")(reporting_extract)


def missing_value_rules(spark, sf_dir):
    """Not-a-number and infinite prices become NULL, NULLs
    are dropped or filled, zeros become NULL; counted per basis."""
    li = read_table(spark, sf_dir, "lineitem", ["l_returnflag", "l_quantity", "l_extendedprice"])
    odd = F.when(F.col("l_quantity") == 1, F.lit(float("nan"))).when(F.col("l_quantity") == 2, F.lit(float("inf"))) \
        .when(F.col("l_quantity") == 3, F.lit(float("-inf"))).when(F.col("l_quantity") == 4, F.lit(0.0)).otherwise(F.col("l_extendedprice"))
    rows = li.select(F.col("l_returnflag").alias("basis"), finite_or_null(odd).alias("x"))
    count = lambda df, name: df.groupBy("basis").agg(F.count("x").alias(name), F.count(F.lit(1)).alias(f"{name}_rows"))
    out = count(rows, "finite")
    for name, df in (("dropped", SL.drop_missing(rows, ["x"])), ("filled", SL.fill_missing(rows, ["x"])), ("nonzero", SL.zero_as_missing(rows, ["x"]))):
        out = out.join(count(df, name), "basis")
    return out


register("missing_value_rules", """WITH x AS (SELECT l_returnflag AS basis, CASE WHEN l_quantity IN (1, 2, 3) THEN NULL WHEN l_quantity = 4 THEN 0 ELSE l_extendedprice END AS x FROM lineitem)
SELECT basis, count(x) AS finite, count(*) AS finite_rows, count(x) AS dropped, count(x) AS dropped_rows, count(*) AS filled, count(*) AS filled_rows,
       count(nullif(x, 0)) AS nonzero, count(*) AS nonzero_rows FROM x GROUP BY basis""")(missing_value_rules)


def forward_filled_features(spark, sf_dir):
    """Lag features of the dense fine panel, chosen by name prefix,
    filled forward per series, then with 0."""
    from qpanel.operators import impute as I
    panel = P.shared(P.fine_panel(spark, sf_dir))
    dense = I.densify(panel)
    w = FE.series_window()
    feats = dense.select(S.UID, S.DS, F.lag(S.Y, 1).over(w).alias("lag_1"), F.lag(S.Y, 4).over(w).alias("lag_4"), F.quarter(S.DS).alias("other"))
    return round_doubles(FE.forward_fill_features(feats, TR.feature_columns(feats)).drop("other"), 4)


register("forward_filled_features", f"""{FINE},
ends AS (SELECT min(ds) AS a, max(ds) AS b FROM panel),
cal AS (SELECT CAST(last_day(a + to_months(CAST(3 * i AS INTEGER))) AS DATE) AS ds FROM ends, range(0, 400) t(i) WHERE last_day(a + to_months(CAST(3 * i AS INTEGER))) <= b),
dense AS (SELECT u.unique_id, cal.ds, y FROM (SELECT DISTINCT unique_id FROM panel) u CROSS JOIN cal LEFT JOIN panel USING (unique_id, ds)),
f AS (SELECT unique_id, ds, lag(y, 1) OVER w AS l1, lag(y, 4) OVER w AS l4 FROM dense WINDOW w AS (PARTITION BY unique_id ORDER BY ds))
SELECT unique_id, ds, {r("coalesce(last_value(l1 IGNORE NULLS) OVER w, 0)")} AS lag_1, {r("coalesce(last_value(l4 IGNORE NULLS) OVER w, 0)")} AS lag_4
FROM f WINDOW w AS (PARTITION BY unique_id ORDER BY ds ROWS UNBOUNDED PRECEDING)""")(forward_filled_features)


def example_series(spark, sf_dir):
    """P25: the rows of one example series."""
    return round_doubles(SL.series_slice(P.coarse_panel(spark, sf_dir), "ASIA_EUROPE_R").select(S.UID, S.DS, S.Y), 4)


register("example_series", f"WITH panel AS ({panel_sql('region')}) SELECT unique_id, ds, {r('y')} AS y FROM panel WHERE unique_id = 'ASIA_EUROPE_R'")(example_series)


def forecast_steps(spark, sf_dir):
    """Arrays of test values and shifted forecasts, one row per step
    up to the number of distinct test quarters."""
    _, test = P.split_train_test(P.shared(P.coarse_panel(spark, sf_dir)))
    h = SL.horizon_of(test)
    arrays = R.series_arrays(test).select(S.UID, F.slice("values", 1, h).alias("actuals"),
                                          F.transform(F.slice("values", 1, h), lambda v: v + 1).alias("forecasts"))
    return round_doubles(R.explode_steps(arrays, [S.UID]), 4)


register("forecast_steps", f"""WITH panel AS ({panel_sql('region')})
SELECT unique_id, CAST(row_number() OVER (PARTITION BY unique_id ORDER BY ds) AS INTEGER) AS step, {r('y')} AS actual, {r('y + 1')} AS forecast
FROM panel WHERE ds BETWEEN DATE '{P.TEST_START}' AND DATE '{P.TEST_END}'""")(forecast_steps)


def constant_series_flags(spark, sf_dir):
    """K7: series whose rounded log exposure never changes."""
    panel = P.fine_panel(spark, sf_dir).withColumn(S.Y, F.floor(F.log10(S.Y)).cast("double"))
    return FE.constant_series(panel).select(S.UID, "is_constant")


register("constant_series_flags", f"""{FINE}
SELECT unique_id, stddev_pop(floor(log10(y))) < 1e-6 AS is_constant FROM panel GROUP BY unique_id""")(constant_series_flags)
