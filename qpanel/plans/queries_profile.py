"""Registered queries: profiles of the claims table and of the fine panel."""
from __future__ import annotations

from pyspark.sql import functions as F

from qpanel import schema as S
from qpanel.operators import features as FE
from qpanel.operators import impute as I
from qpanel.operators import profile as PR
from qpanel.plans import panels as P
from qpanel.plans.catalog import register
from qpanel.plans.ordered import exact_quantile
from qpanel.plans.output import round_doubles
from qpanel.plans.queries_prepare import _CLAIMS_SQL, claims_wide
from qpanel.plans.sql import panel_sql, r
from qpanel.operators.clean import quarter_columns

FINE = f"WITH panel AS ({panel_sql('nation')})"
DESCRIPTORS = ["Reporting country", "Counterparty country", "CBS_BASIS", "CBS_BANK_TYPE"]
_DENSE_SQL = f"""{FINE},
series AS (SELECT DISTINCT unique_id, rep, cp, basis FROM panel),
cal AS (SELECT unique_id, rep, cp, basis,
               CAST(last_day(DATE '1995-03-31' + to_months(3 * i)) AS DATE) AS ds
        FROM series, range(0, 28) t(i)),
dense AS (SELECT c.*, p.y FROM cal c LEFT JOIN panel p USING (unique_id, ds))"""


def _dense(spark, sf_dir):
    return I.densify(P.shared(P.fine_panel(spark, sf_dir)), keys=[S.UID, S.REP, S.CP, S.BASIS])


def country_counts(spark, sf_dir):
    """A2 + J4 on the claims table."""
    return PR.country_counts(P.shared(claims_wide(spark, sf_dir)))


register("country_counts", f"""WITH w AS ({_CLAIMS_SQL}),
w2 AS (SELECT * FROM w WHERE "Reporting country" IS NOT NULL AND "Counterparty country" IS NOT NULL),
a AS (SELECT "Reporting country" AS country, count(*) AS n_reporting FROM w2 GROUP BY 1),
b AS (SELECT "Counterparty country" AS country, count(*) AS n_counterparty FROM w2 GROUP BY 1)
SELECT coalesce(a.country, b.country) AS country,
       CAST(coalesce(n_reporting, 0) AS INTEGER) AS n_reporting,
       CAST(coalesce(n_counterparty, 0) AS INTEGER) AS n_counterparty
FROM a FULL OUTER JOIN b ON a.country = b.country""")(country_counts)

_CV = " UNION ALL ".join(f"""SELECT '{c}' AS "column", CAST("{c}" AS VARCHAR) AS value FROM w"""
                         for c in DESCRIPTORS)


def column_profile_summary(spark, sf_dir):
    """A3: non-null and distinct counts per descriptor column."""
    s, _ = PR.column_profile(claims_wide(spark, sf_dir), DESCRIPTORS)
    return s


register("column_profile_summary", f"""WITH w AS ({_CLAIMS_SQL}), cv AS ({_CV})
SELECT "column", count(value) AS non_null, count(DISTINCT value) AS unique_count
FROM cv GROUP BY 1""")(column_profile_summary)


def column_top_values(spark, sf_dir):
    """Top values per column (all when <= 20 distinct, else 10)."""
    _, t = PR.column_profile(P.shared(claims_wide(spark, sf_dir)), DESCRIPTORS)
    return t


register("column_top_values", f"""WITH w AS ({_CLAIMS_SQL}), cv AS ({_CV}),
c AS (SELECT "column", value, count(*) AS n FROM cv WHERE value IS NOT NULL GROUP BY 1, 2),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS INTEGER) AS rank,
             count(*) OVER (PARTITION BY "column") AS u FROM c)
SELECT "column", value, n, rank FROM k WHERE u <= 20 OR rank <= 10""")(column_top_values)


def unique_value_summary(spark, sf_dir):
    """Per descriptor column, its sorted values or a count text."""
    return PR.unique_value_summary(P.shared(claims_wide(spark, sf_dir)), DESCRIPTORS)


register("unique_value_summary", f"""WITH w AS ({_CLAIMS_SQL}), cv AS ({_CV}),
d AS (SELECT DISTINCT "column", value FROM cv WHERE value IS NOT NULL)
SELECT "column", count(*) AS distinct_count,
       CASE WHEN count(*) < 1000 THEN string_agg(value, ', ' ORDER BY value)
            ELSE printf('%d unique values (too many to display)', count(*)) END AS summary
FROM d GROUP BY 1""")(unique_value_summary)


def coverage_by_quarter(spark, sf_dir):
    """A4 / G12 / C12 on the fine panel."""
    return PR.coverage_by_quarter(P.fine_panel(spark, sf_dir))


register("coverage_by_quarter", f"""{FINE}
SELECT CAST(year(ds) AS INTEGER) AS year, CAST(quarter(ds) AS INTEGER) AS quarter, ds,
       count(DISTINCT rep) AS n_reporters, count(DISTINCT cp) AS n_counterparties,
       count(DISTINCT (rep, cp)) AS n_pairs, (quarter(ds) = 2 AND year(ds) % 3 = 0) AS tick,
       CASE printf('%d-Q%d', year(ds), quarter(ds))
            {" ".join(f"WHEN '{q}' THEN '{t}'" for q, t in S.COVERAGE_EVENTS.items())} END AS event
FROM panel GROUP BY ds""")(coverage_by_quarter)


def filled_cells_total(spark, sf_dir):
    """Filled cells per quarter plus the grand-total row."""
    return PR.filled_cells_with_total(P.fine_panel(spark, sf_dir))


register("filled_cells_total", f"""{FINE}
SELECT ds, count(y) AS filled, CAST(grouping(ds) AS INTEGER) AS is_total
FROM panel GROUP BY ROLLUP (ds)""")(filled_cells_total)


def missing_by_quarter(spark, sf_dir):
    """A7 on the densified fine panel."""
    return round_doubles(PR.missing_share(_dense(spark, sf_dir), [S.DS]))


register("missing_by_quarter", f"""{_DENSE_SQL}
SELECT ds, {r('avg(CAST(coalesce(y IS NULL OR y = 0, true) AS DOUBLE)) * 100')} AS missing_pct FROM dense GROUP BY ds""")(missing_by_quarter)


def missing_by_basis_quarter(spark, sf_dir):
    """Missing percent by basis x quarter, with the year."""
    m = PR.missing_share(_dense(spark, sf_dir), [S.BASIS, S.DS])
    return round_doubles(m.withColumn("year", F.year(S.DS)))


register("missing_by_basis_quarter", f"""{_DENSE_SQL}
SELECT basis, ds, {r('avg(CAST(coalesce(y IS NULL OR y = 0, true) AS DOUBLE)) * 100')} AS missing_pct,
       CAST(year(ds) AS INTEGER) AS year FROM dense GROUP BY basis, ds""")(missing_by_basis_quarter)


def reporter_missing(spark, sf_dir):
    """Reporters by mean quarterly missing percent."""
    return round_doubles(PR.reporter_missing_rank(_dense(spark, sf_dir)))


register("reporter_missing", f"""{_DENSE_SQL},
q AS (SELECT rep, ds, avg(CAST(coalesce(y IS NULL OR y = 0, true) AS DOUBLE)) * 100 AS m FROM dense GROUP BY rep, ds)
SELECT rep, {r('avg(m)')} AS mean_missing_pct FROM q GROUP BY rep""")(reporter_missing)


def total_by_quarter(spark, sf_dir):
    """A10."""
    return round_doubles(PR.total_by_quarter(P.fine_panel(spark, sf_dir)))


register("total_by_quarter", f"""{FINE}
SELECT ds, {r('sum(y)')} AS total FROM panel GROUP BY ds""")(total_by_quarter)


def cell_counts(spark, sf_dir):
    """A13 on the densified fine panel."""
    return round_doubles(PR.cell_counts(_dense(spark, sf_dir)), 6)


register("cell_counts", f"""{_DENSE_SQL}
SELECT count(*) AS cells, count(*) FILTER (WHERE y IS NULL) AS missing,
       count(*) FILTER (WHERE y = 0) AS zeros,
       {r('count(*) FILTER (WHERE y IS NULL) / count(*)', 6)} AS missing_share,
       {r('count(*) FILTER (WHERE y = 0) / count(*)', 6)} AS zero_share FROM dense""")(cell_counts)


def avg_by_quarter_basis(spark, sf_dir):
    """GROUPING SETS ((ds), (ds, basis))."""
    return round_doubles(PR.average_by_quarter_and_basis(P.fine_panel(spark, sf_dir)), 2)


register("avg_by_quarter_basis", f"""{FINE}
SELECT ds, basis, {r('avg(y)', 2)} AS mean, CAST(grouping(basis) AS INTEGER) AS overall
FROM panel GROUP BY GROUPING SETS ((ds), (ds, basis))""")(avg_by_quarter_basis)


def histogram_exposure(spark, sf_dir):
    """50 equal-width bins of the fine panel's values."""
    return round_doubles(PR.histogram(P.shared(P.fine_panel(spark, sf_dir)), bins=50), 2)


_HIST = """, b AS (SELECT min(x) AS lo, max(x) AS hi FROM v)
SELECT CAST(least(floor((x - lo) / (hi - lo) * 50), 49) AS INTEGER) AS bin,
       {lo} AS lower, {up} AS upper, count(*) AS n
FROM v, b GROUP BY ALL"""
register("histogram_exposure", f"""{FINE}, v AS (SELECT y AS x FROM panel WHERE y IS NOT NULL)"""
         + _HIST.format(lo=r('lo + least(floor((x - lo) / (hi - lo) * 50), 49) * ((hi - lo) / 50)', 2),
                        up=r('lo + (least(floor((x - lo) / (hi - lo) * 50), 49) + 1) * ((hi - lo) / 50)', 2))
         )(histogram_exposure)


def histogram_log_exposure(spark, sf_dir):
    """50 bins of log1p of the positive values."""
    return round_doubles(PR.histogram(P.shared(P.fine_panel(spark, sf_dir)), bins=50, log_positive=True), 6)


register("histogram_log_exposure", f"""{FINE}, v AS (SELECT ln(1 + y) AS x FROM panel WHERE ln(1 + y) > 0)"""
         + _HIST.format(lo=r('lo + least(floor((x - lo) / (hi - lo) * 50), 49) * ((hi - lo) / 50)', 6),
                        up=r('lo + (least(floor((x - lo) / (hi - lo) * 50), 49) + 1) * ((hi - lo) / 50)', 6))
         )(histogram_log_exposure)


def distribution_summary(spark, sf_dir):
    """Mean, exact median, population std (median without a
    single-task sort: see plans.ordered)."""
    panel = P.shared(P.fine_panel(spark, sf_dir))
    med = exact_quantile(panel, S.Y, 0.5)
    return round_doubles(PR.distribution_summary(panel, median=med), 4)


register("distribution_summary", f"""{FINE}
SELECT {r('avg(y)')} AS mean, {r('stddev_pop(y)')} AS std_pop, count(y) AS n,
       {r('quantile_cont(y, 0.5)')} AS median FROM panel""")(distribution_summary)


def winsorized_panel(spark, sf_dir):
    """A16 + K1: cap at the exact global 99th percentile, floor 0, log1p."""
    panel = P.shared(P.fine_panel(spark, sf_dir))
    cap = exact_quantile(panel, S.Y, 0.99)
    out = FE.prepare_log(panel, cap=cap)
    return round_doubles(out.select(S.UID, S.DS, "exposure", "y_log"), 6)


register("winsorized_panel", f"""{FINE}, c AS (SELECT quantile_cont(y, 0.99) AS cap FROM panel)
SELECT unique_id, ds, {r('greatest(least(y, cap), 0)', 6)} AS exposure,
       {r('ln(1 + greatest(least(y, cap), 0))', 6)} AS y_log
FROM panel, c WHERE y IS NOT NULL""")(winsorized_panel)


def column_profile_with_coverage(spark, sf_dir):
    """A3 + J10 + A5: profile of descriptor and quarter columns of the claims
    table; per quarter, the distinct reporters / counterparties / pairs of
    the rows that fill it; and the totals row."""
    wide = P.shared(claims_wide(spark, sf_dir))
    quarters = quarter_columns(wide)
    summ, _ = PR.column_profile(wide, DESCRIPTORS + quarters)
    return PR.profile_with_coverage(summ, wide, quarters)


def _cov_sql():
    from qpanel.plans.queries_prepare import QUARTERS
    cv = " UNION ALL ".join(f"""SELECT '{c}' AS "column", CAST("{c}" AS VARCHAR) AS value FROM w"""
                            for c in DESCRIPTORS + QUARTERS)
    cells = " UNION ALL ".join(f"""SELECT '{q}' AS "column", L_REP_CTY, L_CP_COUNTRY FROM w WHERE "{q}" IS NOT NULL"""
                               for q in QUARTERS)
    qlist = ", ".join(f"'{q}'" for q in QUARTERS)
    return f"""WITH w AS ({_CLAIMS_SQL}), cv AS ({cv}),
s AS (SELECT "column", count(value) AS non_null, count(DISTINCT value) AS unique_count FROM cv GROUP BY 1),
c AS (SELECT "column", count(DISTINCT L_REP_CTY) AS num_reporters, count(DISTINCT L_CP_COUNTRY) AS num_counterparties,
             count(DISTINCT (L_REP_CTY, L_CP_COUNTRY)) AS num_pairs FROM ({cells}) GROUP BY 1)
SELECT s.*, num_reporters, num_counterparties, num_pairs FROM s LEFT JOIN c USING ("column")
UNION ALL
SELECT '{PR.TOTAL_ROW}', CAST(sum(non_null) AS BIGINT), NULL, NULL, NULL, NULL FROM s WHERE "column" IN ({qlist})"""


register("column_profile_with_coverage", _cov_sql())(column_profile_with_coverage)


def total_exposure_ticks(spark, sf_dir):
    """A10 + C12: total per quarter, a tick every third year at Q2, and the
    fixed event annotation of the quarters that have one."""
    t = PR.total_by_quarter(P.fine_panel(spark, sf_dir))
    t = PR.tick_labels(t).withColumn("event", PR.event_labels())
    return round_doubles(t, 4)


register("total_exposure_ticks", f"""{FINE}
SELECT ds, {r('sum(y)')} AS total, (quarter(ds) = 2 AND year(ds) % 3 = 0) AS tick,
       CASE printf('%d-Q%d', year(ds), quarter(ds))
            {" ".join(f"WHEN '{q}' THEN '{t}'" for q, t in S.INFLECTIONS.items())} END AS event
FROM panel GROUP BY ds""")(total_exposure_ticks)
