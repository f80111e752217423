"""Registered queries: raw claims table, cleaning, consolidation, reshaping."""
from __future__ import annotations

from pyspark.sql import functions as F

from qpanel import schema as S
from qpanel.operators import clean as C
from qpanel.operators import reshape as R
from qpanel.plans import panels as P
from qpanel.plans.catalog import register
from qpanel.plans.sql import panel_sql

# Calendar of the driver's tables, for the oracles (Spark takes it from the data).
QUARTERS = R.quarter_labels("1995-Q1", "2001-Q4")
ID_COLS = ["Reporting country", "Counterparty country", "L_REP_CTY",
           "L_CP_COUNTRY", "CBS_BASIS", "CBS_BANK_TYPE"]


def _qdate(label: str) -> str:
    y, q = int(label[:4]), int(label[-1])
    return {1: f"{y}-03-31", 2: f"{y}-06-30", 3: f"{y}-09-30", 4: f"{y}-12-31"}[q]


def claims_long(spark, sf_dir):
    """Raw claims in long form with the reference's descriptor names."""
    e = P.exposures(spark, sf_dir, "nation", by_bank_type=True)
    return e.select(F.col(S.REP).alias("Reporting country"),
                    F.col(S.CP).alias("Counterparty country"),
                    F.col(S.REP).alias("L_REP_CTY"), F.col(S.CP).alias("L_CP_COUNTRY"),
                    F.col(S.BASIS).alias("CBS_BASIS"), F.col(S.BANK_TYPE).alias("CBS_BANK_TYPE"),
                    S.DS, F.col("exposure").alias(S.Y))


def claims_wide(spark, sf_dir):
    """The raw wide table: one column per quarter (R3 over periods)."""
    long = P.shared(claims_long(spark, sf_dir))
    quarters = R.calendar_labels(long)
    w = R.long_to_wide(long, ID_COLS, quarters)
    return w.select(*[F.col(f"`{c}`") for c in ID_COLS],
                    *[F.round(F.col(f"`{q}`"), 4).alias(q) for q in quarters])


_CLAIMS_SQL = f"""WITH e AS ({panel_sql('nation', by_bank_type=True)})
SELECT rep AS "Reporting country", cp AS "Counterparty country", rep AS L_REP_CTY,
       cp AS L_CP_COUNTRY, basis AS CBS_BASIS, bank_type AS CBS_BANK_TYPE,
       {", ".join(f"round(max(CASE WHEN ds = DATE '{_qdate(q)}' THEN exposure END), 4) AS \"{q}\"" for q in QUARTERS)}
FROM e GROUP BY ALL"""

register("claims_wide", _CLAIMS_SQL)(claims_wide)


def claims_long_all(spark, sf_dir):
    """Wide -> long keeping empty cells."""
    w = claims_wide(spark, sf_dir)
    return R.wide_to_long(w, ID_COLS, C.quarter_columns(w), keep_nulls=True).drop(S.DS)


register("claims_long_all", f"""WITH w AS ({_CLAIMS_SQL})
SELECT {", ".join(f'"{c}"' for c in ID_COLS)}, quarter, y FROM w
UNPIVOT INCLUDE NULLS (y FOR quarter IN ({", ".join(f'"{q}"' for q in QUARTERS)}))""")(claims_long_all)


def claims_long_filled(spark, sf_dir):
    """R2: wide -> long dropping empty cells, with the quarter-end date."""
    w = claims_wide(spark, sf_dir)
    return R.wide_to_long(w, ID_COLS, C.quarter_columns(w), keep_nulls=False)


register("claims_long_filled", f"""WITH w AS ({_CLAIMS_SQL}), u AS (
UNPIVOT w ON {", ".join(f'"{q}"' for q in QUARTERS)} INTO NAME quarter VALUE y)
SELECT *, CAST(last_day(make_date(CAST(substr(quarter, 1, 4) AS INTEGER),
       CAST(substr(quarter, 7, 1) AS INTEGER) * 3, 1)) AS DATE) AS ds FROM u""")(claims_long_filled)


def filter_audit(spark, sf_dir):
    """P10: rows removed per cleaning step (first failing step) and kept."""
    w = claims_wide(spark, sf_dir)
    return C.filter_audit(w, time_cols=C.quarter_columns(w))


register("filter_audit", f"""WITH w AS ({_CLAIMS_SQL})
SELECT CASE WHEN lower(trim(coalesce("Reporting country", ''))) IN
            ({", ".join("'" + e.lower().strip().replace("'", "''") + "'" for e in S.AGGREGATE_ENTITIES)})
         OR lower(trim(coalesce("Counterparty country", ''))) IN
            ({", ".join("'" + e.lower().strip().replace("'", "''") + "'" for e in S.AGGREGATE_ENTITIES)})
         THEN 'aggregate_entity'
       WHEN {" AND ".join(f'"{q}" IS NULL' for q in QUARTERS)} THEN 'all_periods_missing'
       WHEN NOT coalesce(upper(trim(CBS_BANK_TYPE)) IN ('4B', '4R', '4C', '4O'), false)
         THEN 'bank_type_out_of_scope'
       ELSE 'kept' END AS step, count(*) AS rows
FROM w GROUP BY 1""")(filter_audit)


def consolidated_panel(spark, sf_dir):
    """Clean long claims, pivot the four bank types,
    consolidate 4B - 4R + (4C + 4O) (or 4B when the foreign part is 0)."""
    cl = claims_long(spark, sf_dir)
    cl = cl.filter(~C.is_aggregate_entity("Reporting country")
                   & ~C.is_aggregate_entity("Counterparty country")
                   & C.keep_bank_types("CBS_BANK_TYPE"))
    cl = C.normalise_codes(cl, ["L_REP_CTY", "L_CP_COUNTRY", "CBS_BASIS", "CBS_BANK_TYPE"])
    wide = C.pivot_bank_types(cl, ["L_REP_CTY", "L_CP_COUNTRY", "CBS_BASIS", S.DS],
                              bank_col="CBS_BANK_TYPE", value_col=S.Y)
    out = C.consolidate(wide)
    return out.select("L_REP_CTY", "L_CP_COUNTRY", "CBS_BASIS", S.DS,
                      *[F.round(F.col(c), 4).alias(c) for c in S.BANK_TYPES + ["consolidated"]])


register("consolidated_panel", f"""WITH e AS ({panel_sql('nation', by_bank_type=True)}),
p AS (
  SELECT upper(trim(rep)) AS L_REP_CTY, upper(trim(cp)) AS L_CP_COUNTRY,
         upper(trim(basis)) AS CBS_BASIS, ds,
         coalesce(sum(CASE WHEN bank_type = '4B' THEN exposure END), 0) AS b,
         coalesce(sum(CASE WHEN bank_type = '4R' THEN exposure END), 0) AS r,
         coalesce(sum(CASE WHEN bank_type = '4C' THEN exposure END), 0) AS c,
         coalesce(sum(CASE WHEN bank_type = '4O' THEN exposure END), 0) AS o
  FROM e WHERE bank_type IN ('4B', '4R', '4C', '4O') GROUP BY ALL)
SELECT L_REP_CTY, L_CP_COUNTRY, CBS_BASIS, ds, round(b, 4) AS "4B", round(r, 4) AS "4R",
       round(c, 4) AS "4C", round(o, 4) AS "4O",
       round(CASE WHEN c + o = 0 THEN b ELSE b - r + (c + o) END, 4) AS consolidated
FROM p""")(consolidated_panel)


def pair_totals(spark, sf_dir):
    """A1: total exposure per (reporter, counterparty, quarter)."""
    t = C.pair_totals(P.fine_panel(spark, sf_dir))
    return t.withColumn("total", F.round("total", 4))


register("pair_totals", f"""WITH panel AS ({panel_sql('nation')})
SELECT rep, cp, ds, round(coalesce(sum(y), 0), 4) AS total FROM panel GROUP BY ALL""")(pair_totals)


def split_label_counts(spark, sf_dir):
    """Train (<=1998) / valid (1999) / test (2000-2001) labels."""
    lab = C.period_label(train=("1995-01-01", "1998-12-31"),
                         valid=("1999-01-01", "1999-12-31"),
                         test=("2000-01-01", "2001-12-31"))
    p = P.fine_panel(spark, sf_dir).withColumn("split", lab)
    return p.groupBy("split").agg(F.count(F.lit(1)).alias("cells"),
                                  F.countDistinct(S.UID).alias("series"),
                                  F.round(F.sum(S.Y), 2).alias("total"))


register("split_label_counts", f"""WITH panel AS ({panel_sql('nation')})
SELECT CASE WHEN ds BETWEEN DATE '1995-01-01' AND DATE '1998-12-31' THEN 'train'
            WHEN ds BETWEEN DATE '1999-01-01' AND DATE '1999-12-31' THEN 'valid'
            WHEN ds BETWEEN DATE '2000-01-01' AND DATE '2001-12-31' THEN 'test' END AS split,
       count(*) AS cells, count(DISTINCT unique_id) AS series, round(sum(y), 2) AS total
FROM panel GROUP BY 1""")(split_label_counts)
