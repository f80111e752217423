"""DuckDB SQL fragments for the oracle side of the registered queries.

These re-state the §1.4 test mapping in plain SQL so that each Spark
query can be checked against an independent engine on the same parquet.
"""
from __future__ import annotations


def panel_sql(level: str = "region", by_bank_type: bool = False) -> str:
    """(unique_id, rep, cp, basis, ds, y) — or the bank-type exposure table."""
    if level == "region":
        sgeo, cgeo = "sr.r_name", "cr.r_name"
        joins = """
      JOIN nation cn ON cn.n_nationkey = c.c_nationkey
      JOIN region cr ON cr.r_regionkey = cn.n_regionkey
      JOIN nation sn ON sn.n_nationkey = s.s_nationkey
      JOIN region sr ON sr.r_regionkey = sn.n_regionkey"""
    else:
        sgeo, cgeo = "sn.n_name", "cn.n_name"
        joins = """
      JOIN nation cn ON cn.n_nationkey = c.c_nationkey
      JOIN nation sn ON sn.n_nationkey = s.s_nationkey"""
    bt = ""
    if by_bank_type:
        bt = """CASE o.o_orderpriority WHEN '1-URGENT' THEN '4B' WHEN '2-HIGH' THEN '4R'
                 WHEN '3-MEDIUM' THEN '4C' WHEN '4-NOT SPECIFIED' THEN '4O' END AS bank_type,"""
    inner = f"""
      SELECT {sgeo} AS rep, {cgeo} AS cp, l.l_returnflag AS basis, {bt}
             CAST(last_day(date_trunc('quarter', l.l_shipdate) + INTERVAL 2 MONTH) AS DATE) AS ds,
             sum(l.l_extendedprice) AS exposure
      FROM lineitem l
      JOIN orders o ON o.o_orderkey = l.l_orderkey
      JOIN customer c ON c.c_custkey = o.o_custkey
      JOIN supplier s ON s.s_suppkey = l.l_suppkey{joins}
      GROUP BY ALL"""
    if by_bank_type:
        return inner
    return f"""SELECT concat_ws('_', rep, cp, basis) AS unique_id, rep, cp, basis, ds,
           exposure AS y FROM ({inner}) t"""


def qidx(col: str) -> str:
    """Quarter index year*4 + quarter - 1 (INTEGER)."""
    return f"CAST(year({col}) * 4 + quarter({col}) - 1 AS INTEGER)"


def with_panels(body: str, level: str = "region", train_end: str = "1999-12-31",
                test_start: str = "2000-01-01", test_end: str = "2001-12-31") -> str:
    """WITH panel, train, test AS (...) followed by ``body``."""
    return f"""WITH panel AS ({panel_sql(level)}),
train AS (SELECT * FROM panel WHERE ds <= DATE '{train_end}'),
test AS (SELECT * FROM panel WHERE ds >= DATE '{test_start}' AND ds <= DATE '{test_end}')
{body}"""


def metric_cols(a: str = "actual", f: str = "forecast", digits: int = 4) -> str:
    """count, RMSE, Log-RMSE, SMAPE, WMAPE (signed) — same names as Spark."""
    return f"""count(*) AS n,
  round(sqrt(avg(pow({f} - {a}, 2))), {digits}) AS rmse,
  round(sqrt(avg(pow(ln(greatest({a}, 1e-6)) - ln(greatest({f}, 1e-6)), 2))), {digits}) AS log_rmse,
  round(avg(2 * abs({f} - {a}) / (abs({a}) + abs({f}) + 1e-6)) * 100, {digits}) AS smape,
  round(sum(abs({a} - {f})) / nullif(sum({a}), 0), {digits}) AS wmape"""


def r(expr: str, digits: int = 4) -> str:
    """round() that also turns -0.0 into 0.0 (matches Spark's round)."""
    return f"(round({expr}, {digits}) + 0.0)"


def rounded_select(cols: list[tuple[str, bool]], src: str, digits: int = 4) -> str:
    """SELECT with every double column rounded; cols = (name, is_double)."""
    parts = [f'{r(chr(34) + n + chr(34), digits)} AS "{n}"' if d else f'"{n}"'
             for n, d in cols]
    return f"SELECT {', '.join(parts)} FROM {src}"


def solve_sql(src: str, name: str, keys: str) -> str:
    """Recursive CTE ``name`` (keys, k, m): Gauss-Jordan elimination of the
    augmented systems ``m`` (rows of numbers, as many as unknowns) of ``src``;
    the rows with k = len(m) hold the solutions in the last columns."""
    k = keys + ", " if keys else ""
    return f"""{name} AS (SELECT {k}0 AS k, m FROM {src} UNION ALL
  SELECT {k}k + 1 AS k, [[CASE WHEN i = k + 1 THEN m[k + 1][j] / m[k + 1][k + 1]
      ELSE m[i][j] - m[i][k + 1] * m[k + 1][j] / m[k + 1][k + 1] END FOR j IN range(1, len(m[1]) + 1)]
      FOR i IN range(1, len(m) + 1)] AS m FROM {name} WHERE k < len(m))"""


def normal_equations_sql(src: str, unknowns: str, keys: str, ridge: float = 0.0) -> str:
    """SELECT of (keys, m): augmented normal equations of the rows ``e`` of
    ``src``, each [1, regressors..., targets...] with ``unknowns`` leading
    entries to solve for; ``ridge`` is added to all pivots but the first."""
    k = keys + ", " if keys else ""
    by = f"GROUP BY {keys}" if keys else ""
    return f"""SELECT {k}list(row_i ORDER BY i) AS m FROM (
    SELECT {k}i, list(v ORDER BY j) AS row_i FROM (
      SELECT {k}i, j, sum(e[i] * e[j]) + CASE WHEN i = j AND i > 1 THEN {ridge} ELSE 0 END AS v
      FROM (SELECT {k}e, i, unnest(range(1, len(e) + 1)) AS j
            FROM (SELECT {k}e, unnest(range(1, {unknowns} + 1)) AS i FROM {src}))
      GROUP BY {k}i, j) GROUP BY {k}i) {by}"""
