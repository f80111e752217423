"""Registered queries: densification, gap filling and its scores."""
from __future__ import annotations


from qpanel import schema as S
from qpanel.operators import impute as I
from qpanel.plans import panels as P
from qpanel.plans.catalog import register
from qpanel.plans.output import round_doubles
from qpanel.plans.queries_profile import _DENSE_SQL
from qpanel.plans.sql import qidx, r

_W = "PARTITION BY unique_id ORDER BY ds"


def _dense(spark, sf_dir):
    # one pass over the raw tables: bounds and calendar come from the shared panel
    return I.densify(P.shared(P.fine_panel(spark, sf_dir)))


def dense_panel(spark, sf_dir):
    """Densified fine panel: every series x every quarter."""
    return round_doubles(_dense(spark, sf_dir), 4)


register("dense_panel", f"""{_DENSE_SQL}
SELECT unique_id, ds, {r('y')} AS y FROM dense""")(dense_panel)

_LINEAR = f"""CASE WHEN y IS NOT NULL THEN y
  WHEN q0 IS NOT NULL AND q1 IS NOT NULL THEN v0 + (v1 - v0) * ({qidx('ds')} - q0) / (q1 - q0)
  ELSE coalesce(v0, v1) END"""
_LINEAR_COLS = f"""last(y IGNORE NULLS) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS v0,
  last(CASE WHEN y IS NOT NULL THEN {qidx('ds')} END IGNORE NULLS) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS q0,
  first(y IGNORE NULLS) OVER ({_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v1,
  first(CASE WHEN y IS NOT NULL THEN {qidx('ds')} END IGNORE NULLS) OVER ({_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q1"""
_FFILL = f"""coalesce(last(y IGNORE NULLS) OVER ({_W} ROWS UNBOUNDED PRECEDING),
  first(y IGNORE NULLS) OVER ({_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


def imputed_linear(spark, sf_dir):
    """I3 on the densified fine panel."""
    # gaps <= 27 quarters: exact values have <= 6 decimals, so no ties at 6
    return round_doubles(I.impute_linear(_dense(spark, sf_dir)), 6)


register("imputed_linear", f"""{_DENSE_SQL},
k AS (SELECT unique_id, ds, y, {_LINEAR_COLS} FROM dense)
SELECT unique_id, ds, {r(_LINEAR, 6)} AS y FROM k""")(imputed_linear)


def imputed_ffill(spark, sf_dir):
    """I2 on the densified fine panel."""
    return round_doubles(I.impute_ffill(_dense(spark, sf_dir)), 4)


register("imputed_ffill", f"""{_DENSE_SQL}
SELECT unique_id, ds, {r(_FFILL)} AS y FROM dense""")(imputed_ffill)


def _masked(spark, sf_dir):
    return I.mask_cells(_dense(spark, sf_dir))


def imputation_scores(spark, sf_dir):
    """Hide ~10 % of known cells by the md5 rule, fill with zeros,
    forward fill and linear, score MAE / RMSE on the hidden cells and the
    KS / Wasserstein distance of the filled values to the original ones."""
    s = I.compare_imputers(_masked(spark, sf_dir), ("zeros", "ffill", "linear"))
    return round_doubles(s, 4)


register("imputation_scores", f"""{_DENSE_SQL},
masked AS (SELECT unique_id, ds, y AS truth,
  (y IS NOT NULL AND substr(md5(unique_id || '|' || year(ds) || '-Q' || quarter(ds)), 1, 2) < '1a') AS hidden
  FROM dense),
m AS (SELECT *, CASE WHEN hidden THEN NULL ELSE truth END AS y FROM masked),
k AS (SELECT *, {_LINEAR_COLS} FROM m),
filled AS (
  SELECT 'zeros' AS method, truth, hidden, coalesce(y, 0) AS v FROM m
  UNION ALL SELECT 'ffill', truth, hidden, {_FFILL} FROM m
  UNION ALL SELECT 'linear', truth, hidden, {_LINEAR} FROM k),
err AS (SELECT method, avg(abs(v - truth)) AS mae, sqrt(avg(pow(v - truth, 2))) AS rmse,
               count(*) AS n_hidden FROM filled WHERE hidden AND v IS NOT NULL GROUP BY method),
vals AS (SELECT method, truth AS x, 1 AS a, 0 AS b FROM filled WHERE truth IS NOT NULL
         UNION ALL SELECT method, v, 0, 1 FROM filled WHERE v IS NOT NULL),
agg AS (SELECT method, x, sum(a) AS n1, sum(b) AS n2 FROM vals GROUP BY method, x),
cum AS (SELECT method, x,
          sum(n1) OVER (PARTITION BY method ORDER BY x) / sum(n1) OVER (PARTITION BY method) AS f1,
          sum(n2) OVER (PARTITION BY method ORDER BY x) / sum(n2) OVER (PARTITION BY method) AS f2,
          lead(x) OVER (PARTITION BY method ORDER BY x) AS nx FROM agg),
dist AS (SELECT method, max(abs(f1 - f2)) AS ks,
                coalesce(sum(abs(f1 - f2) * (nx - x)), 0) AS wasserstein FROM cum GROUP BY method)
SELECT method, {r('mae')} AS mae, {r('rmse')} AS rmse, n_hidden, {r('ks')} AS ks,
       {r('wasserstein')} AS wasserstein FROM err JOIN dist USING (method)""")(imputation_scores)


def imputed_poly(spark, sf_dir):
    """I4 on the densified fine panel."""
    return round_doubles(I.impute_poly(_dense(spark, sf_dir)), 3)


# orthogonal polynomials of the known quarters, one CTE of sums a degree
register("imputed_poly", f"""{_DENSE_SQL},
k AS (SELECT unique_id, ds, y, {_LINEAR_COLS}, CAST(row_number() OVER ({_W}) AS DOUBLE) AS x FROM dense),
a0 AS (SELECT *, {_LINEAR} AS line, count(y) OVER s AS n, avg(x) FILTER (WHERE y IS NOT NULL) OVER s AS c,
       greatest(stddev_pop(x) FILTER (WHERE y IS NOT NULL) OVER s, 1.0) AS w FROM k WINDOW s AS (PARTITION BY unique_id)),
a1 AS (SELECT *, (x - c) / w AS u, CASE WHEN y IS NOT NULL THEN (x - c) / w END AS v FROM a0),
a2 AS (SELECT *, avg(y) OVER s AS b0, sum(v * y) OVER s / sum(v * v) OVER s AS b1, sum(v * v) OVER s AS s1,
       sum(v * v * v) OVER s / sum(v * v) OVER s AS e1 FROM a1 WINDOW s AS (PARTITION BY unique_id)),
a3 AS (SELECT *, (u - e1) * u - s1 / n AS p2, (v - e1) * v - s1 / n AS r2 FROM a2),
a4 AS (SELECT *, sum(r2 * y) OVER s / nullif(sum(r2 * r2) OVER s, 0) AS b2, sum(r2 * r2) OVER s AS s2,
       sum(v * r2 * r2) OVER s / nullif(sum(r2 * r2) OVER s, 0) AS e2 FROM a3 WINDOW s AS (PARTITION BY unique_id)),
a5 AS (SELECT *, (u - e2) * p2 - s2 / s1 * u AS p3, (v - e2) * r2 - s2 / s1 * v AS r3 FROM a4),
a6 AS (SELECT *, sum(r3 * y) OVER s / nullif(sum(r3 * r3) OVER s, 0) AS b3 FROM a5 WINDOW s AS (PARTITION BY unique_id))
SELECT unique_id, ds, {r('CASE WHEN y IS NOT NULL THEN y WHEN n = 0 THEN 0.0 WHEN n >= 4 THEN b0 + b1 * u + b2 * p2 + b3 * p3 ELSE line END', 3)} AS y FROM a6""")(imputed_poly)


def imputation_scores_poly(spark, sf_dir):
    """I4 scored like the others (their values are checked by imputed_poly)."""
    s = I.compare_imputers(_masked(spark, sf_dir), ("poly",))
    return round_doubles(s, 4)


register("imputation_scores_poly")(imputation_scores_poly)


def _knn_sql(src: str, k: int, nq: int = 28, weights: str = "distance", scale: bool = True) -> str:
    """CTEs computing the KNN fill of table ``src`` (unique_id, ds, y):
    result CTE ``knn`` (unique_id, ds, y_filled)."""
    mu, sd = ("avg(y)", "CASE WHEN stddev_pop(y) IS NULL OR stddev_pop(y) = 0 THEN 1.0 ELSE stddev_pop(y) END") if scale else ("0.0", "1.0")
    fill = """CASE WHEN max(CASE WHEN dist = 0 THEN 1 ELSE 0 END) = 1 THEN avg(dz) FILTER (WHERE dist = 0)
               ELSE sum((1.0 / dist) * dz) / sum(1.0 / dist) END""" if weights == "distance" else "avg(dz)"
    return f"""kst AS (SELECT unique_id, CAST({mu} AS DOUBLE) AS mu, CAST({sd} AS DOUBLE) AS sd
       FROM {src} GROUP BY 1),
kz AS (SELECT s.unique_id, s.ds, s.y, (s.y - kst.mu) / kst.sd AS z, kst.mu, kst.sd
       FROM {src} s JOIN kst USING (unique_id)),
kpr AS (SELECT a.unique_id AS i, b.unique_id AS j, sqrt({nq}.0 / count(*) * sum(pow(a.z - b.z, 2))) AS dist
        FROM kz a JOIN kz b ON a.ds = b.ds AND a.unique_id <> b.unique_id
        WHERE a.z IS NOT NULL AND b.z IS NOT NULL GROUP BY 1, 2),
kcand AS (SELECT c.unique_id AS i, c.ds, p.j, p.dist, d.z AS dz
          FROM kz c JOIN kpr p ON p.i = c.unique_id
          JOIN kz d ON d.unique_id = p.j AND d.ds = c.ds AND d.z IS NOT NULL
          WHERE c.z IS NULL),
ktop AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY i, ds ORDER BY dist, j) AS rn FROM kcand)
         WHERE rn <= {k}),
kfill AS (SELECT i AS unique_id, ds,
          {fill} AS zfill FROM ktop GROUP BY 1, 2),
kcm AS (SELECT ds, avg(z) AS zmean FROM kz GROUP BY ds),
knn AS (SELECT kz.unique_id, kz.ds,
        CASE WHEN kz.y IS NOT NULL THEN kz.y ELSE coalesce(f.zfill, kcm.zmean) * kz.sd + kz.mu END AS y_filled
        FROM kz LEFT JOIN kfill f USING (unique_id, ds) LEFT JOIN kcm USING (ds))"""


def imputed_knn(spark, sf_dir):
    """k=5 nearest series (inverse distance) on the densified fine panel."""
    from qpanel.operators.knn import impute_knn
    return round_doubles(impute_knn(_dense(spark, sf_dir).select(S.UID, S.DS, S.Y), k=5), 4)


register("imputed_knn", f"""{_DENSE_SQL},
src AS (SELECT unique_id, ds, y FROM dense),
{_knn_sql('src', 5)}
SELECT unique_id, ds, {r('y_filled')} AS y FROM knn""")(imputed_knn)


def imputed_knn_uniform(spark, sf_dir):
    """I5 with uniform weights."""
    from qpanel.operators.knn import impute_knn
    return round_doubles(impute_knn(_dense(spark, sf_dir).select(S.UID, S.DS, S.Y), k=3, weights="uniform"), 4)


register("imputed_knn_uniform", f"""{_DENSE_SQL},
src AS (SELECT unique_id, ds, y FROM dense),
{_knn_sql('src', 3, weights='uniform')}
SELECT unique_id, ds, {r('y_filled')} AS y FROM knn""")(imputed_knn_uniform)


def imputed_knn_unscaled(spark, sf_dir):
    """I5 on the values as they are."""
    from qpanel.operators.knn import impute_knn
    return round_doubles(impute_knn(_dense(spark, sf_dir).select(S.UID, S.DS, S.Y), k=5, scale=False), 4)


register("imputed_knn_unscaled", f"""{_DENSE_SQL},
src AS (SELECT unique_id, ds, y FROM dense),
{_knn_sql('src', 5, scale=False)}
SELECT unique_id, ds, {r('y_filled')} AS y FROM knn""")(imputed_knn_unscaled)


def imputation_scores_knn(spark, sf_dir):
    """I5 + I7-I9: KNN (k=5) scored on the md5-hidden cells."""
    s = I.compare_imputers(_masked(spark, sf_dir), ("knn_5",))
    return round_doubles(s, 4)


register("imputation_scores_knn", f"""{_DENSE_SQL},
masked AS (SELECT unique_id, ds, y AS truth,
  (y IS NOT NULL AND substr(md5(unique_id || '|' || year(ds) || '-Q' || quarter(ds)), 1, 2) < '1a') AS hidden
  FROM dense),
m AS (SELECT *, CASE WHEN hidden THEN NULL ELSE truth END AS y FROM masked),
{_knn_sql('m', 5)},
filled AS (SELECT 'knn_5' AS method, m.truth, m.hidden, k.y_filled AS v FROM m JOIN knn k USING (unique_id, ds)),
err AS (SELECT method, avg(abs(v - truth)) AS mae, sqrt(avg(pow(v - truth, 2))) AS rmse,
               count(*) AS n_hidden FROM filled WHERE hidden AND v IS NOT NULL GROUP BY method),
vals AS (SELECT method, truth AS x, 1 AS a, 0 AS b FROM filled WHERE truth IS NOT NULL
         UNION ALL SELECT method, v, 0, 1 FROM filled WHERE v IS NOT NULL),
agg AS (SELECT method, x, sum(a) AS n1, sum(b) AS n2 FROM vals GROUP BY method, x),
cum AS (SELECT method, x,
          sum(n1) OVER (PARTITION BY method ORDER BY x) / sum(n1) OVER (PARTITION BY method) AS f1,
          sum(n2) OVER (PARTITION BY method ORDER BY x) / sum(n2) OVER (PARTITION BY method) AS f2,
          lead(x) OVER (PARTITION BY method ORDER BY x) AS nx FROM agg),
dist AS (SELECT method, max(abs(f1 - f2)) AS ks,
                coalesce(sum(abs(f1 - f2) * (nx - x)), 0) AS wasserstein FROM cum GROUP BY method)
SELECT method, {r('mae')} AS mae, {r('rmse')} AS rmse, n_hidden, {r('ks')} AS ks,
       {r('wasserstein')} AS wasserstein FROM err JOIN dist USING (method)""")(imputation_scores_knn)


_SCORED_SQL = f"""err AS (SELECT method, avg(abs(v - truth)) AS mae, sqrt(avg(pow(v - truth, 2))) AS rmse,
               count(*) AS n_hidden FROM filled WHERE hidden AND v IS NOT NULL GROUP BY method),
vals AS (SELECT method, truth AS x, 1 AS a, 0 AS b FROM filled WHERE truth IS NOT NULL
         UNION ALL SELECT method, v, 0, 1 FROM filled WHERE v IS NOT NULL),
agg AS (SELECT method, x, sum(a) AS n1, sum(b) AS n2 FROM vals GROUP BY method, x),
cum AS (SELECT method, x,
          sum(n1) OVER (PARTITION BY method ORDER BY x) / sum(n1) OVER (PARTITION BY method) AS f1,
          sum(n2) OVER (PARTITION BY method ORDER BY x) / sum(n2) OVER (PARTITION BY method) AS f2,
          lead(x) OVER (PARTITION BY method ORDER BY x) AS nx FROM agg),
dist AS (SELECT method, max(abs(f1 - f2)) AS ks,
                coalesce(sum(abs(f1 - f2) * (nx - x)), 0) AS wasserstein FROM cum GROUP BY method)
SELECT method, {r('mae')} AS mae, {r('rmse')} AS rmse, n_hidden, {r('ks')} AS ks,
       {r('wasserstein')} AS wasserstein FROM err JOIN dist USING (method)"""


def knn_k_sweep(spark, sf_dir):
    """K-NN fills for k = 1, 3, 5, 7, 9 scored on the same hidden cells."""
    s = I.compare_imputers(_masked(spark, sf_dir), tuple(f"knn_{k}" for k in (1, 3, 5, 7, 9)))
    return round_doubles(s, 4)


_KNN_9 = _knn_sql("m", 9)
register("knn_k_sweep", f"""{_DENSE_SQL},
masked AS (SELECT unique_id, ds, y AS truth,
  (y IS NOT NULL AND substr(md5(unique_id || '|' || year(ds) || '-Q' || quarter(ds)), 1, 2) < '1a') AS hidden
  FROM dense),
m AS (SELECT *, CASE WHEN hidden THEN NULL ELSE truth END AS y FROM masked),
{_KNN_9[:_KNN_9.index('kfill AS')]}
ks(k) AS (VALUES (1), (3), (5), (7), (9)),
kfill AS (SELECT k, i AS unique_id, ds,
          CASE WHEN max(CASE WHEN dist = 0 THEN 1 ELSE 0 END) = 1 THEN avg(dz) FILTER (WHERE dist = 0)
               ELSE sum((1.0 / dist) * dz) / sum(1.0 / dist) END AS zfill FROM ktop JOIN ks ON rn <= k GROUP BY 1, 2, 3),
kcm AS (SELECT ds, avg(z) AS zmean FROM kz GROUP BY ds),
filled AS (SELECT 'knn_' || ks.k AS method, m.truth, m.hidden,
        CASE WHEN kz.y IS NOT NULL THEN kz.y ELSE coalesce(f.zfill, kcm.zmean) * kz.sd + kz.mu END AS v
        FROM ks CROSS JOIN kz JOIN m USING (unique_id, ds) LEFT JOIN kfill f ON f.k = ks.k AND f.unique_id = kz.unique_id AND f.ds = kz.ds
        LEFT JOIN kcm ON kcm.ds = kz.ds),
{_SCORED_SQL}""")(knn_k_sweep)
