"""Least squares as one aggregate and a solve in column expressions.

``least_squares`` sums means and covariances in a single pass (partial sums
on the map side, one row a group after the shuffle) and solves the normal
equations by an LDL' (square-root-free Cholesky) factorisation spelt out over
columns.  Nothing but one row a group leaves the aggregate, and no Python
worker takes part.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A pivot below this share of its own variance is a linear combination of the
# regressors before it.
DEPENDENT = 1e-12


def _total(terms: list[Column]) -> Column:
    out = F.lit(0.0)
    for t in terms:
        out = out + t
    return out


def least_squares(rows: DataFrame, size: int, x: str = "x", target: str = "target",
                  reg: float = 0.0, by: tuple[str, ...] = ()) -> DataFrame:
    """target ~ intercept + x[0..size-1] for each group of ``by`` (none: one
    fit over all rows).

    Minimises mean squared error / 2 + reg / 2 * sum(coefs^2); the intercept
    is not penalised.  Returns (by..., n, intercept, coefs, mse).

    Rows with a NULL target, a NULL value in ``x`` or fewer than ``size``
    values take no part.  A regressor that is constant, or a combination of
    the ones before it, gets the coefficient 0.  Without rows an ungrouped fit
    returns n = 0 and NULLs, a grouped one no row.  NaNs give NaNs.  A group's
    sums are merged from partial ones, so a hot group needs no single task.
    """
    v = [F.try_element_at(x, F.lit(i + 1)).cast("double") for i in range(size)]
    known = rows.filter(F.col(target).isNotNull())
    for c in v:
        known = known.filter(c.isNotNull())
    known = known.select(*by, *[c.alias(f"_x{i}") for i, c in enumerate(v)], F.col(target).cast("double").alias("_y"))
    names = [f"_x{i}" for i in range(size)]
    sums = [F.count(F.lit(1)).alias("n"), F.avg("_y").alias("_my"), F.var_pop("_y").alias("_vy")]
    sums += [F.avg(c).alias(f"_m{i}") for i, c in enumerate(names)]
    sums += [F.covar_pop(names[i], names[j]).alias(f"_c{i}_{j}") for i in range(size) for j in range(i + 1)]
    sums += [F.covar_pop(c, "_y").alias(f"_s{i}") for i, c in enumerate(names)]
    return solve(known.groupBy(*by).agg(*sums) if by else known.agg(*sums), size, reg, by)


def solve(d: DataFrame, size: int, reg: float = 0.0, by: tuple[str, ...] = ()) -> DataFrame:
    """The fits from their moments, a row each: n, means ``_m0..`` and ``_my``,
    covariances ``_c{i}_{j}`` (j <= i) and ``_s{i}`` (with the target), and the
    target's variance ``_vy``.  Returns (by..., n, intercept, coefs, mse)."""
    def low(i, j):
        return F.col(f"_l{i}_{j}")

    for k in range(size):
        # column k of the factor: pivot, then the entries below it
        var = F.col(f"_c{k}_{k}") + F.lit(reg)
        d = d.withColumn(f"_d{k}", var - _total([low(k, j) * low(k, j) * F.col(f"_d{j}") for j in range(k)]))
        d = d.withColumn(f"_ok{k}", F.col(f"_d{k}") > F.lit(DEPENDENT) * var)
        below = {f"_l{i}_{k}": F.when(
            F.col(f"_ok{k}"), (F.col(f"_c{i}_{k}") - _total([low(i, j) * low(k, j) * F.col(f"_d{j}") for j in range(k)])) / F.col(f"_d{k}"))
            .otherwise(0.0) for i in range(k + 1, size)}
        # forward substitution: L f = s
        below[f"_f{k}"] = F.col(f"_s{k}") - _total([low(k, j) * F.col(f"_f{j}") for j in range(k)])
        d = d.withColumns(below)
    for k in reversed(range(size)):
        # L' w = D^-1 f
        w = F.col(f"_f{k}") / F.col(f"_d{k}") - _total([low(i, k) * F.col(f"_w{i}") for i in range(k + 1, size)])
        d = d.withColumn(f"_w{k}", F.when(F.col("n") > 0, F.when(F.col(f"_ok{k}"), w).otherwise(0.0)))
    coefs = [F.col(f"_w{k}") for k in range(size)]
    fit = F.col("_my") - _total([c * F.col(f"_m{i}") for i, c in enumerate(coefs)])
    # mean squared error from the sums: Vy - 2 w's + w'Cw
    quad = [coefs[i] * coefs[j] * F.col(f"_c{max(i, j)}_{min(i, j)}") for i in range(size) for j in range(size)]
    mse = F.col("_vy") - 2 * _total([c * F.col(f"_s{i}") for i, c in enumerate(coefs)]) + _total(quad)
    return d.select(*by, "n", fit.alias("intercept"),
                    F.when(F.col("n") > 0, F.array(*coefs).cast("array<double>")).alias("coefs"),
                    F.when(F.col("n") > 0, F.greatest(mse, F.lit(0.0))).alias("mse"))
