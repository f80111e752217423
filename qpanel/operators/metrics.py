"""Error metrics as plain aggregate expressions.

Every metric is an aggregate Column, so any set of them runs as one
``groupBy().agg()`` with partial (map-side) aggregation; grouping by
model and horizon, by date, by series or overall only changes the keys.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-6


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rmse(a="actual", f="forecast") -> Column:
    """E1."""
    return F.sqrt(F.avg(F.pow(_c(f) - _c(a), 2)))


def log_rmse(a="actual", f="forecast", eps: float = EPS) -> Column:
    """Both sides floored at eps before the log (NULL pairs skipped)."""
    a, f = _c(a), _c(f)
    ok = a.isNotNull() & f.isNotNull()
    d = F.ln(F.greatest(a, F.lit(eps))) - F.ln(F.greatest(f, F.lit(eps)))
    return F.sqrt(F.avg(F.when(ok, F.pow(d, 2))))


def smape(a="actual", f="forecast") -> Column:
    """Percent, +1e-6 in the denominator."""
    a, f = _c(a), _c(f)
    return F.avg(2 * F.abs(f - a) / (F.abs(a) + F.abs(f) + F.lit(EPS))) * 100


def wmape(a="actual", f="forecast", variant: str = "abs") -> Column:
    """Weighted MAPE (Q8: the reference has four).

    * ``signed`` (E4): sum|a-f| / sum(a)
    * ``abs`` (E5): sum|a-f| / sum|a|, NULL when 0
    * ``finite`` (E6): E5 over pairs where both sides are finite
    * ``nullskip`` (E7): numerator skips missing forecasts, denominator
      keeps every actual
    """
    a, f = _c(a), _c(f)
    err = F.abs(a - f)
    if variant == "signed":
        return F.try_divide(F.sum(err), F.sum(a))
    if variant == "abs":
        ok = a.isNotNull() & f.isNotNull()
        return F.try_divide(F.sum(F.when(ok, err)), F.sum(F.when(ok, F.abs(a))))
    if variant == "finite":
        fin = (a.isNotNull() & f.isNotNull() & ~F.isnan(a) & ~F.isnan(f)
               & (F.abs(a) != float("inf")) & (F.abs(f) != float("inf")))
        return F.try_divide(F.sum(F.when(fin, err)), F.sum(F.when(fin, F.abs(a))))
    if variant == "nullskip":
        return F.try_divide(F.sum(err), F.sum(F.abs(a)))
    raise ValueError(f"unknown wmape variant {variant!r}")


def mae(a="actual", f="forecast") -> Column:
    """E10."""
    return F.avg(F.abs(_c(f) - _c(a)))


def mape_nonzero(a="actual", f="forecast") -> Column:
    """Percent, only where the actual is > 0."""
    a, f = _c(a), _c(f)
    return F.avg(F.when(a > 0, F.abs((a - f) / a))) * 100


def rmse_nonzero(a="actual", f="forecast") -> Column:
    """RMSE only where the actual is > 0."""
    a, f = _c(a), _c(f)
    return F.sqrt(F.avg(F.when(a > 0, F.pow(f - a, 2))))


def rmse_log1p(y_log="y", pred_level="forecast") -> Column:
    """RMSE between a log1p target and log1p of a level prediction."""
    return F.sqrt(F.avg(F.pow(_c(y_log) - F.log1p(_c(pred_level)), 2)))


def compute_metrics(df: DataFrame, by=("model", "horizon"),
                    a="actual", f="forecast", digits: int | None = None) -> DataFrame:
    """RMSE, Log-RMSE, SMAPE, WMAPE (signed denominator) per group."""
    cols = {
        "n": F.count(F.lit(1)),
        "rmse": rmse(a, f),
        "log_rmse": log_rmse(a, f),
        "smape": smape(a, f),
        "wmape": wmape(a, f, "signed"),
    }
    aggs = [(F.round(v, digits) if digits is not None and k != "n" else v).alias(k)
            for k, v in cols.items()]
    return df.groupBy(*by).agg(*aggs)


def metrics_by_period(df: DataFrame, by=("ds",), a="actual", f="forecast",
                      digits: int | None = None) -> DataFrame:
    """Per-quarter WMAPE (abs), SMAPE and RMSE."""
    cols = {"wmape": wmape(a, f, "abs"), "smape": smape(a, f), "rmse": rmse(a, f)}
    aggs = [(F.round(v, digits) if digits is not None else v).alias(k)
            for k, v in cols.items()]
    return df.groupBy(*by).agg(*aggs)


def wmape_rollup(df: DataFrame, key: str = "unique_id", a="actual",
                 f="forecast", digits: int | None = None) -> DataFrame:
    """WMAPE per series and overall (key NULL) in one rollup."""
    v = wmape(a, f, "abs")
    v = F.round(v, digits) if digits is not None else v
    return (df.rollup(key).agg(v.alias("wmape"),
                               F.grouping(key).cast("int").alias("is_total")))


def summarize_models(metrics: DataFrame, digits: int | None = None) -> DataFrame:
    """Mean of each metric over horizons, per model."""
    def r(c):
        return F.round(c, digits) if digits is not None else c
    return metrics.groupBy("model").agg(
        r(F.avg("rmse")).alias("rmse_mean"),
        r(F.avg("smape")).alias("smape_mean"),
        r(F.avg("wmape")).alias("wmape_mean"),
        r(F.avg("log_rmse")).alias("log_rmse_mean"))
