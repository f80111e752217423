"""Rolling back-tests of the fitted models (F4 for F5, F13 and F14).

The folds are those of ``forecast.fold_calendar``.  Each function reads the
panel once for all folds and returns one row for each cell in a fold's
validation quarters that has an actual value: (fold, unique_id, ds, step,
forecast, actual, status).  The values are those of a refit on each fold's
training rows.

* ``backtest_linear``: moments of the windows are summed along each series
  once; a fold's moments are the difference of two prefixes, brought to the
  fold's own scale and added up over the series.  All folds are solved together
  over columns; what a fold adds to the shuffle is one row of sums a task.
* ``backtest_ar``: a call sees one whole series and fits all its folds.
* ``backtest_blocks``: a call sees one block of series and fits all its folds.

A series without a row in a fold's training quarters has no row in that fold.
NULL forecasts carry the reason in ``status``, as the forecasters give it.  A panel
shorter than one fold, or an empty one, gives an empty table.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qpanel import schema as S
from qpanel.functions.dates import quarter_index
from qpanel.functions.least_squares import solve
from qpanel.operators import models as MD
from qpanel.operators.features import series_window
from qpanel.operators.forecast import fold_calendar
from qpanel.plans.joins import fixed_small
from qpanel.plans.series_map import map_series

RESULT = f"fold int, {S.UID} string, qi int, step int, forecast double, actual double, status string"


def fold_bounds(panel: DataFrame, train_years: int, test_years: int) -> list[tuple[int, int, int]]:
    """(fold, first training quarter, last one) as quarter indexes: one row a
    fold, so its size is that of the calendar."""
    cal = fold_calendar(panel, train_years, test_years)
    rows = cal.groupBy("fold").agg(F.min(quarter_index(S.DS)).alias("a"), F.max(quarter_index("cutoff")).alias("b")).orderBy("fold").collect()
    return [(r["fold"], r["a"], r["b"]) for r in rows]


def _dated(out: DataFrame) -> DataFrame:
    return out.select("fold", S.UID, MD._quarter_end_of_index(F.col("qi")).alias(S.DS), "step", "forecast", "actual", "status")


def _empty(panel: DataFrame) -> DataFrame:
    return _dated(panel.sparkSession.createDataFrame([], RESULT))


def _recursive(seed: Column, intercept: Column, coefs: Column, steps: Column) -> Column:
    """``steps`` predictions of a linear model whose window starts as ``seed``."""
    start = F.struct(seed.alias("w"), F.array().cast("array<double>").alias("out"))

    def step(acc, _):
        pred = intercept + F.aggregate(F.zip_with(acc["w"], coefs, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
        return F.struct(F.concat(F.slice(acc["w"], 2, F.size(acc["w"])), F.array(pred)).alias("w"),
                        F.concat(acc["out"], F.array(pred)).alias("out"))
    return F.aggregate(F.sequence(F.lit(1), steps), start, step, lambda acc: acc["out"])


def backtest_linear(panel: DataFrame, train_years: int = 3, test_years: int = 1, n_steps: int = 4, reg: float = 0.0) -> DataFrame:
    """F4 of ``models.recursive_linear_forecast``: in each fold the series are
    scaled on their training rows, one linear model is fitted on all their windows
    of ``n_steps`` values, and its predictions are fed back.

    Rows of one series are told apart by their quarter; one with a NULL value breaks the
    windows it lies in.  ``status``: ok, too_short (fewer than ``n_steps`` values), or no_model
    (no window in the fold)."""
    folds = fold_bounds(panel, train_years, test_years)
    if not folds:
        return _empty(panel)
    h, n = 4 * test_years, n_steps
    w = series_window(S.UID, "_qi")
    rows = panel.select(S.UID, quarter_index(S.DS).alias("_qi"), F.col(S.Y).cast("double").alias(S.Y))
    # A series' own centre and scale keep the sums near 1; a fold's come after.
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    centre, scale = F.avg(S.Y).over(every), F.stddev_pop(S.Y).over(every)
    rows = rows.withColumns({"_k": F.coalesce(centre, F.lit(0.0)), "_u": F.when(scale > 0, scale).otherwise(1.0)})
    rows = rows.withColumn("_v", (F.col(S.Y) - F.col("_k")) / F.col("_u"))
    v = [F.lag("_v", n - i).over(w) for i in range(n)] + [F.col("_v")]
    rows = rows.withColumns({f"_a{i}": c for i, c in enumerate(v)})
    pairs = [(i, j) for i in range(n + 1) for j in range(i + 1)]
    whole = F.lit(True)
    for i in range(n + 1):
        whole = whole & F.col(f"_a{i}").isNotNull()
    terms = [F.lit(1.0)] + [F.col(f"_a{i}") for i in range(n + 1)] + [F.col(f"_a{i}") * F.col(f"_a{j}") for i, j in pairs]
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"_p{t}": F.sum(F.when(whole, c).otherwise(0.0)).over(upto) for t, c in enumerate(terms)})
    prefix = F.array(*[F.col(f"_p{t}") for t in range(len(terms))])
    series = rows.groupBy(S.UID).agg(F.first("_k").alias("_k"), F.first("_u").alias("_u"), F.sort_array(F.collect_list(
        F.struct("_qi", F.col(S.Y).alias("y"), prefix.alias("p")))).alias("_r"))

    fold = F.explode(F.array(*[F.struct(F.lit(f).alias("fold"), F.lit(a).alias("a"), F.lit(b).alias("b")) for f, a, b in folds])).alias("_f")
    d = series.select("*", fold).select("*", F.col("_f.fold").alias("fold"), F.col("_f.b").alias("_end"))
    before = F.size(F.filter("_r", lambda x: x["_qi"] < F.col("_f.a")))
    mine = F.filter("_r", lambda x: (x["_qi"] >= F.col("_f.a")) & (x["_qi"] <= F.col("_f.b")))
    d = d.withColumns({"_r0": before, "_t": mine}).filter(F.size("_t") > 0)
    known = F.filter(F.transform("_t", lambda x: x["y"]), lambda y: y.isNotNull())
    d = d.withColumns({"_y": known, "_n": F.size(known)})
    # Scale of the fold: moments about the first value, so that equal values have spread 0.
    first = F.try_element_at("_y", F.lit(1))
    off = F.transform("_y", lambda y: y - first)
    shift = F.aggregate(off, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.col("_n"), F.lit(0))
    d = d.withColumns({"_off": off, "_shift": shift})
    var = F.aggregate(F.transform("_off", lambda x: (x - F.col("_shift")) * (x - F.col("_shift"))), F.lit(0.0), lambda a, x: a + x)
    d = d.withColumns({"_mu": first + F.col("_shift"), "_sd": F.sqrt(var / F.nullif(F.col("_n"), F.lit(0)))})
    d = d.withColumn("_sigma", F.when(F.col("_sd") > 0, F.col("_sd")).otherwise(1.0))

    # Windows whose rows all lie in the fold: targets from the (n + 1)th row on.
    last = F.col("_r0") + F.size("_t")
    low = F.col("_r0") + F.least(F.lit(n), F.size("_t"))

    def at(i: Column) -> Column:
        return F.when(i > 0, F.try_element_at("_r", i)["p"]).otherwise(F.array(*[F.lit(0.0)] * len(terms)))

    d = d.withColumn("_s", F.zip_with(at(last), at(low), lambda a, b: a - b))
    # z = g + q * a, a the series' own scale and z the fold's; equal values are all 0
    q = F.when(F.col("_sd") > 0, F.col("_u") / F.col("_sigma")).otherwise(0.0)
    g = F.when(F.col("_sd") > 0, (F.col("_k") - F.col("_mu")) / F.col("_sigma")).otherwise(0.0)
    d = d.withColumns({"_q": q, "_g": g})
    count = F.col("_s")[0]

    def one(i: int) -> Column:
        return F.col("_s")[1 + i]

    def two(t: int) -> Column:
        return F.col("_s")[2 + n + t]

    sums = [F.sum(count).alias("_cnt")] + [F.sum(count * F.col("_g") + F.col("_q") * one(i)).alias(f"_e{i}") for i in range(n + 1)]
    sums += [F.sum(count * F.col("_g") * F.col("_g") + F.col("_g") * F.col("_q") * (one(i) + one(j)) + F.col("_q") * F.col("_q") * two(t))
             .alias(f"_ee{i}_{j}") for t, (i, j) in enumerate(pairs)]
    m = d.groupBy("fold").agg(*sums).filter("_cnt > 0")

    def mean(i: int) -> Column:
        return F.col(f"_e{i}") / F.col("_cnt")

    def cov(i: int, j: int) -> Column:
        return F.col(f"_ee{i}_{j}") / F.col("_cnt") - mean(i) * mean(j)

    m = m.select("fold", F.round("_cnt").cast("long").alias("n"), mean(n).alias("_my"), F.greatest(cov(n, n), F.lit(0.0)).alias("_vy"),
                 *[mean(i).alias(f"_m{i}") for i in range(n)],
                 *[(F.greatest(cov(i, i), F.lit(0.0)) if i == j else cov(i, j)).alias(f"_c{i}_{j}") for i, j in pairs if i < n],
                 *[cov(n, i).alias(f"_s{i}") for i in range(n)])
    model = solve(m, n, reg, ("fold",)).select("fold", "intercept", "coefs")

    z = F.transform(F.slice("_y", F.greatest(F.col("_n") - n, F.lit(0)) + 1, n), lambda y: (y - F.col("_mu")) / F.col("_sigma"))
    seen = F.array_max(F.transform(F.filter("_t", lambda x: x["y"].isNotNull()), lambda x: x["_qi"]))
    future = F.filter("_r", lambda x: (x["_qi"] > F.col("_end")) & (x["_qi"] <= F.col("_end") + h) & x["y"].isNotNull())
    cells = d.select("fold", S.UID, "_n", "_mu", "_sd", "_sigma", "_end", (F.col("_end") - seen).alias("_gap"), z.alias("_z"),
                     F.transform(future, lambda x: F.struct(x["_qi"].alias("qi"), x["y"].alias("actual"))).alias("_cells")).filter(F.size("_cells") > 0)
    cells = cells.join(fixed_small(model), "fold", "left")
    cells = cells.withColumn("status", F.when(F.col("_n") < n, "too_short").when(F.col("coefs").isNull(), "no_model").otherwise("ok"))
    walk = F.when(F.col("status") == "ok", _recursive(F.col("_z"), F.col("intercept"), F.col("coefs"), F.col("_gap") + h))
    out = cells.withColumn("_out", walk).select("*", F.explode("_cells").alias("_c")).withColumn("step", F.col("_c.qi") - F.col("_end"))
    pred = F.try_element_at("_out", F.col("_gap") + F.col("step"))
    level = F.when(pred.isNotNull(), F.when(F.col("_sd") < 1e-6, F.col("_mu")).otherwise(pred * F.col("_sigma") + F.col("_mu")))
    return _dated(out.select("fold", S.UID, F.col("_c.qi").alias("qi"), F.col("step").cast("int").alias("step"), level.alias("forecast"),
                             F.col("_c.actual").alias("actual"), "status"))


def _scored(pdf: pd.DataFrame, folds: list[tuple[int, int, int]], h: int, value: str, fit) -> pd.DataFrame:
    """The rows of all folds of the block in ``pdf``; ``fit(rows, end)`` gives
    (unique_id, step, forecast, status) from one fold's training rows."""
    out = []
    for fold, a, b in folds:
        train = pdf[(pdf["_qi"] >= a) & (pdf["_qi"] <= b)]
        test = pdf[(pdf["_qi"] > b) & (pdf["_qi"] <= b + h)].dropna(subset=[value])
        if train.empty or test.empty:
            continue
        cells = pd.DataFrame({"fold": np.int32(fold), S.UID: test[S.UID].to_numpy(), "qi": test["_qi"].to_numpy(),
                              "step": (test["_qi"] - b).to_numpy(), "actual": test[value].to_numpy()})
        out.append(cells.merge(fit(train, b)[[S.UID, "step", "forecast", "status"]], on=[S.UID, "step"]))
    names = [c.split()[0] for c in RESULT.split(", ")]
    return pd.concat(out, ignore_index=True)[names] if out else pd.DataFrame({c: [] for c in names})


def _finite(out: DataFrame) -> DataFrame:
    return out.withColumn("forecast", F.when(~F.isnan("forecast"), F.col("forecast")))


def backtest_ar(panel: DataFrame, train_years: int = 3, test_years: int = 1, m: int = 4, max_p: int = 3, min_points: int = 12) -> DataFrame:
    """F4 of ``models.forecast_ar_per_series``: every fold of a series is fitted
    in the one call that holds the series."""
    folds = fold_bounds(panel, train_years, test_years)
    if not folds:
        return _empty(panel)
    h = 4 * test_years

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        present = pdf["_qi"].to_numpy()
        known = pdf.dropna(subset=[S.Y])
        qi, y = known["_qi"].to_numpy(), known[S.Y].to_numpy(dtype=float)
        out = []
        for fold, a, b in folds:
            mine, test = (qi >= a) & (qi <= b), (qi > b) & (qi <= b + h)
            if not test.any() or not ((present >= a) & (present <= b)).any():
                continue
            fc, _, status, _ = MD.ar_values(qi[mine], y[mine], b, h, m, max_p, min_points)
            out += [(fold, q, q - b, None if fc is None else fc[q - b - 1], x, status) for q, x in zip(qi[test], y[test], strict=True)]
        done = pd.DataFrame(out, columns=["fold", "qi", "step", "forecast", "actual", "status"]).astype({"forecast": float, "actual": float})
        done.insert(1, S.UID, pdf[S.UID].iloc[0])
        return done

    rows = panel.select(S.UID, quarter_index(S.DS).alias("_qi"), F.col(S.Y).cast("double").alias(S.Y))
    return _dated(_finite(map_series(rows, S.UID, ["_qi"], fit, RESULT)))


def backtest_blocks(panel: DataFrame, train_years: int = 3, test_years: int = 1, block_size: int = 8, lags: int = 4, ridge: float = 1.0) -> DataFrame:
    """F4 of ``models.forecast_blocks``, with the blocks of the whole panel in
    every fold; a call holds one block of at most ``block_size`` series."""
    folds = fold_bounds(panel, train_years, test_years)
    if not folds:
        return _empty(panel)
    h = 4 * test_years

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        return _scored(pdf, folds, h, "_y", lambda train, end: MD.var_rows(train, end, h, lags, ridge))

    rows = panel.join(MD.series_blocks(panel, block_size), S.UID).select(
        "block", S.UID, quarter_index(S.DS).alias("_qi"), F.col(S.Y).cast("double").alias("_y"))
    return _dated(_finite(rows.groupBy("block").applyInPandas(fit, RESULT)))
