"""Statistical forecasters and rolling back-tests.

All forecasters work on a long panel (unique_id, ds, y) with a *cutoff*
(the last training quarter end).  ``cutoff`` may be a literal date string
or a Column, so the same code serves a single split and all back-test
folds at once (the fold id is just another group column).

Each forecaster is one hash exchange on the series key, one sort, one
window pass and a row-local generator that emits the horizon rows; no
join is needed to build forecasts.  Seasonality and horizon come from
dates (quarter arithmetic), never from row positions, so gaps in a series
do not shift the season.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qpanel import schema as S
from qpanel.functions.dates import quarter_index
from qpanel.plans.joins import fixed_small

# Fixed value: two-sided 90 % normal quantile used for the intervals.
Z90 = 1.6448536269514722


def _date(c) -> Column:
    if isinstance(c, Column):
        return c
    return F.to_date(F.lit(c))


def _qdiff(later: Column, earlier: Column) -> Column:
    """Whole quarters from ``earlier`` to ``later``."""
    return quarter_index(later) - quarter_index(earlier)


def _series_window(group: list[str]):
    return Window.partitionBy(*group, S.UID)


def _lagged_rms(train: DataFrame, group: list[str], lag_q: int) -> DataFrame:
    """Adds ``sigma``: RMS of the lag-``lag_q`` differences of each series
    (date-exact lag through a RANGE frame on the quarter index)."""
    w = _series_window(group)
    wq = w.orderBy("_qi").rangeBetween(-lag_q, -lag_q)
    d = F.col(S.Y) - F.first(S.Y).over(wq)
    return (train.withColumn("_qi", quarter_index(S.DS))
            .withColumn("_d2", F.pow(d, 2))
            .withColumn("sigma", F.sqrt(F.avg("_d2").over(w)))
            .drop("_d2"))


def _emit(df: DataFrame, base: Column, cutoff: Column, h: int, m: int,
          value: Column) -> DataFrame:
    """Row-local horizon generator: ``base`` is a quarter end in the last
    season before ``cutoff``; it forecasts base + 12*j months, j >= 1."""
    reps = max(1, math.ceil(h / m))
    out = (df.withColumn("_j", F.explode(F.sequence(F.lit(1), F.lit(reps))))
           .withColumn(S.DS, F.last_day(F.add_months(base, F.col("_j") * (3 * m))))
           .withColumn("step", _qdiff(F.col(S.DS), cutoff))
           .filter((F.col("step") >= 1) & (F.col("step") <= h))
           .withColumn("forecast", value))
    return out


def naive(train: DataFrame, cutoff, h: int, group: list[str] = (),
          level: bool = True) -> DataFrame:
    """last observed value repeated h quarters; 90 % interval from the
    RMS of first differences, widening with sqrt(step)."""
    group = list(group)
    c = _date(cutoff)
    w = _series_window(group)
    df = _lagged_rms(train.filter(F.col(S.DS) <= c), group, 1)
    last = (df.withColumn("_last", F.max(S.DS).over(w))
            .filter(F.col(S.DS) == F.col("_last")))
    out = (last.withColumn("_s", F.explode(F.sequence(F.lit(1), F.lit(h))))
           .withColumn(S.DS, F.last_day(F.add_months(c, F.col("_s") * 3)))
           .withColumn("step", F.col("_s"))
           .withColumn("forecast", F.col(S.Y)))
    cols = [*group, S.UID, S.DS, "step", "forecast"]
    if level:
        spread = F.lit(Z90) * F.col("sigma") * F.sqrt(F.col("step"))
        out = out.withColumn("lo_90", F.col("forecast") - spread) \
                 .withColumn("hi_90", F.col("forecast") + spread)
        cols += ["lo_90", "hi_90"]
    return out.select(*cols)


def seasonal_naive(train: DataFrame, cutoff, h: int, m: int = 4,
                   group: list[str] = (), level: bool = True) -> DataFrame:
    """value of the same quarter in the last season before ``cutoff``;
    90 % interval from the RMS of lag-m differences, widening with
    sqrt(floor((step-1)/m)+1)."""
    group = list(group)
    c = _date(cutoff)
    df = train.filter(F.col(S.DS) <= c)
    if level:
        df = _lagged_rms(df, group, m)
    last_season = df.filter(F.col(S.DS) > F.last_day(F.add_months(c, -3 * m)))
    out = _emit(last_season, F.col(S.DS), c, h, m, F.col(S.Y))
    cols = [*group, S.UID, S.DS, "step", "forecast"]
    if level:
        k = F.floor((F.col("step") - 1) / m) + 1
        spread = F.lit(Z90) * F.col("sigma") * F.sqrt(k)
        out = out.withColumn("lo_90", F.col("forecast") - spread) \
                 .withColumn("hi_90", F.col("forecast") + spread)
        cols += ["lo_90", "hi_90"]
    return out.select(*cols)


def seasonal_window_average(train: DataFrame, cutoff, h: int, m: int = 4,
                            window: int = 3, group: list[str] = ()) -> DataFrame:
    """mean of the last ``window`` values of the same quarter before the
    cutoff.  A series needs at least m*window training points, as the
    reference's model does; shorter series get no forecast.  A Column
    cutoff must also be listed in ``group`` (it is constant per group)."""
    group = list(group)
    c = _date(cutoff)
    w = _series_window(group)
    df = (train.filter(F.col(S.DS) <= c)
          .withColumn("_n", F.count(S.Y).over(w))
          .filter(F.col("_n") >= m * window)
          .filter(F.col(S.DS) > F.last_day(F.add_months(c, -3 * m * window))))
    # how many quarters each row's season lies back from the cutoff: 0..m-1
    off = F.pmod(_qdiff(c, F.col(S.DS)), F.lit(m))
    seasons = (df.withColumn("_off", off)
               .groupBy(*group, S.UID, "_off").agg(F.avg(S.Y).alias("_avg")))
    base = F.last_day(F.add_months(c, -3 * F.col("_off")))
    out = _emit(seasons, base, c, h, m, F.col("_avg"))
    return out.select(*group, S.UID, S.DS, "step", "forecast")


def join_actuals(forecasts: DataFrame, actuals: DataFrame,
                 keys: list[str] = (S.UID, S.DS)) -> DataFrame:
    """Left join forecasts to actual values, then drop missing actuals
    (Catalyst turns the pair into an inner join)."""
    keys = list(keys)
    a = actuals.select(*keys, F.col(S.Y).alias("actual"))
    return forecasts.join(a, keys, "left").dropna(subset=["actual"])


def assign_horizon(preds: DataFrame, cutoff, by: list[str] = ("model",),
                   mode: str = "quarters") -> DataFrame:
    """Keep rows after the cutoff and number the forecast step.

    ``mode='quarters'``: step = quarters between ds and the cutoff (gaps
    keep their distance); ``mode='rank'``: row_number over (by, series)
    ordered by ds (the reference's counting, per model and series).
    """
    c = _date(cutoff)
    p = preds.filter(F.col(S.DS) > c)
    if mode == "quarters":
        return p.withColumn("horizon", _qdiff(F.col(S.DS), c))
    w = Window.partitionBy(*by, S.UID).orderBy(S.DS)
    return p.withColumn("horizon", F.row_number().over(w))


# ---------------------------------------------------------------------------
# Rolling back-test (F4, J8): all folds in one job.

def fold_calendar(panel: DataFrame, train_years: int, test_years: int) -> DataFrame:
    """(fold, ds, role, cutoff) for every quarter of every fold.

    Folds start at the first quarter and slide by ``test_years`` while
    start + train + test <= last quarter (half-open windows).  Built by
    generators from a one-row bounds aggregate; its size is bounded by the
    calendar (folds x quarters per fold), so it is broadcast.
    """
    tw, vw = 12 * train_years, 12 * test_years
    b = panel.agg(F.min(S.DS).alias("_d0"), F.max(S.DS).alias("_d1"))
    span = F.months_between(F.col("_d1"), F.col("_d0")).cast("int")
    nf = F.floor((span - F.lit(tw + vw)) / F.lit(vw)) + 1
    folds = (b.filter(span >= tw + vw)
             .select("_d0", F.explode(F.sequence(F.lit(0), (nf - 1).cast("int"))).alias("fold"))
             .withColumn("_start", F.add_months("_d0", F.col("fold") * vw)))
    nq = (tw + vw) // 3
    cal = (folds.select("fold", "_start",
                        F.posexplode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("_p", "_i"))
           .withColumn(S.DS, F.last_day(F.add_months("_start", F.col("_i") * 3)))
           .withColumn("role", F.when(F.col("_i") < tw // 3, "train").otherwise("valid"))
           .withColumn("cutoff", F.last_day(F.add_months("_start", tw - 3)))
           .select("fold", S.DS, "role", "cutoff"))
    return cal


def backtest(panel: DataFrame, model: str, train_years: int = 3,
             test_years: int = 1, m: int = 4, window: int = 3) -> DataFrame:
    """rolling-origin evaluation of a statistical model over all folds
    in one job.

    Returns (fold, unique_id, ds, step, forecast, actual).  The fold
    calendar is joined by equality on ds (a broadcast hash join; J8's range
    join made equi), which replicates each cell into the folds that use it;
    then one in-place scoring pass partitioned by (fold, series).
    """
    cal = fixed_small(fold_calendar(panel, train_years, test_years))
    rows = (panel.select(S.UID, S.DS, S.Y).join(cal, S.DS)
            .withColumn("_is_train", F.col("role") == "train"))
    h = (12 * test_years) // 3
    out = score_in_place(rows, model, F.col("cutoff"), h, m=m, window=window,
                         group=["fold"], train_flag="_is_train")
    return out.select("fold", S.UID, S.DS, "step", "forecast", "actual")


# ---------------------------------------------------------------------------
# In-place scoring: forecasts for the rows that have actuals, from one
# window pass over the whole panel (no train/test branches, no join).

def score_in_place(panel: DataFrame, model: str, cutoff, h: int,
                   m: int = 4, window: int = 3, group: list[str] = (),
                   train_flag: str | None = None) -> DataFrame:
    """Forecast every cell in (cutoff, cutoff + h quarters] from data at or
    before the cutoff and pair it with its actual value.

    Result: (*group, unique_id, ds, step, forecast, actual).  Same numbers
    as ``model(train) |> join_actuals(test)`` but the panel is read once:
    the look-backs are RANGE frames on the quarter index, so a forecast can
    only see quarters at or before the cutoff.  ``train_flag`` (a boolean
    column) further restricts which rows count as training data, as the
    back-test folds need.
    """
    group = list(group)
    c = _date(cutoff)
    w = Window.partitionBy(*group, S.UID).orderBy("_qi")
    df = (panel.withColumn("_qi", quarter_index(S.DS))
          .withColumn("step", F.col("_qi") - quarter_index(c)))
    is_train = F.col("step") <= 0
    if train_flag is not None:
        is_train = is_train & F.col(train_flag)
    ty = F.when(is_train, F.col(S.Y))
    k = F.ceil(F.col("step") / m)

    def back(q: int) -> Column:
        return F.first(ty).over(w.rangeBetween(-q, -q))

    reps = max(1, math.ceil(h / m))
    if model == "naive":
        fcol = F.last(ty, ignorenulls=True).over(
            w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    elif model == "seasonal_naive":
        fcol = None
        for j in range(1, reps + 1):
            v = back(m * j)
            fcol = F.when(k == j, v) if fcol is None else fcol.when(k == j, v)
    elif model == "seasonal_window_average":
        n_train = F.count(ty).over(Window.partitionBy(*group, S.UID))
        fcol = None
        for j in range(1, reps + 1):
            vals = [back(m * (j + i)) for i in range(window)]
            tot = sum((F.coalesce(v, F.lit(0.0)) for v in vals[1:]),
                      F.coalesce(vals[0], F.lit(0.0)))
            cnt = sum((v.isNotNull().cast("int") for v in vals[1:]),
                      vals[0].isNotNull().cast("int"))
            v = F.when(cnt > 0, tot / cnt)
            fcol = F.when(k == j, v) if fcol is None else fcol.when(k == j, v)
        fcol = F.when(n_train >= m * window, fcol)
    else:
        raise ValueError(f"unknown model {model!r}")
    out = (df.withColumn("forecast", fcol)
           .filter((F.col("step") >= 1) & (F.col("step") <= h)
                   & F.col(S.Y).isNotNull() & F.col("forecast").isNotNull()))
    return out.select(*group, S.UID, S.DS, "step", "forecast",
                      F.col(S.Y).alias("actual"))


def conformal_intervals(panel: DataFrame, model: str, cutoff: str, h: int,
                        n_windows: int = 2, level: float = 0.9, m: int = 4,
                        window: int = 3) -> DataFrame:
    """F3 intervals (ours, H9): split-conformal half-widths per (series,
    step) from ``n_windows`` back-test windows that end at the cutoff.

    Window k forecasts the h quarters after cutoff - k*h quarters; the
    half-width of step j is the ``level`` quantile (linear interpolation)
    of the absolute errors of step j over the windows.  Rows are
    replicated per window with a generator (no join); each (series, step)
    group holds at most ``n_windows`` errors.
    """
    c = _date(cutoff)
    rows = (panel.select(S.UID, S.DS, S.Y)
            .withColumn("win", F.explode(F.sequence(F.lit(1), F.lit(n_windows))))
            .withColumn("_cut", F.last_day(F.add_months(c, -3 * h * F.col("win")))))
    s = score_in_place(rows, model, F.col("_cut"), h, m=m, window=window, group=["win"])
    return (s.groupBy(S.UID, "step")
            .agg(F.percentile(F.abs(F.col("forecast") - F.col("actual")), level).alias("half_width"),
                 F.count(F.lit(1)).alias("n_windows")))


def with_intervals(forecasts: DataFrame, widths: DataFrame, level: int = 90) -> DataFrame:
    """Attach ``lo_<level>`` / ``hi_<level>`` from per-(series, step) widths."""
    j = forecasts.join(widths.select(S.UID, "step", "half_width"), [S.UID, "step"], "left")
    return (j.withColumn(f"lo_{level}", F.col("forecast") - F.col("half_width"))
            .withColumn(f"hi_{level}", F.col("forecast") + F.col("half_width"))
            .drop("half_width"))
