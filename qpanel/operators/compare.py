"""Model comparison tables (G1-G12, A18-A20, C5-C7, C13, U1) and the
runtime-file collector (G10, S12, S13).

Everything is a DataFrame transformation; the reference's charts are not
drawn, only the tables behind them are built.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from qpanel import schema as S

# ---------------------------------------------------------------------------
# Model -> category rules and the short labels of the
# 500-epoch variant trade-off table.
CATEGORY_EXACT = {
    "arima": "ARIMA",
    "lightgbm": "LightGBM_Global",
    "lightgbm_iterative": "LightGBM_Iterative",
    "naive": "Naïve",
    "seasonal_naive": "Seasonal_Naive",
    "seasonal_window_average": "Seasonal_Window_Avg",
}
CATEGORY_PREFIX = {
    "lstm1_": "LSTM_Series1",
    "lstm2_": "LSTM_Series2",
    "vector_lstm_": "LSTM_Vectorized",
}
HYBRID_PATTERN = r"lstm_blocks_(\d+)feat"
VARIANT_LABELS = {
    "lstm1_500epochs": "L1",
    "lstm2_500epochs": "L2",
    "vector_lstm_500epochs": "LV",
    "lstm_blocks_4feat_500ep": "L4",
}
# ---------------------------------------------------------------------------


def model_category(model: str = "model") -> Column:
    """Category of a model name by the fixed rule list."""
    m = F.col(model)
    expr = None
    for name, cat in CATEGORY_EXACT.items():
        expr = F.when(m == name, cat) if expr is None else expr.when(m == name, cat)
    for pre, cat in CATEGORY_PREFIX.items():
        expr = expr.when(m.startswith(pre), cat)
    expr = expr.when(m.rlike("^" + HYBRID_PATTERN),
                     F.concat(F.lit("LSTM_Hybrid_"), F.regexp_extract(m, "^" + HYBRID_PATTERN, 1),
                              F.lit("feat")))
    return expr.otherwise("Other")


def stack_predictions(preds: dict[str, DataFrame]) -> DataFrame:
    """One frame with a ``model`` column (columns matched by name)."""
    tagged = [df.withColumn("model", F.lit(name)) for name, df in preds.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def test_cutoff(actuals: DataFrame, ds: str = S.DS):
    """First test date (one scalar aggregate)."""
    return actuals.agg(F.min(ds)).first()[0]


def model_summary(metrics: DataFrame, digits: int | None = None) -> DataFrame:
    """Mean of each metric over horizons, with category."""
    def r(c):
        return F.round(c, digits) if digits is not None else c
    return (metrics.groupBy("model").agg(
        r(F.avg("rmse")).alias("rmse_mean"), r(F.avg("smape")).alias("smape_mean"),
        r(F.avg("wmape")).alias("wmape_mean"), r(F.avg("log_rmse")).alias("log_rmse_mean"))
        .withColumn("category", model_category("model")))


def best_per_category(summary: DataFrame,
                      metrics=("rmse_mean", "smape_mean", "wmape_mean", "log_rmse_mean")) -> DataFrame:
    """The model with the smallest value per category and metric
    (ties broken by model name); one row per (metric, category)."""
    long = summary.unpivot(["model", "category"], list(metrics), "metric", "value")
    return (long.groupBy("metric", "category")
            .agg(F.min_by(F.struct("value", "model"), F.struct("value", "model")).alias("b"))
            .select("metric", "category", F.col("b.model").alias("model"),
                    F.col("b.value").alias("value")))


def metric_by_horizon(metrics: DataFrame, metric: str, models: list[str],
                      step: str = "horizon") -> DataFrame:
    """Horizon x model table of one metric (fixed model list)."""
    return metrics.groupBy(step).pivot("model", list(models)).agg(F.avg(metric))


def accuracy_vs_runtime(metrics: DataFrame, runtimes: DataFrame, metric: str = "rmse",
                        max_horizon: int = 4) -> DataFrame:
    """Mean metric over the first horizons vs total runtime."""
    met = (metrics.filter(F.col("horizon") <= max_horizon).groupBy("model")
           .agg(F.avg(metric).alias(f"mean_{metric}")))
    rt = runtimes.groupBy("model").agg(F.sum("total_time_s").alias("total_time_s"))
    return met.join(rt, "model", "inner")


def _blocks_epochs(stage: str = "stage"):
    pat = r"blocks=(\d+),epochs=(\d+)"
    return (F.regexp_extract(stage, pat, 1).cast("int"),
            F.regexp_extract(stage, pat, 2).cast("int"))


def training_time_by_block(runtimes: DataFrame, blocks=None) -> DataFrame:
    """Epochs x block size, summed training time."""
    b, e = _blocks_epochs()
    df = runtimes.filter(F.col("stage").contains("blocks=")).select(
        b.alias("block"), e.alias("epoch"), "total_time_s")
    g = df.groupBy("epoch")
    g = g.pivot("block", list(blocks)) if blocks else g.pivot("block")
    return g.agg(F.sum("total_time_s"))


def runtime_by_epoch(runtimes: DataFrame, models=None) -> DataFrame:
    """Epochs x model, summed training time (numeric coercion P24)."""
    df = (runtimes.filter(F.col("stage").rlike("epochs="))
          .withColumn("t", F.expr("try_cast(total_time_s AS DOUBLE)"))
          .filter(F.col("t").isNotNull())
          .withColumn("epochs", F.regexp_extract("stage", r"epochs=(\d+)", 1).cast("int")))
    g = df.groupBy("epochs")
    g = g.pivot("model", list(models)) if models else g.pivot("model")
    return g.agg(F.sum("t"))


def epoch_variant_accuracy(metrics: DataFrame, metric: str = "wmape", models=None) -> DataFrame:
    """Horizon x epoch-variant model (names ending in _<n>epochs)."""
    df = metrics.filter(F.col("model").rlike(r"_\d+epochs$") & F.col(metric).isNotNull())
    g = df.groupBy("horizon")
    g = g.pivot("model", list(models)) if models else g.pivot("model")
    return g.agg(F.first(metric))


def pairwise_model_comparison(metrics: DataFrame, runtimes: DataFrame,
                              models=("lightgbm", "lightgbm_iterative"),
                              cols=("rmse", "smape", "wmape")) -> DataFrame:
    """Mean metrics and total runtime of two models side by side."""
    met = metrics.groupBy("model").agg(*[F.avg(c).alias(c) for c in cols])
    rt = (runtimes.withColumn("t", F.expr("try_cast(total_time_s AS DOUBLE)"))
          .groupBy("model").agg(F.sum("t").alias("total_time_s")))
    return met.join(rt, "model").filter(F.col("model").isin(list(models)))


def variant_tradeoff(metrics: DataFrame, runtimes: DataFrame, metric: str = "wmape",
                     labels: dict | None = None) -> DataFrame:
    """Mean metric vs runtime for the labelled variants."""
    labels = labels or VARIANT_LABELS
    lab = F.create_map(*[x for kv in labels.items() for x in map(F.lit, kv)])
    met = metrics.groupBy("model").agg(F.avg(metric).alias(metric))
    rt = runtimes.groupBy("model").agg(F.sum("total_time_s").alias("total_time_s"))
    return (met.join(rt, "model").filter(F.col("model").isin(list(labels)))
            .withColumn("label", lab[F.col("model")]))


def block_epoch_grid(metrics: DataFrame, metric: str, block_sizes=(4, 8, 20, 40),
                     epochs=(100, 200, 500), pattern: str = r"lstm_blocks_(\d+)feat_(\d+)ep") -> DataFrame:
    """Epochs x block size grid of the mean metric, reindexed on a
    fixed axis (missing cells NULL)."""
    df = (metrics.filter(F.col("model").rlike(pattern))
          .select(F.regexp_extract("model", pattern, 1).cast("int").alias("block"),
                  F.regexp_extract("model", pattern, 2).cast("int").alias("epoch"), metric))
    grid = df.groupBy("epoch").pivot("block", list(block_sizes)).agg(F.avg(metric))
    axis = metrics.sparkSession.createDataFrame([(int(e),) for e in epochs], "epoch int")
    return axis.join(grid, "epoch", "left")


def block_epoch_grid_all(metrics: DataFrame, cols=("rmse", "smape", "wmape", "log_rmse"),
                         pattern: str = r"lstm_blocks_(\d+)feat_(\d+)ep") -> DataFrame:
    """G8 for all metrics at once: (metric, block, epoch, mean)."""
    df = (metrics.filter(F.col("model").rlike(pattern))
          .select(F.regexp_extract("model", pattern, 1).cast("int").alias("block"),
                  F.regexp_extract("model", pattern, 2).cast("int").alias("epoch"), *cols))
    long = df.unpivot(["block", "epoch"], list(cols), "metric", "value")
    return long.groupBy("metric", "block", "epoch").agg(F.avg("value").alias("mean"))


# ---------------------------------------------------------------------------
# Runtime files -> one schema.

def _path_model(path: Column, stem: Column) -> Column:
    """Model name from the file's folders and name."""
    parts = F.split(F.lower(path), "/")
    has = lambda p: F.array_contains(parts, p)
    return (F.when(has("lightgbm_iterative"), "lightgbm_iterative")
            .when(has("lightgbm"), "lightgbm")
            .when(has("arima"), "arima")
            .when(stem.contains("naive_runtime"), "naive")
            .when(stem.contains("seasonalnaive"), "seasonal_naive")
            .when(stem.contains("seasonalwa"), "seasonal_window_average")
            .when(stem.contains("lstm_blocks"), "lstm_blocks")
            .when(stem.contains("vector_lstm"), "vector_lstm")
            .when(stem.startswith("lstm1_") | stem.startswith("lstm2_"),
                  F.split(stem, "_")[0]))


def _csv_cells(line: Column) -> Column:
    """The trimmed cells of a CSV line; a comma between quotes belongs to its
    cell."""
    cells = F.split(line, r',(?=(?:[^"]*"[^"]*")*[^"]*$)')
    return F.transform(cells, lambda c: F.regexp_replace(F.regexp_replace(F.trim(c), '^"|"$', ""), '""', '"'))


def collect_runtimes(spark: SparkSession, root: str) -> DataFrame:
    """Every timing CSV under ``root`` in one (model, stage,
    total_time_s, avg_time_per_row_s, n_candidates) table.

    Files are found recursively (S12) and read whole, one row per file, so
    each file's own header names its columns; blank lines and repeated
    header lines are dropped (S13).  Layouts: (model, stage, total) rows;
    (block_size, epochs, total) rows; (epochs, total) rows; otherwise the
    first row of a one-row summary.  Block runs are labelled by their block
    size (Q23).
    """
    raw = (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv")
           .text(root, wholetext=True)
           .select(F.col("_metadata.file_path").alias("path"), "value"))
    return parse_runtimes(raw)


def parse_runtimes(raw: DataFrame) -> DataFrame:
    """The rows of timing files given as (path, value = the file's text)."""
    stem = F.lower(F.regexp_extract("path", r"([^/]+)\.csv$", 1))
    files = (raw.withColumn("stem", stem)
             .filter(F.col("stem").rlike("runtime|timing|summary"))
             .withColumn("path_model", _path_model(F.col("path"), F.col("stem")))
             .filter(F.col("path_model").isNotNull())
             .withColumn("lines", F.filter(F.split(F.regexp_replace("value", "\r", ""), "\n"),
                                           lambda s: F.trim(s) != ""))
             .withColumn("header", _csv_cells(F.col("lines")[0])))
    rows = (files.select("path", "stem", "path_model", "header",
                         F.posexplode(F.slice("lines", 2, 1 << 30)).alias("pos", "line"))
            .withColumn("row", _csv_cells(F.col("line")))
            .filter(F.col("row") != F.col("header"))
            .withColumn("cells", F.map_from_arrays(
                "header", F.slice(F.concat("row",
                                           F.array_repeat(F.lit(None).cast("string"), F.size("header"))),
                                  1, F.size("header")))))
    cell = lambda k: F.col("cells")[k]
    has = lambda k: F.array_contains("header", k)
    num = lambda k: F.expr(f"try_cast(cells['{k}'] AS DOUBLE)")
    layout = (F.when(has("model") & has("stage") & has("total_time_s"), "model_stage")
              .when(has("block_size") & has("epochs") & has("total_time_s"), "blocks")
              .when(has("epochs") & has("total_time_s"), "epochs")
              .when(has("total_time_s"), "single"))
    rows = rows.withColumn("layout", layout).filter(
        F.col("layout").isNotNull() & ((F.col("layout") != "single") | (F.col("pos") == 0)))
    blocks = F.format_string("blocks=%d,epochs=%d", num("block_size").cast("int"), num("epochs").cast("int"))
    model = (F.when(F.col("layout") == "model_stage", F.lower(cell("model")))
             .when(F.col("layout") == "blocks",
                   F.format_string("lstm_blocks_%dfeat", num("block_size").cast("int")))
             .otherwise(F.col("path_model")))
    stage = (F.when(F.col("layout") == "model_stage", cell("stage"))
             .when(F.col("layout") == "blocks", blocks)
             .when(F.col("layout") == "epochs", F.format_string("epochs=%d", num("epochs").cast("int")))
             .otherwise(F.regexp_replace(F.regexp_replace("stem", "_timing_summary", ""), "_runtime", "")))
    return rows.select(model.alias("model"), stage.alias("stage"),
                       num("total_time_s").alias("total_time_s"),
                       num("avg_time_per_row_s").alias("avg_time_per_row_s"),
                       num("n_candidates").alias("n_candidates"))


def evaluate(preds: dict[str, DataFrame] | DataFrame, test_actuals: DataFrame | None = None,
             cutoff=None, horizon_mode: str = "rank") -> dict[str, DataFrame]:
    """The evaluation flow in one call: stack the models' standard
    prediction records (U1), keep rows after the cutoff (P14: the day
    before the first test date when ``test_actuals`` is given), number the
    horizon per model and series (W16), score per (model, horizon) (E11),
    summarise per model with its category (A18, C6) and pick the best model
    per category and metric (A20).  Returns the four tables by name."""
    import datetime as _dt

    from qpanel.operators.forecast import assign_horizon
    from qpanel.operators.metrics import compute_metrics
    stacked = stack_predictions(preds) if isinstance(preds, dict) else preds
    if cutoff is None:
        first = test_cutoff(test_actuals)
        cutoff = str(first - _dt.timedelta(days=1))
    h = assign_horizon(stacked, cutoff, by=("model",), mode=horizon_mode)
    m = compute_metrics(h, by=("model", "horizon"))
    s = model_summary(m)
    return {"predictions": h, "metrics": m, "summary": s, "best": best_per_category(s)}
