"""Registered queries: the runtime collector and the tables over runtimes
(G2-G8, G10, J5, A19, R6, C5, C7, C10, C11, C13, S12, S13, T3).

Runtimes and metrics come from ``events``: an event's number picks model, stage
and horizon, its value is the time or the error.  The four file layouts are
written as CSV text with blank lines, repeated headers and a quoted comma.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from qpanel.functions.dates import seconds_to_hms
from qpanel.operators import compare as CP
from qpanel.plans.catalog import register
from qpanel.plans.output import round_doubles
from qpanel.session import scratch_dir
from qpanel.sources.files import write_table
from qpanel.sources.tables import read_table

BLOCKS, EPOCHS = (4, 8, 20), (100, 200, 500)
MODELS = ["lightgbm", "lightgbm_iterative", "naive", "lstm1_100epochs", "lstm1_500epochs", "lstm2_500epochs",
          "vector_lstm_500epochs", *(f"lstm_blocks_{b}feat_{e}ep" for b in BLOCKS for e in EPOCHS)]


def _events(spark, sf_dir):
    return read_table(spark, sf_dir, "events", ["event_id", "value"]).withColumn("v", F.round("value", 2))


def _runtimes(spark, sf_dir):
    """(model, stage, total_time_s as text) of every event; some are no number."""
    e = _events(spark, sf_dir)
    m = F.element_at(F.array(*map(F.lit, MODELS)), (F.col("event_id") % len(MODELS) + 1).cast("int"))
    k = F.floor(F.col("event_id") / len(MODELS))
    block = F.element_at(F.array(*map(F.lit, BLOCKS)), (k % 3 + 1).cast("int"))
    epoch = F.element_at(F.array(*map(F.lit, EPOCHS)), (F.floor(k / 3) % 3 + 1).cast("int"))
    stage = F.when(m.startswith("lstm_blocks"), F.format_string("blocks=%d,epochs=%d", block, epoch)) \
        .when(m.contains("lstm"), F.format_string("epochs=%d", epoch)).otherwise("predict")  # C11, C13
    return e.select(m.alias("model"), stage.alias("stage"), F.col("v").alias("total_time_s"))


_RUN = f"""WITH e AS (SELECT event_id, round(value, 2) AS v FROM events),
m AS (SELECT *, {MODELS!r}[CAST(event_id % {len(MODELS)} AS INTEGER) + 1] AS model, event_id // {len(MODELS)} AS k FROM e),
runtimes AS (SELECT *, CASE WHEN model LIKE 'lstm\\_blocks%' ESCAPE '\\' THEN 'blocks=' || [4, 8, 20][CAST(k % 3 AS INTEGER) + 1] || ',epochs=' || [100, 200, 500][CAST(k // 3 % 3 AS INTEGER) + 1]
                   WHEN model LIKE '%lstm%' THEN 'epochs=' || [100, 200, 500][CAST(k // 3 % 3 AS INTEGER) + 1] ELSE 'predict' END AS stage, v AS total_time_s FROM m),
metrics AS (SELECT model, CAST(k % 8 + 1 AS INTEGER) AS horizon, avg(v) AS rmse, avg(v) / 10 AS smape, avg(v) / 20 AS wmape, avg(v) / 30 AS log_rmse
            FROM m GROUP BY ALL)"""


def _metrics(spark, sf_dir):
    e = _events(spark, sf_dir)
    m = F.element_at(F.array(*map(F.lit, MODELS)), (F.col("event_id") % len(MODELS) + 1).cast("int"))
    return (e.groupBy(m.alias("model"), (F.floor(F.col("event_id") / len(MODELS)) % 8 + 1).cast("int").alias("horizon"))
            .agg(F.avg("v").alias("rmse"), (F.avg("v") / 10).alias("smape"), (F.avg("v") / 20).alias("wmape"), (F.avg("v") / 30).alias("log_rmse")))


def accuracy_vs_runtime(spark, sf_dir):
    """Mean error of the first horizons beside total time."""
    return round_doubles(CP.accuracy_vs_runtime(_metrics(spark, sf_dir), _runtimes(spark, sf_dir)), 4)


register("accuracy_vs_runtime", f"""{_RUN}
SELECT model, round(mean_rmse, 4) AS mean_rmse, round(total_time_s, 4) AS total_time_s
FROM (SELECT model, avg(rmse) AS mean_rmse FROM metrics WHERE horizon <= 4 GROUP BY model)
JOIN (SELECT model, sum(total_time_s) AS total_time_s FROM runtimes GROUP BY model) USING (model)""")(accuracy_vs_runtime)


def training_time_by_block(spark, sf_dir):
    """Epochs x block size, summed training time."""
    return round_doubles(CP.training_time_by_block(_runtimes(spark, sf_dir), BLOCKS), 4)


_STAGE = r"""CAST(regexp_extract(stage, 'epochs=(\d+)', 1) AS INTEGER)"""
register("training_time_by_block", f"""{_RUN},
b AS (SELECT CAST(regexp_extract(stage, 'blocks=(\\d+)', 1) AS INTEGER) AS block, {_STAGE} AS epoch, total_time_s FROM runtimes WHERE stage LIKE 'blocks=%')
SELECT epoch, {', '.join(f'round(sum(total_time_s) FILTER (WHERE block = {b}), 4) AS "{b}"' for b in BLOCKS)} FROM b GROUP BY epoch""")(training_time_by_block)

_SEQ = [m for m in MODELS if "lstm" in m]


def runtime_by_epoch(spark, sf_dir):
    """Epochs x model, summed training time."""
    return round_doubles(CP.runtime_by_epoch(_runtimes(spark, sf_dir), _SEQ), 4)


register("runtime_by_epoch", f"""{_RUN}
SELECT {_STAGE} AS epochs, {', '.join(f"round(sum(total_time_s) FILTER (WHERE model = '{m}'), 4) AS \"{m}\"" for m in _SEQ)}
FROM runtimes WHERE stage LIKE '%epochs=%' GROUP BY 1""")(runtime_by_epoch)

_VARIANTS = [m for m in MODELS if m.endswith("epochs")]


def epoch_variant_accuracy(spark, sf_dir):
    """Horizon x epoch variant."""
    return round_doubles(CP.epoch_variant_accuracy(_metrics(spark, sf_dir), models=_VARIANTS), 4)


register("epoch_variant_accuracy", f"""{_RUN}
SELECT horizon, {', '.join(f"round(max(wmape) FILTER (WHERE model = '{m}'), 4) AS \"{m}\"" for m in _VARIANTS)}
FROM metrics WHERE regexp_matches(model, '_\\d+epochs$') GROUP BY horizon""")(epoch_variant_accuracy)


def pairwise_comparison(spark, sf_dir):
    """Two models side by side."""
    return round_doubles(CP.pairwise_model_comparison(_metrics(spark, sf_dir), _runtimes(spark, sf_dir)), 4)


register("pairwise_comparison", f"""{_RUN}
SELECT model, round(a.rmse, 4) AS rmse, round(a.smape, 4) AS smape, round(a.wmape, 4) AS wmape, round(t, 4) AS total_time_s
FROM (SELECT model, avg(rmse) AS rmse, avg(smape) AS smape, avg(wmape) AS wmape FROM metrics GROUP BY model) a
JOIN (SELECT model, sum(total_time_s) AS t FROM runtimes GROUP BY model) USING (model)
WHERE model IN ('lightgbm', 'lightgbm_iterative')""")(pairwise_comparison)


def variant_tradeoff(spark, sf_dir):
    """Mean error and time of the labelled 500-epoch variants."""
    return round_doubles(CP.variant_tradeoff(_metrics(spark, sf_dir), _runtimes(spark, sf_dir)), 4)


register("variant_tradeoff", f"""{_RUN},
labels(model, label) AS (VALUES {', '.join(f"('{m}', '{x}')" for m, x in CP.VARIANT_LABELS.items())})
SELECT model, round(a.wmape, 4) AS wmape, round(t, 4) AS total_time_s, label
FROM (SELECT model, avg(wmape) AS wmape FROM metrics GROUP BY model) a
JOIN (SELECT model, sum(total_time_s) AS t FROM runtimes GROUP BY model) USING (model) JOIN labels USING (model)""")(variant_tradeoff)


def block_epoch_grid(spark, sf_dir):
    """Mean error on the fixed epochs x block sizes axis."""
    return round_doubles(CP.block_epoch_grid(_metrics(spark, sf_dir), "rmse"), 4)


register("block_epoch_grid", f"""{_RUN},
g AS (SELECT CAST(regexp_extract(model, 'feat_(\\d+)ep', 1) AS INTEGER) AS epoch, CAST(regexp_extract(model, 'blocks_(\\d+)feat', 1) AS INTEGER) AS block, rmse
      FROM metrics WHERE model LIKE 'lstm\\_blocks%' ESCAPE '\\')
SELECT epoch, {', '.join(f'round(avg(rmse) FILTER (WHERE block = {b}), 4) AS "{b}"' for b in (4, 8, 20, 40))}
FROM (VALUES (100), (200), (500)) a(epoch) LEFT JOIN g USING (epoch) GROUP BY epoch""")(block_epoch_grid)


def runtimes_sorted(spark, sf_dir):
    """Total time per model, longest first, as hours, minutes, seconds."""
    t = _runtimes(spark, sf_dir).groupBy("model").agg(F.sum("total_time_s").alias("s"))
    return t.orderBy(F.desc("s"), "model").select("model", F.round("s", 2).alias("s"), seconds_to_hms("s").alias("t")).select("model", "s", "t.*") \
        .toDF("model", "total_time_s", "h", "m", "sec")


register("runtimes_sorted", f"""{_RUN},
t AS (SELECT model, sum(total_time_s) AS s FROM runtimes GROUP BY model)
SELECT model, round(s, 2) AS total_time_s, CAST(floor(s) AS BIGINT) // 3600 AS h, CAST(floor(s) AS BIGINT) % 3600 // 60 AS m,
       CAST(floor(s) AS BIGINT) % 60 AS sec FROM t ORDER BY s DESC, model""")(runtimes_sorted)


# ---------------------------------------------------------------------------
# Timing files.

_FILES = {
    # file (folder / name): header, cells of a row by (event number k, value v)
    "lightgbm/runtimes/lightgbm_timing_summary": ("model,stage,total_time_s,n_candidates",
                                                  lambda k, v: (F.lit("LightGBM"), F.concat(F.lit('"tuning, round '), k, F.lit('"')), v, F.lit("50"))),
    "LSTM/runtimes/lstm_blocks_summary": ("block_size,epochs,total_time_s", lambda k, v: (F.lit("4"), F.concat(k, F.lit("00")), v)),
    "LSTM/runtimes/lstm1_epochs_summary": ("epochs,total_time_s,avg_time_per_row_s", lambda k, v: (F.concat(k, F.lit("0")), v, F.lit("0.5"))),
    "statistics/naive_runtime": ("total_time_s,avg_time_per_row_s", lambda k, v: (v, F.lit("0.25"))),
}


def runtimes_collected(spark, sf_dir):
    """The four layouts; each event type has its own folder
    of files, with a row for each weekday.  The files are written as one table
    of (path, text) and read back, as Spark chooses its own file names; the
    search below a folder (S12) is in the tests."""
    e = (read_table(spark, sf_dir, "events", ["event_type", "ts", "value"])
         .groupBy("event_type", F.dayofweek("ts").alias("k")).agg(F.max("value").alias("v")))
    k, v = F.col("k").cast("string"), F.format_string("%.2f", "v")
    texts = None
    for name, (header, cells) in _FILES.items():
        lines = e.select("event_type", F.concat_ws(",", *cells(k, v)).alias("line"))
        # seven rows at most, with blank lines and the header again between them
        one = lines.groupBy("event_type").agg(F.concat(F.lit(f"{header}\n"), F.array_join(
            F.sort_array(F.collect_list("line")), f"\n\n{header}\n")).alias("value"))
        one = one.select(F.concat(F.lit("runs/"), "event_type", F.lit(f"/{name}.csv")).alias("path"), "value")
        texts = one if texts is None else texts.union(one)
    path = scratch_dir(spark, "runtimes")
    write_table(texts, path)
    return CP.parse_runtimes(spark.read.parquet(path))


register("runtimes_collected", """WITH e AS (SELECT event_type, dayofweek(ts) + 1 AS k, round(max(value), 2) AS v FROM events GROUP BY ALL),
single AS (SELECT event_type, printf('%.2f', v) AS t, row_number() OVER (PARTITION BY event_type ORDER BY printf('%.2f', v) || ',0.25') AS i FROM e)
SELECT 'lightgbm' AS model, 'tuning, round ' || k AS stage, v AS total_time_s, CAST(NULL AS DOUBLE) AS avg_time_per_row_s, CAST(50 AS DOUBLE) AS n_candidates FROM e
UNION ALL SELECT 'lstm_blocks_4feat', 'blocks=4,epochs=' || k || '00', v, NULL, NULL FROM e
UNION ALL SELECT 'lstm1', 'epochs=' || k || '0', v, 0.5, NULL FROM e
UNION ALL SELECT 'naive', 'naive', CAST(t AS DOUBLE), 0.25, NULL FROM single WHERE i = 1""")(runtimes_collected)
