"""The append sink: retries, half-written runs, columns, odd ids."""
import pytest
from pyspark.sql import functions as F

from qpanel.session import scratch_dir
from qpanel.sources import files as FS
from qpanel.sources import runs as RU


def frame(spark, n, start=0):
    return spark.range(start, start + n).select(F.col("id").alias("k"), (F.col("id") * 2.0).alias("v"))


def rows(spark, path):
    return sorted((r.run_id, r.k) for r in RU.read_runs(spark, path).collect())


def test_a_retry_is_written_once(spark):
    path = scratch_dir(spark, "runs-test")
    assert RU.append_run(frame(spark, 3), path, "007")
    assert not RU.append_run(frame(spark, 3), path, "007")
    assert RU.append_run(frame(spark, 2, 10).select("v", "k"), path, "a/b é=1")
    assert rows(spark, path) == [("007", 0), ("007", 1), ("007", 2), ("a/b é=1", 10), ("a/b é=1", 11)]
    assert sorted((r.run_id, r.rows) for r in RU.runs(spark, path).collect()) == [("007", 3), ("a/b é=1", 2)]


def test_a_half_written_run_is_invisible_and_replaced(spark):
    path = scratch_dir(spark, "runs-test")
    RU.append_run(frame(spark, 1), path, "one")
    frame(spark, 50).write.parquet(RU._run_folder(path, "two"))
    assert rows(spark, path) == [("one", 0)]
    assert RU.append_run(frame(spark, 2), path, "two")
    assert rows(spark, path) == [("one", 0), ("two", 0), ("two", 1)]


def test_a_doubled_manifest_row_counts_once(spark):
    path = scratch_dir(spark, "runs-test")
    RU.append_run(frame(spark, 2), path, "one")
    RU.runs(spark, path).coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    assert RU.runs(spark, path).count() == 1 and rows(spark, path) == [("one", 0), ("one", 1)]


def test_empty_runs_and_tables(spark):
    path = scratch_dir(spark, "runs-test")
    assert RU.runs(spark, path).collect() == []
    with pytest.raises(ValueError):
        RU.read_runs(spark, path)
    assert RU.append_run(frame(spark, 0), path, "none")
    assert not RU.append_run(frame(spark, 0), path, "none")
    assert rows(spark, path) == []
    RU.append_run(frame(spark, 1), path, "one")
    assert rows(spark, path) == [("one", 0)]


def test_columns_are_fixed_by_the_first_run(spark):
    path = scratch_dir(spark, "runs-test")
    RU.append_run(frame(spark, 1), path, "one")
    for bad in (frame(spark, 1).withColumn("x", F.lit(1)), frame(spark, 1).select("k"), frame(spark, 1).select("k", F.lit("t").alias("v"))):
        with pytest.raises(ValueError):
            RU.append_run(bad, path, "two")
    with pytest.raises(ValueError):
        RU.append_run(frame(spark, 1).withColumn("run_id", F.lit(1)), path, "two")
    with pytest.raises(ValueError):
        RU.append_run(frame(spark, 1), path, "")
    assert rows(spark, path) == [("one", 0)]


def test_no_files_to_check(spark):
    assert FS.check_files(spark, {}).collect() == []
