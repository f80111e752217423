"""The labelled sample is bounded by rows and does not depend on partitions."""
from pyspark.sql import functions as F

from qpanel.llm import quality


def test_repeated_ids_do_not_grow_the_sample(spark):
    hot = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.lit(0).alias("y"))
    rest = spark.range(2, 102).select(F.col("id").alias("doc_id"), F.concat(F.lit("other "), "id").alias("text"), (F.col("id") % 2).cast("int").alias("y"))
    rows = hot.unionByName(rest)
    got = quality.sampled(rows, 30)
    assert [sum(y == k for y, _ in got) for k in (0, 1)] == [30, 30]
    assert len(quality.sampled(rows, 4000)) == 101
    again = quality.sampled(rows.repartition(7), 30)
    assert [(y, list(x)) for y, x in got] == [(y, list(x)) for y, x in again]
    assert quality.sampled(rows.limit(0), 30) == []
