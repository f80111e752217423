"""Connected components of a link table, as Spark joins."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qpanel.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """(node, root): the least node of each component; ``links`` is (a, b).

    Each round takes the least label among a node and its neighbours, then the
    label's own label (pointer jumping), so the rounds grow with the logarithm
    of a component's diameter.  Labels are written to the shared folder after
    each round; least labels are combined before the shuffle, so a node with
    many neighbours is no hot task.
    """
    both = written(links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct(), "links")
    labels = written(both.select(F.col("a").alias("node")).distinct().withColumn("root", F.col("node")), "labels")
    while True:
        near = (both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node"))
                .agg(F.min("root").alias("least")))
        step = labels.join(near, "node").select("node", "root", F.least("root", "least").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("root").alias("far"))
        new = written(step.join(jump, "next").select("node", F.least("next", "far").alias("new"), "root"), "labels")
        changed = new.filter("new <> root").limit(1).count()
        labels = new.select("node", F.col("new").alias("root"))
        if not changed:
            return labels
