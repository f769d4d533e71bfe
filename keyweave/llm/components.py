"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyweave.llm.common import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """id, label: the least id in reach, for all ids of ``links`` (a, b; both long).

    Each round takes the least label of all neighbours, then the label of one's label, so that
    long chains shrink by halves; labels are written after each round.
    """
    both = links.select(F.col("a").alias("id"), F.col("b").alias("other")).filter("id <> other")
    both = cut_lineage(
        both.unionByName(both.select(F.col("other").alias("id"), F.col("id").alias("other"))).distinct()
    )
    # a node's first label is the least of its neighbours and itself
    labels = cut_lineage(
        both.groupBy("id").agg(F.min("other").alias("least")).select("id", F.least("id", "least").alias("label"))
    )
    while True:
        around = (
            both.join(labels.withColumnRenamed("id", "other"), "other").groupBy("id").agg(F.min("label").alias("near"))
        )
        lowered = labels.join(around, "id").select("id", "label", F.least("label", "near").alias("low"))
        above = labels.select(F.col("id").alias("low"), F.col("label").alias("jump"))
        updated = cut_lineage(
            lowered.join(above, "low").select("id", F.least("low", "jump").alias("label"), F.col("label").alias("old"))
        )
        labels = updated.select("id", "label")
        if updated.filter("label <> old").isEmpty():
            return labels
