"""Connected components of links, by distributed label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lorewell.llm.shared import cut, done


def components(links: DataFrame) -> DataFrame:
    """links: a, b -> id, label (the least id reachable), for every id that has a link. A written table a round."""
    edges = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = cut(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("label")))
    written = labels
    while True:
        near = edges.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "id").select("id", F.least("label", "near").alias("new"), "label")
        # pointer jump: the label's own label
        jumped = lower.join(labels.select(F.col("id").alias("new"), F.col("label").alias("jump")), "new", "left")
        rounds = cut(jumped.select("id", F.least("new", F.coalesce("jump", "new")).alias("label"), F.col("label").alias("was")))
        done(written)
        written, labels = rounds, rounds.select("id", "label")
        if rounds.where("label <> was").isEmpty():
            done(edges)
            return labels
