"""Connected components by min-label propagation with pointer jumping, in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored


def components(links: DataFrame) -> DataFrame:
    """links(a, b) -> (id, component): every id that has a link, with the smallest id it reaches.

    Each round takes the smallest label among the neighbours and then the label of that label, so long chains
    need a logarithmic number of rounds. Labels stay in the shared folder; nothing but a count reaches the driver.
    """
    edges = stored(links.select("a", "b").union(links.select("b", "a")).toDF("id", "to").where("id <> to").distinct(), "edges")
    labels = stored(edges.groupBy("id").agg(F.least(F.col("id"), F.min("to")).alias("component")), "labels")
    while True:
        near = edges.join(labels.select(F.col("id").alias("to"), "component"), "to").groupBy("id").agg(F.min("component").alias("near"))
        step = labels.join(near, "id").select("id", F.least("component", "near").alias("to"), F.col("component").alias("was"))
        new = stored(step.join(labels.select(F.col("id").alias("to"), F.col("component").alias("far")), "to", "left").select("id", F.least("to", "far").alias("component"), "was"), "labels")
        changed = new.where("component <> was").limit(1).count()
        dropped(labels)
        labels = new
        if not changed:
            dropped(edges)
            return labels.select("id", "component")
