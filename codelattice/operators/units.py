"""Claims: which unit is in charge of an input that several share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def claims(candidates: DataFrame) -> DataFrame:
    """candidates(unit, input) -> (input, unit): each input goes to the candidate with the fewest claims so far, the smaller name on ties.

    The choice for an input depends on all choices before it, so inputs that share units are decided one after another
    in their order. Inputs of different connected groups of units don't meet: a group is the unit of work here, found by
    repeated minima over shared inputs, and groups are decided in parallel. A task streams its pairs in order, which Spark
    sorts (beyond memory on disk), and holds one number for each unit.
    """
    pairs = candidates.select("unit", "input").where("unit is not null and input is not null").distinct()
    group = pairs.select("unit").distinct().withColumn("group", F.col("unit"))
    while True:
        by_input = pairs.join(group, "unit").groupBy("input").agg(F.min("group").alias("group"))
        new = pairs.join(by_input, "input").groupBy("unit").agg(F.min("group").alias("group"))
        new = new.checkpoint() if new.sparkSession.sparkContext.getCheckpointDir() else new
        changed = new.join(group.withColumnRenamed("group", "was"), "unit").where("group <> was").limit(1).count()
        group = new
        if not changed:
            break

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict = {}  # claims of each unit so far; a unit is in one group, so all groups of a task count side by side
        asked = best = least = None
        for b in batches:
            inputs, chosen = [], []
            for i, u in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                c = n.get(u, 0)
                if i != asked or best is None:
                    if best is not None:
                        n[best] = least + 1
                        inputs.append(asked)
                        chosen.append(best)
                        if best == u:
                            c = least + 1
                    asked, best, least = i, u, c
                elif c < least:  # units of an input come in order, so the smaller name stands on ties
                    best, least = u, c
            yield pa.RecordBatch.from_arrays([pa.array(inputs, b.schema.field(0).type), pa.array(chosen, b.schema.field(1).type)], ["input", "unit"])
            kept = b.schema
        if best is not None:
            yield pa.RecordBatch.from_arrays([pa.array([asked], kept.field(0).type), pa.array([best], kept.field(1).type)], ["input", "unit"])

    kinds = dict(pairs.dtypes)
    dealt = pairs.join(group, "unit").repartition("group").select("input", "unit").sortWithinPartitions("input", "unit")
    return dealt.mapInArrow(decide, f"input {kinds['input']}, unit {kinds['unit']}")
