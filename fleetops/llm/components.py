"""Connected components of links, by alternating large-star and small-star steps.

Each step replaces links by links to smaller neighbours, so that in the end every node hangs on the least node of its
component. Links stay in Spark; the driver only learns whether a round changed anything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetops.llm.runtime import checkpointed


def star(links: DataFrame, large: bool) -> DataFrame:
    """One step over links (high, low) with high > low.

    The least neighbour is found with partial minima; it is then joined to the links, so a node with very many links
    is a join key and not a group.
    """
    if large:
        around = links.select(F.col("high").alias("node"), F.col("low").alias("other")).unionAll(
            links.select(F.col("low").alias("node"), F.col("high").alias("other"))
        )
    else:
        around = links.select(F.col("high").alias("node"), F.col("low").alias("other"))
    least = around.groupBy("node").agg(F.min("other").alias("near")).withColumn("near", F.least("near", "node"))
    moved = around.join(least.withColumnRenamed("node", "at"), F.col("node") == F.col("at"))
    if large:
        out = moved.filter(F.col("other") > F.col("node")).select(F.col("other").alias("high"), F.col("near").alias("low"))
    else:
        out = moved.select(F.col("other").alias("high"), F.col("near").alias("low")).unionAll(
            least.select(F.col("node").alias("high"), F.col("near").alias("low"))
        )
    return out.filter(F.col("high") > F.col("low")).distinct()


def components(links: DataFrame) -> DataFrame:
    """Rows (node, root) for every node of links (a, b); the root is the least node. Links of a node to itself and
    null ends say nothing. An empty table gives an empty one."""
    a, b = F.col("a"), F.col("b")
    current = checkpointed(
        links.filter(a != b).select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low")).distinct()
    )
    seen = None
    while True:
        summary = current.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("high", "low")).alias("x")).first()
        if not summary["n"] or tuple(summary) == seen:
            break
        seen = tuple(summary)
        current = checkpointed(star(star(current, large=True), large=False))
    leaves = current.select(F.col("high").alias("node"), F.col("low").alias("root"))
    return leaves.unionAll(current.select(F.col("low").alias("node"), F.col("low").alias("root")).distinct())
