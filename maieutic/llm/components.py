"""Connected components of a link table, in Spark jobs only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maieutic.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links`` ``(a, b)``; nodes of one component share their root.

    Each round moves every node to the least node around it, where nodes are
    compared by a hash (so a chain of ascending ids shrinks by a factor, not by
    one), follows that pointer twice, and contracts the links.  Only minima are
    gathered per node (combined before the shuffle), never a node's neighbours; nothing is collected.
    """
    rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
    links = written(links.where("a <> b").select("a", "b").distinct(), "links")
    labels = written(links.select(F.col("a").alias("node")).union(links.select("b")).distinct().withColumn("root", F.col("node")), "labels")
    while not links.isEmpty():
        around = links.union(links.select("b", "a"))
        least = around.groupBy(F.col("a").alias("v")).agg(F.min(rank("b")).alias("m"))
        step = least.select("v", F.least("m", rank("v"))["v"].alias("to"))
        step = written(step, "step")
        for _ in range(2):
            hop = step.select(F.col("v").alias("hop"), F.col("to").alias("further"))
            step = step.join(hop, F.col("to") == F.col("hop"), "left").select("v", F.coalesce("further", "to").alias("to"))
        step = written(step, "step")
        moved = labels.join(step, F.col("root") == F.col("v"), "left")
        labels = written(moved.select("node", F.coalesce("to", "root").alias("root")), "labels")
        a, b = (step.select(F.col("v").alias(f"v{x}"), F.col("to").alias(f"to{x}")) for x in "ab")
        contracted = links.join(a, F.col("a") == F.col("va")).join(b, F.col("b") == F.col("vb"))
        contracted = contracted.select(F.col("toa").alias("a"), F.col("tob").alias("b")).where("a <> b")
        links = written(contracted.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    return labels
