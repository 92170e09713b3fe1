"""Connected components of a graph whose edges are a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muxlake.llm.common import saved


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of edges(a, b); a label is the smallest node of the component.

    In each round a node joins its smallest neighbour, or that one's, and edges inside a merged group go, so rounds work on ever
    fewer edges. Rounds are written to the shared folder; hub nodes are pre-aggregated, and their joins are open to Spark's splitting.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = saved(both, "edges")
    labels = saved(both.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct(), "labels")
    while not both.isEmpty():
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("was"), F.least("a", "m").alias("now"))
        up = least.select(F.col("was").alias("now"), F.col("now").alias("up"))
        step = saved(least.join(up, "now").select("was", F.col("up").alias("now")), "steps")
        new = labels.join(step, labels.label == step.was, "left").select("node", F.coalesce("now", "label").alias("label"))
        labels = saved(new, "labels")
        first, second = (step.select(F.col("was").alias(c), F.col("now").alias(f"new_{c}")) for c in "ab")
        left = both.join(first, "a").join(second, "b").where("new_a <> new_b")
        both = saved(left.select(F.col("new_a").alias("a"), F.col("new_b").alias("b")).distinct(), "edges")
    return labels
