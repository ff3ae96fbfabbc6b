"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, stored

SALTS = 64


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of ``edges`` (a, b: long); the root is the smallest node that a path leads to.

    Each round every node takes the smallest label among its neighbours' (aggregated before it is shuffled) and then its
    label's label, so that long paths shrink by powers. Rounds end when no label changes. Labels and edges are stored
    tables, and a round's are deleted after the next. Nodes with many edges and labels of many nodes are joined by a salted key.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct()
    both = stored(both.withColumn("s", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int")), "edges")
    hubs = stored(both.select("a", "s").distinct(), "hubs")
    table = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "labels")
    labels = table
    while True:
        spread = hubs.join(labels, hubs["a"] == labels["node"]).select("a", "s", "root")
        heard = both.join(spread, ["a", "s"]).groupBy("b").agg(F.min("root").alias("m"))
        better = labels.join(heard, labels["node"] == heard["b"]).select("node", F.col("root").alias("old"), F.least("root", "m").alias("root"))
        # Many nodes may have one root: its own root comes to them by a salted key.
        better = better.withColumn("s", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
        better = stored(better, "heard-labels")
        to = better.select("root", "s").distinct().join(better.select(F.col("node").alias("r"), F.col("root").alias("rr")), F.col("root") == F.col("r"))
        jumped = better.join(to.select("root", "s", "rr"), ["root", "s"], "left").select("node", "old", F.least("root", F.coalesce("rr", "root")).alias("root"))
        fresh = stored(jumped, "labels")
        discard(better)
        discard(table)
        table = fresh
        labels = fresh.select("node", "root")
        if fresh.where("old != root").isEmpty():
            discard(both)
            discard(hubs)
            return labels
