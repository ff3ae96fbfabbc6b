"""Fixpoints over relations: repeat a step until nothing changes, each round a table of its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import by_shuffle, discard, table

MOST_ROUNDS = 100_000
SALTS = 16


def until_stable(state: DataFrame, step: Callable[[DataFrame], DataFrame], what: str = "round") -> DataFrame:
    """Apply ``step`` until its boolean column ``changed`` is false in all rows. Only that one fact comes to the driver. A round's table is deleted
    when the next is written."""
    for _ in range(MOST_ROUNDS):
        before, state = state, table(step(state), what)
        discard(before)
        if state.where("changed").isEmpty():
            return state
    raise RuntimeError(f"{what}: no fixpoint in {MOST_ROUNDS} rounds")


def least_reachable(edges: DataFrame) -> DataFrame:
    """(image_id, node, root) for edges (image_id, a, b): the smallest node of each connected component.

    Nodes take the smallest label among their neighbours' and then that label's label, so paths shrink by powers.
    """
    both = edges.select("image_id", "a", "b").union(edges.select("image_id", F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct()
    both = by_shuffle(table(both, "edges"))
    start = both.groupBy("image_id", "a").agg(F.min("b").alias("m")).select("image_id", F.col("a").alias("node"), F.least("a", "m").alias("root"), F.lit(True).alias("changed"))

    def step(labels: DataFrame) -> DataFrame:
        named = labels.select("image_id", F.col("node").alias("a"), "root")
        heard = both.join(named, ["image_id", "a"]).groupBy("image_id", F.col("b").alias("node")).agg(F.min("root").alias("m"))
        better = by_shuffle(labels).join(heard, ["image_id", "node"]).select("image_id", "node", F.col("root").alias("old"), F.least("root", "m").alias("root"))
        # Many nodes may have one root: what it has itself comes to them by a salted key.
        better = better.withColumn("s", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
        over = better.select("image_id", F.col("node").alias("root"), F.col("root").alias("further"))
        spread = better.select("image_id", "root", "s").distinct().join(over, ["image_id", "root"])
        jumped = better.join(spread, ["image_id", "root", "s"], "left").withColumn("to", F.least("root", F.coalesce("further", "root")))
        return jumped.select("image_id", "node", F.col("to").alias("root"), (F.col("to") != F.col("old")).alias("changed"))

    return until_stable(table(start, "labels"), step, "labels").drop("changed")
