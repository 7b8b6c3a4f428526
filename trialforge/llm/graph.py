"""Connected components of a large, sparse graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 100, rows: int | None = None) -> DataFrame:
    """``node, comp``: the least node reachable, for every node of an edge.

    Each round takes the least label among a node's own, its neighbours' and
    its label's, so chains shorten by more than half per round; labels are
    checkpointed in the shared folder, and only a count of changes reaches the
    driver.  Null ends are dropped; loops and repeated edges are harmless.  ``rows`` is a bound of the
    number of edges, if one is known.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    both = cut(both.union(both.select(F.col("v"), F.col("u"))).distinct(), rows and 2 * rows)
    n = both.count()
    labels = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("l")).withColumnRenamed("u", "node"), n)
    for _ in range(rounds):
        near = both.join(labels.select(F.col("node").alias("v"), "l"), "v").groupBy("u").agg(F.min("l").alias("m"))
        up = labels.select(F.col("node").alias("l"), F.col("l").alias("up"))
        now = labels.join(near.withColumnRenamed("u", "node"), "node").join(up, "l", "left")
        now = cut(now.select("node", F.least("l", "m", "up").alias("l"), (F.least("m", "up") < F.col("l")).alias("moved")), n)
        moved = now.where("moved").limit(1).count()
        labels = now.select("node", "l")
        if not moved:
            return labels.select("node", F.col("l").alias("comp"))
    raise RuntimeError("components did not settle")
