"""Connected components of links by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import checkpointed


def _stars(links: DataFrame, large: bool) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both if large else both.where("b < a")
    least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = near.join(least, "a")
    if large:  # neighbours above a node move to the least of the node and its neighbours
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:  # a node and its smaller neighbours move to the least of them
        out = joined.select("a", F.col("m").alias("b")).unionByName(joined.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")))
    return out.where("a != b").distinct()


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """(a, root) of every node of ``links`` (a, b): root is the smallest node of its component.

    Each round is checkpointed to the shared folder; only counts come to the driver. A node that links to itself is a
    component. The number of rounds grows with the logarithm of the nodes.
    """
    links = checkpointed(links.select("a", "b"))  # it is read twice below
    nodes = links.select("a").unionByName(links.select(F.col("b").alias("a"))).distinct()
    state = checkpointed(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    for _ in range(most):
        mark = state.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(mark) == seen or not mark[0]:
            break
        seen = tuple(mark)
        state = checkpointed(_stars(_stars(state, True), False))
    else:
        raise RuntimeError("components did not settle")
    return nodes.join(state.select("a", F.col("b").alias("root")), "a", "left").select("a", F.coalesce("root", "a").alias("root"))
