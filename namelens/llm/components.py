"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_root, shuffles_removed


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for each node of ``links`` (a long, b long); component is the smallest node reachable.

    Each round replaces every node's neighbours by links to its smallest neighbour, so that a chain of n links
    shrinks to a star in about log n rounds. Minimums are aggregated before they are joined, hence a node with very
    many neighbours is never gathered in one task. Each round is checkpointed, and what was
    shuffled for the links is removed then. An empty table gives an empty table;
    self links and repeated links change nothing; links with a null end are left out.
    """
    shared_root(links.sparkSession)
    ends = links.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
    with shuffles_removed(links.sparkSession):
        current = ends.where("lo < hi").distinct().checkpoint()
    before = None
    for _ in range(max_rounds):
        state = current.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            break
        before = state
        both = current.union(current.select(F.col("hi").alias("lo"), F.col("lo").alias("hi"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi"))
        large = large.where("lo < hi").distinct()
        small = large.groupBy("hi").agg(F.min("lo").alias("m"))
        joined = large.join(small, "hi")
        current = (
            joined.select(F.col("m").alias("lo"), F.col("lo").alias("hi"))
            .union(small.select(F.col("m").alias("lo"), "hi"))
            .where("lo < hi")
            .distinct()
            .checkpoint()
        )
    else:
        raise RuntimeError(f"links did not shrink to stars in {max_rounds} rounds")
    roots = current.select(F.col("lo").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return current.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(roots)
