"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.session import drop, keep

#: Rounds after which a graph counts as broken; each round at least halves distances.
MOST_ROUNDS = 60


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node that has an edge; the root is the least node of its component.

    Alternates large-star and small-star steps: each hangs a node's neighbours on the
    least of them.  Each round is written to the shared folder, where every executor can
    read it again, and the one before is dropped.
    """
    links = _star(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v"), small=True)
    links, before = keep(links), None
    for _ in range(MOST_ROUNDS):
        last, links = links, keep(_star(_star(links, small=False), small=True))
        drop(last)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle within {MOST_ROUNDS} rounds")
    return nodes(links, "u", "v")


def nodes(stars: DataFrame, node: str, root: str) -> DataFrame:
    """(node, root) of links that all hang on their roots; roots are nodes too."""
    own = stars.select(F.col(node).alias("node"), F.col(root).alias("root"))
    return own.unionByName(stars.select(F.col(root).alias("node"), F.col(root).alias("root")).distinct())


def _star(links: DataFrame, small: bool) -> DataFrame:
    """Links (u, v) with u > v, rewired to the least neighbour."""
    if small:
        own = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = own.groupBy("u").agg(F.min("v").alias("m"))
        moved = own.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
