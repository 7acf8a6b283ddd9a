"""Connected components over an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def stars(edges: DataFrame, scratch: Scratch, *, left: str = "a", right: str = "b") -> DataFrame:
    """From edges (``left``, ``right``) the pairs (node, root): root is the component's least node.

    A node that is its own root has no row. Each round hangs every larger
    neighbour of a node on the node's least neighbour, then every smaller one;
    a round is two joins against a minimum per node, so no neighbour list is
    ever gathered, and its result is written to the shared folder. The number
    of rounds grows with the logarithm of the longest path. Null nodes are not
    allowed; repeated edges and edges of a node with itself change nothing; an
    empty table gives an empty one.
    """
    u, v = F.greatest(left, right), F.least(left, right)
    now = scratch.table(edges.where(F.col(left) != F.col(right)).select(u.alias("u"), v.alias("v")).distinct(), "edges-0")
    before, round_ = None, 0
    while True:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written, so that the join with a hub's many edges is one that adaptive execution may split.
        least = scratch.table(both.groupBy(F.col("u").alias("k")).agg(F.min(F.least("u", "v")).alias("m")), f"least-{round_}")
        large = both.join(least, both["u"] == least["k"]).where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.table(large, f"large-{round_}")
        least = scratch.table(large.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m")), f"hung-{round_}")
        small = large.join(least, large["u"] == least["k"]).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionAll(least.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct()
        small = scratch.table(small, f"edges-{round_ + 1}")
        state = small.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        for name in (f"edges-{round_}", f"large-{round_}", f"least-{round_}", f"hung-{round_}"):
            scratch.drop(name)
        now, round_ = small, round_ + 1
        if state == before or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
