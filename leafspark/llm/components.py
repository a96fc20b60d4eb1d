"""Connected components of an edge table by alternating star contraction.

Every round rewrites the edges as joins and grouped minima and writes them to the shared folder; the
driver sees one count a round. A hub's edges are spread by the skew handling of sort-merge joins, and
minima are combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafspark.llm.common import discard, staged


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links each node's larger (or, with itself, its smaller) neighbours to its least neighbour."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = both.join(least, "a")
    if large:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` to ``(node, component)``: the least node reachable. Loops, repeated edges and
    either order are fine; nodes without edges don't appear. No edges, no rows."""
    spark = edges.sparkSession
    now = staged(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(rounds):
        new = staged(_star(_star(now, large=True), large=False), "edges")
        # Done when every node points straight at its component: no node is both a child and a parent.
        open_ = new.select("b").distinct().join(new.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count()
        twice = 0 if open_ else new.groupBy("a").count().filter("count > 1").limit(1).count()
        discard(spark, now)
        now = new
        if not open_ and not twice:
            roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
    raise RuntimeError(f"components did not settle in {rounds} rounds")
