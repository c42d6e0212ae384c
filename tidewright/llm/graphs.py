"""Connected components of a graph that is given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``links``: long columns a and b.  Returns node and root (the smallest node that it reaches) for each
    node of a link.

    Alternating star contractions: in the large star each node hangs its larger neighbours on its smallest
    one; in the small star the smaller ones and itself.  The number of rounds grows with the logarithm of the
    longest path.  Minima are partial sums before a shuffle and come back by a join that may be split, so a
    node with very many links is not gathered in one task.  Each round is written to the checkpoint folder."""
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = settle(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if edges.isEmpty():
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    before = None
    for _ in range(most_rounds):
        around = both(edges)
        least = around.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        edges = around.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Now each edge goes from a node to a smaller one.
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        edges = settle(edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
    raise RuntimeError(f"the components did not settle in {most_rounds} rounds")
