"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.llm.common import joinable, save


def stars(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node that is not the smallest of its component.

    edges: long columns u, v, any orientation, repeats and self-links allowed. Each round sends every node's larger
    neighbours to its smallest one, then does the same among smaller neighbours; rounds grow with the logarithm of the
    component's size squared at most. Every round's table goes to the shared folder. Minima are partial aggregates; they
    are broadcast where the edges are few, and else written before the join, whose sides are then plain shuffles, so that
    a hub's edges may be split among tasks.
    """
    e = save(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    last = (e.count(),)
    for _ in range(max_rounds):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = joinable(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least", 2 * last[0])
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = save(large.where("u <> v").distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(joinable(least, "least", 2 * last[0]), "u")
        kept = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = save(kept.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == last:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        last = tuple(now)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
