"""Connected classes of links by alternating star contraction on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.session import materialize


def connected_classes(links: DataFrame, rounds: int = 30) -> DataFrame:
    """(id, class_id) of every id in ``links`` (a, b); class_id is the least id of its component.

    Each round points every node at the least neighbour it knows (large star, then small star); hubs are
    handled by grouped minima, which combine before the shuffle, so no adjacency list is ever
    collected. Raises if not stable after ``rounds`` rounds (components of a path length above 2**rounds).
    """
    edges = materialize(links.select("a", "b").where("a <> b").distinct(), "edges")
    for _ in range(rounds):
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        new = materialize(small.select(F.greatest("u", "v").alias("b"), F.least("u", "v").alias("a")).distinct(), "edges")
        stable = new.join(edges, ["a", "b"], "left_anti").isEmpty() and edges.join(new, ["a", "b"], "left_anti").isEmpty()
        edges = new
        if stable:
            stars = edges.select(F.col("b").alias("id"), F.col("a").alias("class_id"))
            return stars.unionByName(edges.select(F.col("a").alias("id"), F.col("a").alias("class_id")).distinct())
    raise RuntimeError(f"components not stable after {rounds} rounds")
