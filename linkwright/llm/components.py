"""Connected components by alternating large-star and small-star, on edge tables of any shape."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkwright.llm.common import forget, written


def state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v") % 1_000_003)).first())


def large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of u is linked to the smallest of u and its neighbours; ``edges`` have u > v, as have the results."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy(F.col("u").alias("of")).agg(F.min("v").alias("m")).select("of", F.least("of", "m").alias("m"))
    # A hub's neighbours are joined with its minimum, so Spark may split them over tasks.
    return both.where("v > u").join(least, F.col("u") == F.col("of")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """u and each smaller neighbour are linked to the smallest of them."""
    least = edges.groupBy(F.col("u").alias("of")).agg(F.min("v").alias("m"))
    moved = edges.join(least, F.col("u") == F.col("of")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select(F.col("of").alias("u"), F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge but the component's smallest; component is that smallest node.

    The number of rounds grows with the logarithm of the largest component's diameter; each round is written to the
    shared folder, so that the plan stays short and a lost executor costs no more than a round.
    """
    now = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now = written(now)
    seen = state(now)
    for _ in range(most_rounds):
        last, now = now, written(small_star(large_star(now)))
        before, seen = seen, state(now)
        forget(last)
        if before == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
