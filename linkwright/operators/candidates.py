"""Candidate sets: reverse-only pairs, anchors, sibling expansion, and the context features of pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkwright.operators import retrieve as R

PAIR = ["source1_entity_id", "candidate_entity_id"]
# The names of the context features, in the order of the models.
CONTEXT = ["score", "rank", "score_rel", "score_gap_best", "fwd", "rscore", "rev_rank", "rev_score_rel", "rev_gap", "rev_margin", "rev_is_best", "rev_best", "a_n_revbest", "is_anchor", "sib_n", "sib_best"]


def union_reverse(forward: DataFrame, rev: DataFrame) -> DataFrame:
    """Forward pairs (fwd 1) and pairs that only the reverse lists have (score 0, fwd 0), of queried entities."""
    f = forward.select(*PAIR, "score", F.lit(1).alias("fwd"))
    r = rev.select(F.col("s1").alias("source1_entity_id"), F.col("b").alias("candidate_entity_id"), F.lit(0.0).alias("score"), F.lit(0).alias("fwd"))
    return f.unionByName(r).groupBy(*PAIR).agg(F.max("score").alias("score"), F.max("fwd").alias("fwd"))


def anchors(pairs: DataFrame, rev: DataFrame, n_anchor: int = 5) -> DataFrame:
    """``pairs`` with is_anchor: of the three best and those whose own best is this entity, own ones first, the first five."""
    own = rev.where("rrank = 1").select(F.col("s1").alias("source1_entity_id"), F.col("b").alias("candidate_entity_id"), F.lit(1).alias("_own"))
    by = Window.partitionBy("source1_entity_id")
    df = pairs.join(own, PAIR, "left").withColumn("_own", F.coalesce("_own", F.lit(0)))
    df = df.withColumn("_rank", F.row_number().over(by.orderBy(F.desc("score"), "candidate_entity_id")))
    may = (F.col("_rank") <= 3) | (F.col("_own") == 1)
    place = F.row_number().over(by.orderBy(may.cast("int").desc(), F.desc("_own"), F.desc("score"), "candidate_entity_id"))
    return df.withColumn("is_anchor", (may & (place <= n_anchor)).cast("double")).drop("_own", "_rank")


def chosen_anchors(anchored: DataFrame) -> DataFrame:
    """source1_entity_id, anchor."""
    return anchored.where("is_anchor = 1").select("source1_entity_id", F.col("candidate_entity_id").alias("anchor"))


def nearest(chosen: DataFrame, s23_bags: DataFrame, s23_index: tuple, top_n: int = 5) -> DataFrame:
    """anchor, candidate_entity_id, nscore: the nearest records of each distinct anchor, itself left out."""
    asked = s23_bags.join(chosen.select(F.col("anchor").alias("entity_id")).distinct(), "entity_id", "left_semi")
    near = R.retrieve(asked, *s23_index, top_n + 1).where("query <> candidate")
    return near.select(F.col("query").alias("anchor"), F.col("candidate").alias("candidate_entity_id"), F.col("score").alias("nscore"))


def sibling_edges(anchored: DataFrame, s23_bags: DataFrame, s23_index: tuple, top_n: int = 5, near: DataFrame | None = None) -> DataFrame:
    """source1_entity_id, anchor, candidate_entity_id, nscore. ``near``: what ``nearest`` found for these anchors at least."""
    chosen = chosen_anchors(anchored)
    near = nearest(chosen, s23_bags, s23_index, top_n) if near is None else near
    return chosen.join(near, "anchor").select("source1_entity_id", "anchor", "candidate_entity_id", "nscore")


def sibling_expand(anchored: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs with sib_n (anchors that list the candidate) and sib_best; neighbours that are no pairs yet join with score 0."""
    stats = edges.groupBy(*PAIR).agg(F.countDistinct("anchor").alias("sib_n"), F.max("nscore").alias("sib_best"))
    zero = lambda c, kind: F.coalesce(F.col(c), F.lit(0)).cast(kind).alias(c)
    return anchored.join(stats, PAIR, "full_outer").select(*PAIR, zero("score", "double"), zero("fwd", "int"), zero("is_anchor", "double"), zero("sib_n", "bigint"), zero("sib_best", "double"))


def context_features(pairs: DataFrame, rev: DataFrame, summary: DataFrame, r: int = R.REVERSE_K) -> DataFrame:
    """``pairs`` with rank, relations to the best score, and what the reverse lists say."""
    by = Window.partitionBy("source1_entity_id")
    own = rev.select(F.col("s1").alias("source1_entity_id"), F.col("b").alias("candidate_entity_id"), "rscore", "rrank")
    df = pairs.join(own, PAIR, "left").join(summary.withColumnRenamed("b", "candidate_entity_id"), "candidate_entity_id", "left")
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    df = df.withColumns(
        {
            "rank": F.row_number().over(by.orderBy(F.desc("score"), "candidate_entity_id")), "_best": F.max("score").over(by), "rscore": F.coalesce("rscore", F.lit(0.0)),
            "rev_rank": F.coalesce("rrank", F.lit(r + 1)), "rev_best": F.coalesce("rev_best", F.lit(0.0)), "rev_second": F.coalesce("rev_second", F.lit(0.0)),
        }
    )
    df = df.withColumns(
        {
            "score_rel": share("score", "_best"), "score_gap_best": F.col("_best") - F.col("score"), "rev_score_rel": share("rscore", "rev_best"),
            "rev_gap": F.col("rev_best") - F.col("rscore"), "rev_margin": F.col("rev_best") - F.col("rev_second"), "rev_is_best": (F.col("rev_rank") == 1).cast("double"),
        }
    )
    return df.withColumn("a_n_revbest", F.sum("rev_is_best").over(by)).drop("_best", "rrank", "rev_second")
