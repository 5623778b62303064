"""Truth, labels, and the recall of candidate sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAIR = ["source1_entity_id", "candidate_entity_id"]
KS = [5, 10, 20, 30, 50, 75, 100, 200]


def truth_pairs(truth: DataFrame, entity: str = "source1_entity_id", ids: str = "matched_entity_ids") -> DataFrame:
    """Pairs of a table of comma-joined lists; blanks around ids are dropped, as are empty ones."""
    each = F.explode(F.filter(F.transform(F.split(F.coalesce(ids, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != ""))
    return truth.select(F.col(entity).alias("source1_entity_id"), each.alias("candidate_entity_id")).distinct()


def entity_counts(s1: DataFrame, truth: DataFrame) -> DataFrame:
    """entity_id, n_true for every first-source record, those without matches included."""
    n = truth.groupBy(F.col("source1_entity_id").alias("entity_id")).agg(F.count(F.lit(1)).alias("n_true"))
    return s1.select("entity_id").join(n, "entity_id", "left").na.fill(0, ["n_true"])


def label_pairs(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    return pairs.join(truth.select(*PAIR, F.lit(1).alias("label")), PAIR, "left").na.fill(0, ["label"])


def recall_at_k(ranked: DataFrame, truth: DataFrame, ks: list[int] = KS) -> DataFrame:
    """k, recall, pairs: the share of true pairs of rank up to k, and how many pairs that takes."""
    found = truth.join(ranked.select(*PAIR, "rank"), PAIR, "left")
    hits = found.agg(F.count(F.lit(1)).alias("all"), *[F.sum((F.coalesce("rank", F.lit(1 << 30)) <= k).cast("long")).alias(f"h{k}") for k in ks])
    sizes = ranked.agg(*[F.sum((F.col("rank") <= k).cast("long")).alias(f"n{k}") for k in ks])
    rows = F.array(*[F.struct(F.lit(k).alias("k"), (F.col(f"h{k}") / F.col("all")).alias("recall"), F.col(f"n{k}").alias("pairs")) for k in ks])
    return hits.crossJoin(sizes).select(F.explode(rows).alias("r")).select("r.*")  # one row each


def recall_by(pairs: DataFrame, truth: DataFrame, s1: DataFrame) -> DataFrame:
    """country, source, n, recall of true pairs by the entity's country and the candidate's source."""
    found = label_pairs(truth, pairs).join(s1.select(F.col("entity_id").alias("source1_entity_id"), "country"), "source1_entity_id")
    return found.groupBy("country", F.substring("candidate_entity_id", 1, 2).alias("source")).agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("recall"))


def missed_pairs(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    return truth.join(pairs, PAIR, "left_anti").select(*PAIR)


def recall_attribution(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: recall of forward pairs, with reverse ones, and with sibling-only ones. ``pairs`` has fwd, rscore, sib_n."""
    found = truth.join(pairs.select(*PAIR, "fwd", "in_reverse", F.lit(1).alias("any")), PAIR, "left")
    rate = lambda c: F.avg(F.coalesce(c.cast("int"), F.lit(0)))
    return found.agg(rate(F.col("fwd") == 1).alias("recall_forward"), rate((F.col("fwd") == 1) | (F.col("in_reverse") == 1)).alias("recall_reverse"), rate(F.col("any") == 1).alias("recall_sibling"))


def reduction(pairs: DataFrame, truth: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: pairs, recall, and the share of all possible pairs that was avoided."""
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    hit = label_pairs(truth, pairs).agg(F.avg("label").alias("recall"))
    one = n(pairs, "pairs").crossJoin(n(left, "l")).crossJoin(n(right, "r")).crossJoin(hit)  # one row each
    return one.select("pairs", "recall", (1 - F.col("pairs") / (F.col("l") * F.col("r"))).alias("reduction"))
