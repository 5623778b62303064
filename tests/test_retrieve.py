"""Retrieval against a plain join of all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from linkwright.operators import retrieve

BAG = "entity_id string, country string, bag array<string>"


def all_pairs(queries, postings, idf, k):
    q = retrieve.weighted(queries, idf).select(F.col("entity_id").alias("query"), "country", "feature", F.col("w").alias("wq"))
    c = postings.select(F.col("entity_id").alias("candidate"), "country", "feature", "w")
    return retrieve.top_k(q.join(c, ["country", "feature"]).groupBy("query", "candidate").agg(F.round(F.sum(F.col("wq") * F.col("w")), 9).alias("score")).where("score > 0"), k)


def same(a, b):
    assert [r[:2] + r[3:] for r in a] == [r[:2] + r[3:] for r in b]
    assert [r[2] for r in a] == pytest.approx([r[2] for r in b], abs=2e-9)


@pytest.mark.parametrize(("block", "shard"), [(16_000, 3_000_000), (7, 60)])
def test_best_candidates_against_all_pairs(spark, monkeypatch, block, shard):
    monkeypatch.setattr(retrieve, "BLOCK", block)
    monkeypatch.setattr(retrieve, "SHARD", shard)
    rng = random.Random(3)
    made = lambda src, n: [(f"{src}-{i}", rng.choice(["us", "fr", None]), rng.sample([f"n_{j}" for j in range(30)], rng.randrange(6))) for i in range(n)]
    queries, others = made("S1", 60), made("S2", 90)
    others += [(f"S3-{i}", "us", ["n_1", "n_2"]) for i in range(20)] + [("S2-x", "de", ["n_1"])]  # copies, whose ties go to the smaller id
    queries += [("S1-a", "us", ["n_1", "n_2"]), ("S1-b", "us", ["n_1", "n_2"]), ("S1-c", "us", ["n_unseen"]), ("S1-d", "us", None), ("S1-e", "es", ["n_1"])]
    q, c = spark.createDataFrame(queries, BAG), spark.createDataFrame(others, BAG)
    postings, idf = retrieve.build_index(c, 0.1)
    order = ["query", "rank"]
    got = [tuple(r) for r in retrieve.retrieve(q, postings, idf, 4).orderBy(*order).collect()]
    assert len(got) > 100
    same(got, [tuple(r) for r in all_pairs(q, postings, idf, 4).orderBy(*order).collect()])


def test_an_entity_with_two_rows_counts_with_both(spark):
    rows = [("S2-1", "us", ["n_a", "n_b"]), ("S2-1", "us", ["n_a", "n_c"]), ("S2-2", "us", ["n_b"])] + [(f"S2-{i}", "us", [f"n_{i}"]) for i in range(10, 30)]
    q = spark.createDataFrame([("S1-1", "us", ["n_a", "n_b"]), ("S1-1", "us", ["n_a"])], BAG)
    postings, idf = retrieve.build_index(spark.createDataFrame(rows, BAG), 0.1)
    order = ["query", "rank"]
    got, plain = ([tuple(r) for r in f(q, postings, idf, 3).orderBy(*order).collect()] for f in (retrieve.retrieve, all_pairs))
    assert len(got) == 2
    same(got, plain)
