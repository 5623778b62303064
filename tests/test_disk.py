"""What plans leave on disk and carry through shuffles."""

import time

from pyspark.sql import functions as F

from linkwright.operators import pairs, retrieve
from linkwright.plans import linkage

RECORDS = [("S1-1", "Blue Harbor Trading Ltd", "12 Main Street"), ("S2-2", "Blue  Harbor Co", "12 Main Rd 07"), ("S3-3", "", ""), ("S2-4", "Ltd", "Suite Suite 5 near Lane")]


def _prepared(spark):
    df = spark.createDataFrame([(*r, "en") for r in RECORDS], "entity_id string, business_name string, business_address string, country string")
    idf = spark.createDataFrame([("en", "n_blue", 2.0), ("en", "a_main", 1.5), ("en", "d_12", 1.0)], "country string, feature string, idf double")
    return pairs.prepare(df), idf


def _pairs(spark):
    return spark.createDataFrame([(a[0], b[0]) for a in RECORDS for b in RECORDS], "source1_entity_id string, candidate_entity_id string")


def _shuffled(spark) -> set:
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}


def test_written_leaves_no_shuffle(spark):
    before = _shuffled(spark)
    rows = spark.range(20_000).groupBy((F.col("id") % 997).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    assert linkage.written(rows).count() == 997
    made = lambda: {x for x in _shuffled(spark) - before if x.endswith(".data")}
    for _ in range(20):
        if len(made()) <= 1:  # the count's own
            break
        time.sleep(0.2)
    assert len(made()) <= 1
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


def test_pairs_carry_no_tokens_and_no_sets(spark):
    prepared, _ = _prepared(spark)
    df = pairs.sides(_pairs(spark), prepared)
    assert not {"nt", "at"} & set(df.schema["a"].dataType.names)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Join") :]
    assert "AS core_set" not in below and "core_set," not in below and "addr_set," not in below
    columns = ["concat", "core_set", "addr_set", "nums", "core_name"]
    own = {r.entity_id: [r[c] for c in columns] for r in prepared.collect()}
    rows = df.collect()
    assert len(rows) == len(RECORDS) ** 2
    for r in rows:
        assert [r.a[c] for c in columns] == own[r.source1_entity_id] and [r.b[c] for c in columns] == own[r.candidate_entity_id]


def test_featured_has_every_pair_part_by_part(spark, monkeypatch):
    prepared, idf = _prepared(spark)
    prepared, sizes = pairs.token_weights(prepared, idf), []
    whole = pairs.pair_features(_pairs(spark), prepared)
    made = pairs.pair_features
    monkeypatch.setattr(pairs, "pair_features", lambda rows, p: sizes.append(rows.count()) or made(rows, p))
    got = linkage.featured(_pairs(spark), prepared, parts=3)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect()))
    assert len(sizes) == 3 and sum(sizes) == len(RECORDS) ** 2 > max(sizes)


def test_views_are_kept_one_after_another(spark):
    rows = [("S1-1", "S1", ["n_a", "d_1", "k_x"]), ("S2-2", "S2", ["n_a", "d_2", "k_y"]), ("S2-3", "S2", ["n_b", "d_1", "k_z"]), ("S2-4", "S2", ["n_c", "d_3", "k_q"]), ("S2-5", "S2", ["n_e", "d_9", "k_w"])]
    bags = spark.createDataFrame([(e, s, "en", b) for e, s, b in rows], "entity_id string, src string, country string, bag array<string>")
    s1, s23, kept = bags.where("src = 'S1'"), bags.where("src <> 'S1'"), []
    keep = lambda df: kept.append(df.columns) or linkage.written(df)
    got = retrieve.multi_view(s1, s23, 4, 0.1, keep)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, retrieve.multi_view(s1, s23, 4, 0.1).collect())) == [("S1-1", "S2-2"), ("S1-1", "S2-3")]
    assert len(kept) == 9


def test_the_index_is_copied_no_more_often_than_cells_ask(spark, monkeypatch):
    for name, value in (("BLOCK", 2), ("SHARD", 3), ("MOST", 100), ("CELLS", 12)):
        monkeypatch.setattr(retrieve, name, value, raising=False)
    queries, postings = (spark.range(n).selectExpr("'en' AS country", "id") for n in (40, 12))
    assert tuple(retrieve._cells(queries, postings).first()) == ("en", 3, 4)
    monkeypatch.setattr(retrieve, "MOST", 5)  # what a task holds stays bounded
    assert tuple(retrieve._cells(queries, postings).first()) == ("en", 8, 4)
