"""Kernels, decisions, files and rules on small cases."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from linkwright.operators import decide, measure, pairs, quality, retrieve, sampling, similarity
from linkwright.sources import records as R


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_common_subsequence_against_a_table():
    rng = random.Random(1)
    for _ in range(500):
        a, b = ("".join(rng.choices("abc ", k=rng.randrange(9))) for _ in range(2))
        assert similarity.common_subsequence(a, b) == lcs(a, b)


def test_partial_ratio_against_all_windows():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ("".join(rng.choices("abc", k=rng.randrange(1, 9))) for _ in range(2))
        short, long = sorted((a, b), key=len)
        n = len(short)
        best = max(similarity.ratio(short, long[max(0, i) : i + n]) for i in range(1 - n, len(long)))
        if len(a) == len(b):
            best = max(best, max(similarity.ratio(b, a[max(0, i) : i + n]) for i in range(1 - n, n)))
        assert similarity.partial_ratio(a, b) == pytest.approx(best)


def test_kernels_of_many_pairs_equal_those_of_one(monkeypatch):
    rng = random.Random(11)
    some = lambda: " ".join("".join(rng.choice(rng.choice(["ab", "abcdefgh 0123", "aé漢😀"])) for _ in range(rng.randint(0, 9))) for _ in range(rng.choice([0, 1, 3, 9, 25])))
    texts = [some() for _ in range(60)] + ["", " ", *("ab" * 99)[:130:13], *("x" * n for n in (63, 64, 65, 128, 129)), "z" * 64 + "x"]
    pairs = [(rng.choice(texts), rng.choice(texts)) for _ in range(600)] + [(t, " ".join(rng.sample(t.split(" "), t.count(" ") + 1))) for t in texts]
    want = {name: [kernel(*p) for p in pairs] for name, kernel in similarity.KERNELS.items()}
    # No pair goes by itself unless its strings are very long.
    for name in ("common_subsequence", "ratio", "_windows", "partial_ratio", "token_set_ratio", "token_sort_ratio"):
        monkeypatch.setattr(similarity, name, None)
    for cells in (similarity.CELLS, 100):
        monkeypatch.setattr(similarity, "CELLS", cells)
        got = similarity.compare_all(pairs, tuple(want))
        assert {name: list(values) for name, values in got.items()} == want


def test_kernels_in_spark(spark):
    rows = [("acme foods", "foods acme ltd"), (None, ""), ("", "a"), ("a" * 700, "b" + "a" * 699), ("acme foods", "foods acme ltd")]
    names = tuple(similarity.KERNELS)
    df = spark.createDataFrame(rows, "a string, b string").coalesce(1).select("a", "b", similarity.kernels(F.col("a"), F.col("b"), *names).alias("k"))
    for r in [*df.collect(), *df.limit(0).collect()]:
        assert list(r.k) == [similarity.KERNELS[n](r.a or "", r.b or "") for n in names]


def test_kernel_corner_cases():
    assert similarity.ratio("", "") == 100 and similarity.token_set_ratio("", "a") == 0
    assert similarity.token_set_ratio("acme foods", "foods acme ltd") == 100
    assert similarity.jaro_winkler("martha", "marhta") == pytest.approx(0.961111, abs=1e-6)
    assert similarity.jaro_winkler("abxyzq", "abmnop") == pytest.approx(0.555556, abs=1e-6)


def scored(spark, rows):
    return spark.createDataFrame([("S1-1", f"S2-{i}", p, 1 if i == 0 else 0) for i, p in enumerate(rows)], "source1_entity_id string, candidate_entity_id string, p double, label int")


@pytest.mark.parametrize(("p", "miss", "power", "kept"), [([0.95, 0.8, 0.3, 0.01], 0.1, 1.0, 2), ([0.2, 0.1], 0.5, 1.5, 0)])
def test_expected_f05(spark, p, miss, power, kept):
    assert decide.select_expected(scored(spark, p), miss, power).count() == kept


def test_f05_of_empty_and_wrong_entities(spark):
    entities = spark.createDataFrame([("S1-1", 2), ("S1-2", 0), ("S1-3", 0)], "entity_id string, n_true long")
    kept = spark.createDataFrame([("S1-1", 1), ("S1-1", 1), ("S1-1", 0), ("S1-3", 0)], "source1_entity_id string, label int")
    got = {r["entity_id"]: r["f05"] for r in decide.entity_f05(kept, entities).collect()}
    assert got["S1-1"] == pytest.approx(0.714286, abs=1e-6) and got["S1-2"] == 1 and got["S1-3"] == 0


def test_one_to_one_gives_each_candidate_one_claim(spark):
    rows = [(f"S1-{a}", f"S2-{b}", ((a * 7 + b * 3) % 10) / 10) for a, b in itertools.product(range(5), range(6))]
    df = spark.createDataFrame(rows, "source1_entity_id string, candidate_entity_id string, p double")
    out = decide.select_threshold(df, 0.2, 0.5, most=3).collect()
    assert len({r["candidate_entity_id"] for r in out}) == len(out)


@pytest.mark.parametrize(("a", "b", "near", "least", "prefix"), [(428, 435, 1, 7, 0), (1082, 108, 0, 974, 1), (9940, 9947, 1, 7, 0), (17954, 17954, 0, -1, 0)])
def test_number_features(spark, a, b, near, least, prefix):
    df = spark.createDataFrame([([a], [b])], "x array<bigint>, y array<bigint>").select(F.struct(F.col("x").alias("seq")).alias("a"), F.struct(F.col("y").alias("seq")).alias("b"))
    made = pairs.number_features(F.col("a"), F.col("b"))
    row = df.select(*[c.alias(n) for n, c in made.items()]).first()
    assert (row["num_near_miss"], row["num_min_diff"], row["num1_prefix"]) == (near, least, prefix)


def test_small_index_loses_all_to_the_default_cut(spark):
    bags = spark.createDataFrame([(f"S2-{i}", "us", [f"n_{i}"]) for i in range(1500)], "entity_id string, country string, bag array<string>")
    assert retrieve.inverse_frequency(bags).count() == 0 and retrieve.inverse_frequency(bags, 1.0).count() == 1500


def test_tsv_reads_blanks_quotes_and_na(spark, tmp_path):
    (tmp_path / "a.tsv").write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\t"""ehpad Club SAS"\t\tFrance\nS1-2\tNA\t 1 rue\tFrance\n')
    got = [tuple(r) for r in R.read_tsv(spark, str(tmp_path / "a.tsv")).collect()]
    assert got == [("S1-1", '"ehpad Club SAS', "", "France"), ("S1-2", "NA", " 1 rue", "France")]


CASES = {
    "separated by commas": "source1_entity_id,matched_entity_ids\nS1-1,S2-1\n", "the header is": "a\tb\nS1-1\tS2-1\n", "without a tab": "source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1\nS1-2\n",
    "repeated rows": "source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1\nS1-1\t\nS1-2\t\n", "repeat an id": "source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1,S2-1\nS1-2\t\n",
    "first-source ids": "source1_entity_id\tmatched_entity_ids\nS1-1\tS1-2\nS1-2\t\n", "of no source": "source1_entity_id\tmatched_entity_ids\nS1-1\tX9-1\nS1-2\t\n",
    "unknown ids": "source1_entity_id\tmatched_entity_ids\nS1-1\tS2-99\nS1-2\t\n", "missing entities": "source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1\n",
    "don't belong": "source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1\nS1-2\t\nS1-9\t\n",
}


@pytest.mark.parametrize("rule", CASES)
def test_rules_for_match_lists(spark, tmp_path, rule):
    (tmp_path / "m.tsv").write_text(CASES[rule])
    (tmp_path / "c.tsv").write_text("source1_entity_id\tcandidate_entity_ids\nS1-1\tS2-1\nS1-2\t\n")
    ids, known = spark.createDataFrame([("S1-1",), ("S1-2",)], "entity_id string"), spark.createDataFrame([("S2-1",)], "entity_id string")
    errors, _ = quality.validate(spark, str(tmp_path / "m.tsv"), str(tmp_path / "c.tsv"), ids, known)
    assert any(rule in e for e in errors)


def test_a_match_that_is_no_candidate_is_a_warning(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-2\n")
    (tmp_path / "c.tsv").write_text("source1_entity_id\tcandidate_entity_ids\nS1-1\tS2-1\n")
    errors, warnings = quality.validate(spark, str(tmp_path / "m.tsv"), str(tmp_path / "c.tsv"), spark.createDataFrame([("S1-1",)], "entity_id string"))
    assert not errors and len(warnings) == 1


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(200).select(F.concat(F.lit("S1-"), F.col("id")).alias("entity_id"))
    one = {r[0] for r in sampling.fixed_sample(df.repartition(7), 20).collect()}
    assert one == {r[0] for r in sampling.fixed_sample(df.coalesce(1), 20).collect()} and len(one) == 20


def test_recall_grows_with_k(spark):
    ranked = spark.createDataFrame([("S1-1", f"S2-{i}", i) for i in range(1, 20)], "source1_entity_id string, candidate_entity_id string, rank int")
    truth = spark.createDataFrame([("S1-1", "S2-3"), ("S1-1", "S2-12"), ("S1-1", "S2-99")], "source1_entity_id string, candidate_entity_id string")
    got = [r["recall"] for r in measure.recall_at_k(ranked, truth).orderBy("k").collect()]
    assert got == sorted(got) and got[-1] == pytest.approx(2 / 3)
