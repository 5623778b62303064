"""Files to checked lists: the stages, their resumption, training and other scripts."""

import json

import pytest
from pyspark.sql import functions as F

from linkwright.functions import text as T
from linkwright.functions.scripts import latin_records, romanise
from linkwright.operators import decide, measure, model, quality, retrieve
from linkwright.plans import linkage, run
from linkwright.sources import records as R

SMALL = "/root/testdata/sf0.001"
FAST = ["--min-idf", "1.0", "--top-k", "5", "--rounds", "6", "--patience", "2", "--least-rows", "1", "--batches", "2", "--drop-s1", "0.1"]


def write_file(df, path):
    rows = df.collect()
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join("\t".join(x) for x in [df.columns, *[["" if v is None else v for v in r] for r in rows]]) + "\n")


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    """The records of the documents as files, below a folder of another name."""
    top = tmp_path_factory.mktemp("data")
    records = R.document_records(spark, SMALL).persist()
    for split in ("train", "test"):
        for i in (1, 2, 3):
            write_file(records.where(F.col("src") == f"S{i}").select("entity_id", "business_name", "business_address", "country"), top / "input" / split / f"{split}_source{i}.tsv")
    lists = R.document_truth(records).groupBy("source1_entity_id").agg(F.array_join(F.array_sort(F.collect_list("candidate_entity_id")), ",").alias("matched_entity_ids"))
    write_file(lists, top / "input" / "train" / "train_ground_truth.tsv")
    return top


def test_files_to_checked_lists_and_resumption(spark, data, tmp_path, capsys):
    assert R.find_training_folder(spark, str(data)).endswith("/input") and R.find_training_folder(spark, str(data / "none")) is None
    flags = ["--data", str(data), "--work", str(tmp_path), "--eval-blocking", "--check-ids", *FAST]
    assert run.run(spark, run.options(flags)) == 0
    said = capsys.readouterr().out
    assert "0 errors" in said and "recall" in said
    lists = {r["entity_id"]: r["ids"] or "" for r in quality.read_lists(spark, str(tmp_path / "matching_results.tsv")).collect()}
    ids = {r[0] for r in R.read_ids(spark, str(data / "input/test/test_source1.tsv")).collect()}
    assert set(lists) == ids and any(lists.values())
    # What is there isn't made again: the stages' folders keep their times, and lost ones come back alone.
    tag = next(p for p in tmp_path.iterdir() if (p / "model").is_dir())
    times = {p: p.stat().st_mtime for p in tag.rglob("_SUCCESS")}
    lost = next(tag.rglob("batch=1"))
    for p in sorted(lost.rglob("*"), reverse=True):
        p.unlink() if p.is_file() else p.rmdir()
    lost.rmdir()
    assert run.run(spark, run.options(flags)) == 0
    assert all(p.stat().st_mtime == t for p, t in times.items() if lost not in p.parents) and (lost / "_SUCCESS").exists()
    again = {r["entity_id"]: r["ids"] or "" for r in quality.read_lists(spark, str(tmp_path / "matching_results.tsv")).collect()}
    assert again == lists


def test_batches_score_what_one_run_does(spark, tmp_path):
    settings = linkage.Settings(top_k=5, min_idf=1.0, rounds=4, patience=2, least_rows=1, stage3="off", drop_s1=0.1)
    work = linkage.documents(spark, SMALL, settings, keep=True)
    linkage.learn(work, str(tmp_path / "bundle"))
    models, selection = model.load(spark, str(tmp_path / "bundle"))
    report = selection["report"]
    assert sorted(models) == [1, 2] and report["oracle_f05"] >= report["oracle_f05_after_stage1"] >= selection["f05"] - 1e-9
    assert 0 < report["positive_rate"] < 1 and [p["keep"] for p in report["operating_points"]] == [0.99, 0.995, 0.998, 0.999]
    assert all(sum(x for _, x in named) <= 1 + 1e-9 and named for named in report["importances"].values()) and json.dumps(selection)
    pair = lambda df: sorted((r[0], r[1], round(r[2], 9)) for r in df.collect())
    whole = linkage.score(work, models, selection).select("source1_entity_id", "candidate_entity_id", "p")
    parts = linkage.score_in_batches(spark, work, models, selection, str(tmp_path / "out"), 3)
    assert pair(parts) == pair(whole)


def test_training_takes_a_part_of_the_world(spark):
    settings = linkage.Settings(top_k=5, min_idf=1.0, n_s1=40, drop_s1=0.25)
    work = linkage.documents(spark, SMALL, settings, keep=True)
    part = linkage.training_part(work)
    assert part.s1.count() == 40 and part.s23.count() == work.s23.count()
    assert {r[0] for r in part.context.select("source1_entity_id").collect()} <= {r[0] for r in part.s1.select("entity_id").collect()}
    known = {r[0] for r in part.reverse.select("s1").distinct().collect()}
    assert len(known) > 40 and len(known) <= 0.9 * work.s1.count()


def test_rounds_stop_where_the_loss_does(spark):
    rows = linkage.documents(spark, SMALL, linkage.Settings(top_k=5, min_idf=1.0), keep=True).labelled.persist()
    held = rows.where(F.crc32("source1_entity_id") % 3 == 0)
    rest = rows.where(F.crc32("source1_entity_id") % 3 != 0)
    best = model.best_rounds(rest, held, 1, most=16, patience=4, minInstancesPerNode=1)
    by_round = model.losses(model.fit(rest, 1, 16, minInstancesPerNode=1), held)
    assert 1 <= best <= 16 and by_round[best - 1] == min(by_round[: min(16, best + 4)])
    assert model.best_rounds(rest, held.limit(0), 1, most=16, patience=4) == 8


def test_shorter_models_come_from_longer_fits(spark, monkeypatch):
    rows = linkage.documents(spark, SMALL, linkage.Settings(top_k=3, min_idf=1.0), keep=True).labelled.persist()
    held, rest = (rows.where(f"crc32(source1_entity_id) % 3 {x} 0") for x in ("=", "<>"))
    fits, fit = [], model.fit
    monkeypatch.setattr(model, "fit", lambda *a, **k: fits.append(a[2]) or fit(*a, **k))
    rounds, made = model.best_fit(rest, held, 1, most=6, patience=2, minInstancesPerNode=1)
    assert fits == [6] and rounds == model.best_rounds(rest, held, 1, most=6, patience=2, minInstancesPerNode=1)
    p = lambda m: sorted((r[0], r[1], r[2]) for r in model.predict(m, rows).select("source1_entity_id", "candidate_entity_id", "p").collect())
    assert p(made) == p(fit(rest, 1, rounds, minInstancesPerNode=1))
    long = fit(rest, 1, 5, minInstancesPerNode=1)
    assert p(model.first_rounds(long, 3)) == p(fit(rest, 1, 3, minInstancesPerNode=1)) != p(long)


def test_training_shares_lists_with_the_whole(spark, monkeypatch):
    settings, asked = linkage.Settings(top_k=4, min_idf=1.0, n_s1=60, drop_s1=0.25), []
    found = retrieve.retrieve
    monkeypatch.setattr(retrieve, "retrieve", lambda *a: asked.append(a[-1]) or found(*a))
    lists = lambda w: [sorted(map(tuple, getattr(w, x).select(*sorted(getattr(w, x).columns)).collect())) for x in ("forward", "reverse", "edges", "context")]
    work = linkage.documents(spark, SMALL, settings, keep=True)
    alone = lists(work), lists(linkage.training_part(work))
    asked.clear()
    work = linkage.documents(spark, SMALL, settings, keep=True)
    part = linkage.training_part(work)
    linkage.share(work, part)
    assert (lists(work), lists(part)) == alone and alone[1][2]
    # Forward lists and the nearest records of anchors once, reverse lists of each first source.
    assert sorted(asked) == sorted([settings.top_k, settings.siblings + 1, settings.reverse_k, settings.reverse_k])


def test_other_scripts_link(spark):
    names = [("फाइनेंस प्राइवेट", "phainyans praibhet"), ("राम मार्केटिंग", "ram marketing"), ("विजय फूड्स", "vijay foods")]
    skeletons = lambda words: [tuple(r[0]) for r in spark.createDataFrame([(w,) for w in words], "s string").select(T.skeletons(T.tokens(F.col("s")))).collect()]
    assert skeletons([romanise(a) for a, _ in names]) == skeletons([b for _, b in names])
    rows = [(f"S1-{i}", "S1", "India", b.title(), f"{i} MG Road") for i, (_, b) in enumerate(names, 1)] + [(f"S2-{i}", "S2", "India", a, f"{i} एमजी रोड") for i, (a, _) in enumerate(names, 1)]
    rows += [(f"S{1 + i % 2}-{i}", f"S{1 + i % 2}", "India", f"Firm{i} Stores{i}", f"{i} Lane") for i in range(50, 80)]
    records = spark.createDataFrame(rows, "entity_id string, src string, country string, business_name string, business_address string")
    work = linkage.Linkage(records, spark.createDataFrame([("S1-1", "S2-1")], "source1_entity_id string, candidate_entity_id string"), linkage.Settings(top_k=3, min_idf=0.5), keep=True)
    best = {r[0]: r[1] for r in work.forward.where("rank = 1").select("source1_entity_id", "candidate_entity_id").collect()}
    assert {k: best.get(k) for k in ("S1-1", "S1-2", "S1-3")} == {f"S1-{i}": f"S2-{i}" for i in (1, 2, 3)}
    assert {r["entity_id"]: r["nonascii"] for r in work.prepared.select("entity_id", "nonascii").collect() if r["entity_id"] in ("S1-1", "S2-1")} == {"S1-1": False, "S2-1": True}


def test_latin_rows_never_reach_python(spark):
    df = spark.createDataFrame([("S1-1", "Café Ünï", "1 – “Rue”"), ("S1-2", "Москва", None), ("S1-3", None, "한국")], "entity_id string, business_name string, business_address string")
    got = {r["entity_id"]: (r["business_name"], r["business_address"], r["name_nonascii"]) for r in latin_records(df).collect()}
    assert got == {"S1-1": ("Café Ünï", "1 – “Rue”", True), "S1-2": ("Moskva", None, True), "S1-3": (None, "hangug", False)}
    plan = latin_records(df)._jdf.queryExecution().optimizedPlan().toString()
    before, after = plan.split("ArrowEvalPython")[0], plan.split("ArrowEvalPython", 1)[1]
    assert "Filter" in after and "Union" in before


def test_lines_are_numbered_over_blocks(spark, tmp_path):
    lines = [f"S1-{i}\tS2-{i}" if i % 97 else f"broken {i}" for i in range(2, 4000)]
    lines[100] = ""
    (tmp_path / "m.tsv").write_text("\n".join(["source1_entity_id\tmatched_entity_ids", *lines, "source1_entity_id\tx"]) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = quality.read_lists(spark, str(tmp_path / "m.tsv"))
        assert rows.rdd.getNumPartitions() > 5
        got = {r["line"]: (r["entity_id"], r["malformed"]) for r in rows.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    want = {i: (x.split("\t")[0], "\t" not in x) for i, x in enumerate(lines, 2) if x} | {len(lines) + 2: ("source1_entity_id", False)}
    assert got == want


def test_exit_codes_and_bad_files(spark, tmp_path, capsys):
    ids = spark.createDataFrame([("S1-1",)], "entity_id string")
    good, bad, none = tmp_path / "g.tsv", tmp_path / "b.tsv", str(tmp_path / "none.tsv")
    good.write_text("source1_entity_id\tcandidate_entity_ids\nS1-1\tS2-1\n")
    (tmp_path / "m.tsv").write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1\n")
    bad.write_bytes(b"source1_entity_id\tmatched_entity_ids\nS1-1\tS2-\xe9\n")
    assert quality.check_files(spark, str(tmp_path / "m.tsv"), str(good), ids) == 0
    assert quality.check_files(spark, str(bad), str(good), ids) == 1 and "UTF-8: 2" in capsys.readouterr().out
    assert quality.check_files(spark, none, str(good), ids) == 1 and "can't be read" in capsys.readouterr().out


def test_oracle_and_operating_points(spark):
    rows = [("S1-1", f"S2-{i}", i / 1000, int(i % 3 == 0)) for i in range(1, 1000)]
    scored = spark.createDataFrame(rows, "source1_entity_id string, candidate_entity_id string, p double, label int")
    entities = spark.createDataFrame([("S1-1", 333), ("S1-2", 0)], "entity_id string, n_true long")
    assert decide.oracle_f05(scored, entities).first()[0] == 1.0
    positives = sorted(p for *_, p, label in rows if label)
    for r in decide.operating_points(scored, entities, (0.5, 0.9, 0.99)).collect():
        least = positives[int((1 - r["keep"]) * len(positives) + 1e-12)]
        assert r["threshold"] == least and r["per_entity"] == sum(p >= least for _, _, p, _ in rows) / 2
        assert decide.quantile_threshold(scored, r["keep"]).first()["threshold"] == least
    assert measure.entity_counts(spark.createDataFrame([("S1-1",)], "entity_id string"), scored.limit(0)).first()["n_true"] == 0
