"""Operators on whole tables: awkward rows, brute force, round trips."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from linkwright.llm import common, components, language, licences, lines, mixing, neardup, neighbours, packing, personal, queries, substrings, warc

SMALL = "/root/testdata/sf0.001"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, spans string, component_id string, node int, slot int"
LONG = "The river rose in spring, and nobody in the village was surprised by it at all. " * 40
ROWS = [
    (1, LONG, "en", "a", 3, True, "x", "y", 1, 1), (2, LONG, "en", "a", 3, True, "x", "y", 1, 1), (3, LONG + "More.", "en", "b", 3, None, None, None, None, None), (4, None, None, None, None, None, None, None, None, None),
    (5, "", "en", "", 0, None, None, None, None, None), (None, "nobody knows this row, which has a text of its own and no id", "en", "b", 5, None, None, None, None, None), (7, "one", "de", "b", 3, None, None, None, None, None),
    (7, "one", "de", "b", 3, None, None, None, None, None), (8, "der fluss stieg im fruehling und niemand war ueberrascht", "de", "b", 3, None, None, None, None, None), (9, "mail a@b.co " * 20_000, "en", "c", 3, None, None, None, None, None),
]
DIGESTS = {1: personal.digest, 2: mixing.digest, 3: lines.digest, 4: packing.digest, 5: licences.digest, 6: language.digest, 8: neardup.digest, 10: substrings.digest}


@pytest.mark.parametrize("n", DIGESTS)
def test_awkward_rows(spark, n):
    out = DIGESTS[n](spark.createDataFrame(ROWS, DOCUMENTS)).collect()
    ids = sorted(str(r["doc_id"]) for r in out if n != 4 or r["piece"] == 0)
    assert ids == sorted(str(r[0]) for r in ROWS)


@pytest.mark.parametrize("n", DIGESTS)
def test_empty_tables(spark, n):
    assert DIGESTS[n](spark.createDataFrame([], DOCUMENTS)).collect() == []


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string, row int")


def test_warc_round_trip(spark):
    rows = [(3, "http://a/ü x", "<p>é\r\n\r\nWARC/1.1\r\n</p>", "d", 1), (1, None, "<p>é\r\n\r\nWARC/1.1\r\n</p>", None, None), (2, "http://b/", None, None, None), (4, "http://c/", "", None, None), (5, "u", "own", None, None), (5, "u", "own", None, None), (None, "u", "own", None, None)]
    got = sorted((tuple(r) for r in warc.digest(pages(spark, rows)).collect()), key=str)
    name = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    first: dict = {}
    for page, _, html, *_ in rows:
        if page is not None:
            first[html or ""] = min(page, first.get(html or "", page))
    assert {r[:3] for r in got} == {(p, len((h or "").encode()), name(h)) for p, _, h, *_ in rows}
    assert [r for r in got if r[0] == 3] == [(3, len(rows[0][2].encode()), name(rows[0][2]), "revisit", 1)]
    assert [r[3:] for r in got if r[0] == 1] == [("response", None)] and [r[3:] for r in got if r[0] == 4] == [("revisit", 2)]
    assert sorted(r[3] for r in got if r[0] == 5) == ["response", "revisit"] and [r[3:] for r in got if r[0] is None] == [("revisit", 5)]


def test_empty_archive(spark):
    assert warc.digest(pages(spark, [])).collect() == []


def test_captures_are_assembled(spark, tmp_path):
    warc.write_archive(pages(spark, [(1, "http://a/", "x", None, None)]), str(tmp_path / "w"))
    row = warc.assemble(warc.read_archive(spark, str(tmp_path / "w"))).first()
    assert row["response"]["target_uri"] == "http://a/" and bytes(row["response"]["block"]) == b"x" and row["response"]["block_digest_ok"]
    assert row["request"]["concurrent_to"] == row["metadata"]["concurrent_to"] == row["response"]["record_id"]


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)]
    group = {n: n for e in edges for n in e}

    def top(n):
        while group[n] != n:
            n = group[n]
        return n

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        group[b] = a
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert all(got.get(n, n) == top(n) for n in group)


def families(rng, n, words=60):
    """Families of texts whose members differ by a few words each, so that many pairs lie about the threshold."""
    out = []
    for f in range(n):
        base = [f"w{rng.randrange(400)}" for _ in range(words)]
        for _ in range(12):
            own = list(base)
            for _ in range(rng.randrange(7)):
                own[rng.randrange(words)] = f"x{rng.randrange(10_000)}"
            out.append(" ".join(own))
            base = own if rng.random() < 0.4 else base
    return out


def test_near_duplicates_against_brute_force(spark):
    texts = families(random.Random(3), 12)
    sets = [{tuple(t.split()[i : i + 2]) for i in range(len(t.split()) - 1)} for t in texts]
    least = list(range(len(texts)))
    links = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    for _ in texts:
        for i, j in links:
            least[i] = least[j] = min(least[i], least[j])
    got = neardup.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == dict(enumerate(least))


def test_one_document_of_each_group_stays(spark):
    rows = [*ROWS, (11, LONG, "en", "z", 3, None, None, None, None, None)]
    got = sorted(str(r["doc_id"]) for r in neardup.keep_one(spark.createDataFrame(rows, DOCUMENTS)).collect())
    assert got == sorted(["1", "4", "5", "None", "7", "8", "9"])


def test_an_id_with_two_texts_keeps_the_one_of_its_own(spark):
    other = "A text of its own, which stands nowhere else and would be lost together with the copy of the first one."
    rows = [(1, LONG), (2, LONG), (2, other), (3, other), (4, "four words of another kind of text"), (None, LONG), (5, None), (5, LONG)]
    got = sorted(map(tuple, neardup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(1, LONG), (2, other), (4, "four words of another kind of text"), (None, LONG), (5, None)], key=str)


@pytest.mark.parametrize("length", [40, 400])
def test_repeats_against_brute_force(spark, length):
    rng = random.Random(length)
    passage = "".join(rng.choices("abcdefgh é", k=900))
    texts = ["".join(rng.choices("abcd ", k=rng.randrange(1200))) for _ in range(25)]
    texts += [t[: len(t) // 2] + passage[rng.randrange(300) : rng.randrange(500, 900)] + t[len(t) // 2 :] for t in texts[:12]] + ["a" * 1500, "ab" * 700, "z" * 399, "z" * 399, "", None, "q" * 500, "q" * 500]
    data = [(t or "").encode() for t in texts]
    where: dict = {}
    for d, b in enumerate(data):
        for i in range(len(b) - length + 1):
            where.setdefault(b[i : i + length], []).append((d, i))
    cover = [bytearray(len(b)) for b in data]
    for places in where.values():
        if len(places) > 1:
            for d, i in places:
                cover[d][i : i + length] = b"\1" * length
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in substrings.remove_repeats(docs, length=length).collect()}
    assert {d: bytes(r["kept"]) for d, r in got.items()} == {d: bytes(x for x, c in zip(b, cover[d], strict=True) if not c) for d, b in enumerate(data)}
    # Passages: strings from a trigger on that stand in another text, and strings of the whole length without a trigger.
    size = substrings.anchor(length)
    for d, b in enumerate(data):
        own, others = bytearray(len(b)), [x for x in data if x != b]
        marks = substrings.Text(b).triggers if b else []
        for i in marks:
            if any(b[i : i + size] in x for x in others) and i + size <= len(b):
                own[i : i + size] = b"\1" * size
        for i in range(len(b) - length + 1):
            if not any(i <= m <= i + length - substrings.TRIGGER for m in marks) and any(b[i : i + length] in x for x in others):
                own[i : i + length] = b"\1" * length
        if data.count(b) > 1 and len(b) >= size:
            own = bytearray(b"\1" * len(b))
        spans = [(s["start"], s["end"]) for s in got[d]["passages"]]
        assert spans == [m.span() for m in re.finditer(b"\1+", bytes(own))], d


def test_hot_contexts_give_the_same(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = sorted(map(tuple, substrings.digest(docs).collect()))
    monkeypatch.setattr(substrings, "HOT", 1)
    assert sorted(map(tuple, substrings.digest(docs).collect())) == want


def test_neighbours_recall_and_exact_scores(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1500 + i, x[7].tolist()) for i in range(40)] + [(2000, None), (2100, [0.0] * 16), (2200, [float("nan")] * 16), (2300, []), (None, x[1].tolist()), (2400, [1.0, 2.0])]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("id") % 100 == 0, shard=500).collect()
    every = {i: np.array(v, np.float64) for i, v in rows if i is not None and i < 2000}
    hits = total = 0
    for q in [i for i in every if i % 100 == 0]:
        near = sorted((float(np.sqrt(((v - every[q]) ** 2).sum())), i) for i, v in every.items() if i != q)[:10]
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [r for r, _, _ in own] == list(range(1, 11)) and all(s == pytest.approx(float(np.sqrt(((every[i] - every[q]) ** 2).sum())), abs=0) for _, i, s in own)
        hits += len({i for _, i in near} & {i for _, i, _ in own})
        total += 10
    assert hits / total >= 0.9 and {r["query_id"] for r in got} == {i for i in every if i % 100 == 0}


def test_neighbours_of_an_empty_table(spark):
    assert neighbours.digest(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def served(weights, slots):
    """The sources that run in each slot, by hand: of the released blocks that with the earliest deadline."""
    total, done, out = sum(weights), [0] * len(weights), []
    for t in range(slots):
        due = [(-(-(done[i] + 1) * total // w), i) for i, w in enumerate(weights) if done[i] * total // w <= t]
        out.append(min(due)[1])
        done[out[-1]] += 1
    return out


@pytest.mark.parametrize(
    ("weights", "epoch", "group"),
    [([5, 3, 1], 7, 2), ([974_903_211, 24_482_002, 614_787], 64, 3), ([1] * 17, 5, 4), ([400, *range(1, 20)], 9, 3), ([999_999_000, 997, 2, 1], 16, 5), ([7], 4, 2), ([333, 333, 334, 1, 1, 1, 1, 1], 11, 100)],
)
def test_epochs_give_the_schedule_of_one_run(spark, weights, epoch, group):
    slots = 700
    plan = spark.createDataFrame([(weights, sum(weights), slots)], "w array<long>, total long, slots long")
    got = sorted((r["slot"], r["i"], r["block"]) for r in mixing.schedule(plan, epoch, group).collect())
    want = served(weights, slots)
    assert [i for _, i, _ in got] == want and [s for s, *_ in got] == list(range(slots))
    assert [b for *_, b in got] == [want[:t].count(i) for t, i in enumerate(want)]


def within_a_block(weights, ran):
    total, done = sum(weights), [0] * len(weights)
    for slot, i in enumerate(ran):
        done[i] += 1
        assert all(abs(d * total - (slot + 1) * w) < total for d, w in zip(done, weights, strict=True)), slot


def test_mix_stays_within_a_block_of_its_weights(spark):
    rows = [(i, "abc"[0 if i % 2 else 1 if i % 3 else 2]) for i in range(4000)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string"), weights={"a": 5, "b": 3, "c": 1}, block=4).where("_in_mix")
    slots = sorted((r["_slot"], "abc".index(r["source"])) for r in out.select("_slot", "source").distinct().collect())
    assert [s for s, _ in slots] == list(range(len(slots))) and len(slots) > 800
    within_a_block([5, 3, 1], [i for _, i in slots])


def test_unequal_sources_stay_within_a_block_of_their_unrounded_weights(spark):
    counts = {"a": 1_000_000, "b": 10_000, "c": 100}
    plan = mixing.target_weights(spark.createDataFrame(list(counts.items()), "source string, n long"), None, 8, 0.8)
    row = plan.first()
    due = [n**0.8 / sum(n**0.8 for n in counts.values()) for n in counts.values()]
    assert row["total"] == sum(row["w"]) and all(w / row["total"] == pytest.approx(d, rel=1e-5) for w, d in zip(row["w"], due, strict=True))
    ran = [r["i"] for r in mixing.schedule(plan).orderBy("slot").collect()]
    assert len(ran) == row["slots"] > 20_000
    done = [0, 0, 0]
    for slot, i in enumerate(ran):
        done[i] += 1
        assert all(abs(d - (slot + 1) * x) < 1 for d, x in zip(done, due, strict=True)), slot
    # The rarest source runs out first, in the slot that would run the block it lacks.
    assert done[2] == 14 and ran[-1] == 2 or 2 in ran[-200:]


def test_mixed_documents_are_those_in_the_mix(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = {r["doc_id"] for r in mixing.mix(docs).where("_in_mix").collect()}
    assert {r["doc_id"] for r in mixing.mixed(docs).collect()} == want and 0 < len(want) <= docs.count()


def test_a_rare_source_ends_no_mix(spark):
    rows = [(i, "a" if i % 3 else f"s{i % 5}") for i in range(12_000)] + [(20_000, None), (20_001, "rare"), (20_001, "rare")]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    assert mixing.mix(docs).where("_in_mix").count() < len(rows)
    out = [tuple(r) for r in corpus_pipeline.balance(spark, docs, "").collect()]
    assert sorted(out, key=str) == sorted(rows, key=str)
    slots = {(r["doc_id"], r["source"]): (r["_slot"] is None, r["_slot"] or 0, r["_due"]) for r in mixing.mix(docs).collect()}
    assert [slots[r] for r in out] == sorted(slots[r] for r in out)


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.digest(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert got > 0.97


def test_sequences_hold_their_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = packing.sequences(docs, capacity=512).collect()
    assert all(0 < len(r["ids"]) <= 512 for r in rows)
    total = packing.pieces_of(docs, 512).agg(F.sum("length")).first()[0]
    assert sum(len(r["ids"]) for r in rows) == total and len(rows) <= 1.05 * total / 512 + 1


def test_scratch_leaves_what_is_taken_off_its_list(spark):
    import os

    with common.scratch(spark) as made:
        first, second = common.written(spark.range(3)), common.written(spark.range(5))
        kept, gone = made.pop(), made[0]
    assert second.count() == 5 and os.path.exists(kept) and not os.path.exists(gone) and common.OPEN == []
    common.forget(second)
    assert not os.path.exists(kept) and first is not None


def test_ranks_of_null_keys(spark):
    df = spark.createDataFrame([(k, i) for i, k in enumerate([None, "", "a", None, "", None])], "k string, id int")
    got = {r["id"]: r["r"] for r in common.ranked(df, ["k"], [F.col("id")], F.col("id") % 2, "r").collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: 1, 4: 0, 5: 2}


def test_ranks_within_hot_keys(spark):
    df = spark.range(500).select(F.lit("k").alias("k"), "id")
    got = common.ranked(df, ["k"], [F.col("id")], F.floor(F.col("id") / 100), "r").collect()
    assert all(r["r"] == r["id"] for r in got)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = common.written(stage(spark, before, SMALL))
        assert after.columns == docs.columns, name
        gone = before.count() - after.count()
        assert gone >= 0
        if name == "language":
            assert gone <= 0.01 * docs.count()
        if name == "near_duplicates":
            left = neardup.near_duplicates(after)
            assert gone > 0 and left.where("NOT kept").count() == 0
        if name == "personal_data":
            assert gone == 0 and personal.find_personal_data(after).where(F.size("spans") > 0).count() == 0
            assert after.where(F.col("n_chars") != F.length("text")).count() == 0
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, before, SMALL).collect()
    own = {(p["doc_id"], p["start"]): r["ids"][p["offset"] : p["offset"] + p["length"]] for r in packed for p in r["pieces"]}
    for row in before.collect():  # the redacted text, from its pieces
        ids = [i for start in sorted(s for d, s in own if d == row["doc_id"]) for i in own[row["doc_id"], start]]
        want = TOKENIZER.encode(row["text"], add_special_tokens=False).ids
        assert ids == [*want, 0]


def test_pipeline_on_awkward_rows_and_empty_tables(spark):
    before = spark.createDataFrame(ROWS, DOCUMENTS)
    left = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = common.written(stage(spark, before, SMALL))
        assert after.columns == before.columns
        left.append(sorted(str(r["doc_id"]) for r in after.collect()))
        before = after
    # Null and empty texts have no language; copies go, and of equal rows with one id one stays.
    assert left == [["1", "2", "3", "7", "7", "8", "9", "None"], *[["1", "7", "8", "9", "None"]] * 3]
    packed = corpus_pipeline.STAGES[-1][1](spark, before, SMALL)
    assert {p["doc_id"] for r in packed.collect() for p in r["pieces"]} == {1, 7, 8, 9, None}
    none = spark.createDataFrame([], DOCUMENTS)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SMALL).collect() == [], name


def test_sequences_follow_the_mix(spark, monkeypatch):
    """Sequences by number hold windows of the mixed order, whole and about as full as without it."""
    monkeypatch.setattr(packing, "WINDOW", 100)
    rows = [(i, "word " * (i * 37 % 300), "en", "rare" if i % 10 == 0 else "common", 0) for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    mix = common.written(corpus_pipeline.balance(spark, docs, "").repartitionByRange(7, "doc_id"))  # another order, in several files
    place = {r["doc_id"]: r["_place"] for r in common.with_places(mix, "_place").collect()}
    assert sorted(place.values()) == list(range(1000))
    got = corpus_pipeline.bundle(spark, mix, "").collect()
    windows = [{place[p["doc_id"]] // 100 for p in r["pieces"]} for r in sorted(got, key=lambda r: r["sequence_id"])]
    assert all(len(w) == 1 for w in windows) and [min(w) for w in windows] == sorted(min(w) for w in windows) and len({min(w) for w in windows}) == 10
    assert sorted(p["doc_id"] for r in got for p in r["pieces"]) == list(range(1000)) and len({r["sequence_id"] for r in got}) == len(got)
    assert all(len(r["ids"]) == sum(p["length"] for p in r["pieces"]) <= 2048 for r in got)
    # Without the mix's order before it, packing gives other sequences.
    mixed = common.written(corpus_pipeline.balance(spark, docs, ""))
    contents = lambda rows: {tuple(p["doc_id"] for p in r["pieces"]) for r in rows}
    assert contents(corpus_pipeline.bundle(spark, mixed, "").collect()) != contents(got)


def test_packing_query_against_the_tokenizer(spark):
    """Every id of every whole text stands once, in pieces that fill sequences without gaps, in about as few as can be."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "word " * 9000)], "doc_id long, text string"))
    rows = packing.digest(docs).collect()
    tokens, by_doc, by_sequence = 0, {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for row in docs.collect():
        ids = [*TOKENIZER.encode(row["text"] or "", add_special_tokens=False).ids, 0]
        own = sorted(by_doc.pop(row["doc_id"]), key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and len(own) == -(-len(ids) // 2048)
        at = 0
        for r in own:
            assert r["start"] == at and (r["length"] == 2048 or r["piece"] == 0)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
        tokens += at
    assert not by_doc
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    assert len(by_sequence) <= 1.01 * -(-tokens // 2048) + 1


def test_language_query_against_enumeration(spark):
    """Predictions of the query equal marginals by brute force over all label sequences of short lines."""
    import itertools

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang")
    short = spark.createDataFrame([(-i, t, None) for i, t in enumerate(["the thand er", "de la ciónes\nund der", "einen schen", "!!! 12", "la le\n\nthe the the"], 1)], "doc_id long, text string, lang string")
    field = language.fit(docs)
    got = {r["doc_id"]: r for r in language.predict(docs.unionByName(short), field).collect()}
    k = len(field.labels)
    for row in short.collect():
        total = np.zeros(k)
        for line in row["text"].split("\n"):
            words = language.WORD.findall(line)
            emit = np.array([sum(field.weights[field.index[f]] for f in language.features(w) if f in field.index) + np.zeros(k) for w in words])
            sums, all_ = np.zeros((len(words), k)), 0.0
            for path in itertools.product(range(k), repeat=len(words)) if words else ():
                w = np.exp(field.starts[path[0]] + sum(emit[i, a] for i, a in enumerate(path)) + sum(field.moves[a, b] for a, b in itertools.pairwise(path)))
                all_ += w
                for i, a in enumerate(path):
                    sums[i, a] += w
            total += (sums / all_).sum(0) if words else 0
        own = got[row["doc_id"]]
        if total.any():
            assert own["lang_pred"] == field.labels[int(total.argmax())] and own["score"] == pytest.approx(total.max() / total.sum(), abs=1e-4)
        else:
            assert (own["lang_pred"], own["score"]) == ("und", 0.0)


def setup_module():
    global TOKENIZER
    from tokenizers import Tokenizer

    TOKENIZER = Tokenizer.from_file(packing.default_tokenizer())
    TOKENIZER.encode_special_tokens = True


def test_archives_are_read_in_any_pieces():
    import gzip

    text = "".join(f"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: {len(b)}\r\n\r\n{b}\r\n\r\n" for b in ("", "a\r\n\r\nb", "x" * 300, "WARC/1.1")).encode()
    for data in (text, gzip.compress(text), gzip.compress(text[:200]) + gzip.compress(text[200:])):
        for size in (1, 7, 64, 10_000):
            whole = b"".join(warc.inflated(memoryview(data)))
            assert [b for _, b in warc.parse(whole[i : i + size] for i in range(0, len(whole), size))] == [b"", b"a\r\n\r\nb", b"x" * 300, b"WARC/1.1"]
    for bad in (text[:-3], text[:20], b"no archive\r\n\r\n", gzip.compress(text)[:-20]):
        with pytest.raises(ValueError):
            list(warc.parse(warc.inflated(memoryview(bad))))


def test_common_and_missing_keys_are_looked_up(spark):
    rows = spark.createDataFrame([(i, None if i % 5 == 0 else "hot" if i % 2 else f"k{i % 1500}") for i in range(6000)], "id int, k string")
    counts = {}
    for r in rows.collect():
        counts[r["k"]] = counts.get(r["k"], 0) + 1
    found = spark.createDataFrame([(k, n, f"v{k}") for k, n in counts.items() if k and k != "k2"], "of string, n long, v string")
    got = warc.looked_up(rows, F.col("k"), F.col("id").cast("string"), found).collect()
    assert len(got) == 6000 and all(r["v"] == (None if r["k"] in (None, "k2") else f"v{r['k']}") for r in got)


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Context:
        master = "spark://there:7077"

        def getConf(self):  # noqa: N802
            return {}

    class Session:
        sparkContext, conf = Context(), {}  # noqa: N815

    with pytest.raises(RuntimeError):
        common.shared_folder(Session())


def test_neighbours_over_many_shards(spark):
    """Eight shards of real vectors, against brute force; extra columns with clashing names are not read."""
    rows = [r for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()]
    table = spark.createDataFrame([(r["vec_id"], r["embedding"], 1, "x", 2.0, None) for r in rows], "vec_id long, embedding array<float>, shard int, block string, score double, id long")
    got = neighbours.nearest(table, F.col("id") % 50 == 0, shard=-(-len(rows) // 8)).collect()
    assert neighbours.index(table.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector")), -(-len(rows) // 8)).count() == 8
    x, ids = np.array([r["embedding"] for r in rows], np.float64), np.array([r["vec_id"] for r in rows])
    hits = total = 0
    for q in ids[ids % 50 == 0]:
        gap = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        near = [i for _, i in sorted((g, i) for g, i in zip(gap, ids, strict=True) if i != q)[:10]]
        hits += len(set(near) & {r["vec_id"] for r in got if r["query_id"] == q})
        total += 10
    assert hits / total >= 0.95


def test_the_queries_of_the_ten_operators_are_registered():
    assert {q.split("_")[0] for q in queries.QUERIES} == {"pipeline", *(f"op{n}" for n in range(1, 11))}
