"""Operators on single texts, against plain regexes and loops on awkward and random texts."""

import hashlib
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from linkwright.llm import language, licences, lines, packing, personal

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0, "card": 13 <= len(digits) <= 19 and personal.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, *m.span()))
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab@.-+1250 ()%é\n", max_size=60))
def test_base_identifiers_equal_the_patterns(text):
    assert sorted(personal.identifiers(text)) == sorted(plain(text))


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("write john [at] example [dot] com now", "email", "john [at] example [dot] com"), ("mail jane at ex dot co dot uk!", "email", "jane at ex dot co dot uk"), ("user.7 at mail.example.org", "email", "user.7 at mail.example.org"), ("аnna@exаmple.com", "email", "аnna@exаmple.com"),
        ("call plus one five five five one two three four five six", "phone", "plus one five five five one two three four five six"), ("host one dot two dot three three dot four.", "ip", "one dot two dot three three dot four"),
        ("card ４１１１ １１１１ １１１１ １１１１ ok", "card", "４１１１ １１１１ １１１１ １１１１"),
    ],
)
def test_disguises_map_back_to_the_source(text, kind, found):
    _, added = personal.find(text)
    assert [(k, text[s:e]) for k, s, e in added if k == kind] == [(kind, found)]


@pytest.mark.parametrize("text", ["", None, "We looked at the dot on the map.", "one of two or three things at home", "a" * 50_000, "1" * 50_000, "@" * 5_000, "a.b@" * 3000])
def test_clean_and_extreme_texts_have_nothing_added(text):
    base, added = personal.find(text)
    assert added == [] and (text is None or sorted(base) == sorted(personal.identifiers(text)))


@pytest.mark.parametrize("address", ["anna at firma dot dk", "x at site dot pt", "bo at site dot tech", "eva at firma dot co dot it", "li at ex dot museum"])
def test_disguised_addresses_end_in_any_top_domain(address):
    _, added = personal.find(f"write to {address}, please")
    assert [f"write to {address}, please"[s:e] for k, s, e in added if k == "email"] == [address]


@pytest.mark.parametrize("text", ["We stared at every dot on the map.", "He looked at red dot in the sky.", "They are at version two dot five now.", "Look at this dot and that dot and wait."])
def test_dots_in_sentences_are_no_addresses(text):
    assert [s for s in personal.find(text)[1] if s[0] == "email"] == []


def test_added_spans_that_overlap_one_of_the_text_stay():
    text = "write b\u043eb@gmail.com, or call +1 555 123 456\uff17"
    base, added = personal.find(text)
    assert [(k, text[s:e]) for k, s, e in base] == [("email", "b@gmail.com"), ("phone", "+1 555 123 456")]
    assert [(k, text[s:e]) for k, s, e in added] == [("email", "b\u043eb@gmail.com"), ("phone", "+1 555 123 456\uff17")]
    assert personal.masked(text) == "write <EMAIL>, or call <PHONE>"
    assert personal.find("a@b.co [at] c.de")[0] == [("email", 0, 6)]


def test_masks_leave_the_rest():
    text = "mail a@b.co, +1 555 123 4567 or 1.2.3.4."
    assert personal.masked(text) == "mail <EMAIL>, <PHONE> or <IP>." and personal.masked(None) is None and personal.masked("clean") == "clean"


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_hand(text):
    text = text or ""
    words, seen, dup = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    cover = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    failed = len(words) < 10 or 100 * len(cover) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover), failed


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab|# \n\t  \x1c\x85é", max_size=80))
def test_line_counts(text):
    assert lines.clean(text)[:6] == by_hand(text)


def test_line_counts_of_long_texts():
    text = " ".join(str(i % 7001) for i in range(30_000))
    assert lines.clean(text)[:6] == by_hand(text)


@pytest.mark.parametrize(
    ("line", "rule"),
    [("Home | News | Sport | Login", "navigation"), ("buy### now$$$ cheap%%% pills***", "symbols"), ("READ THIS NOW AND BUY IT!!", "shouting"), ("no no no no no no no", "repetition"), ("Accept all cookies", "boilerplate"),
     ("The river rose in spring, and nobody in the village was surprised.", ""), ("Der Fluss stieg im Frühjahr.", ""), ("The river rose in spring and nobody in the village was surprised by", "unfinished"), ("Die Leute am Fluss standen lange da und sahen dem Wasser nach, das kam", "unfinished"),
     ("नदी वसंत में बढ़ी और गाँव में किसी को भी इससे कोई आश्चर्य नहीं हुआ।", ""), ("แม่น้ำ ขึ้น ใน ฤดู ใบไม้ผลิ และ ไม่มี ใคร ใน หมู่บ้าน แปลกใจ เลย สัก คน", ""), ("A heading of a few words", ""), ("一つの文章です。", ""), ("x", "")],
)
def test_line_rules(line, rule):
    assert lines.line_verdict(line, line.split()) == rule


def test_documents_that_lose_too_much_are_rejected():
    good = "The river rose in spring, and nobody in the village was surprised by it at all."
    assert lines.clean(good)[7] and not lines.clean("\n".join(f"a{i} | b{i} | c{i} | d{i}" for i in range(9)))[7]
    assert not lines.clean("\n".join(f"line {i} goes on and on for a good many words without any end to" for i in range(3)))[7]
    kept = lines.clean(good + "\nHome | News | Sport | Login")
    assert kept[7] and kept[8] == good


@pytest.mark.parametrize(
    ("text", "kept"),
    [("!!! ??? ... ;;; ,,,\n((( ))) [[[ ]]] {{{\n====\n'' -- ~~ ++ ==", False), ("Products\nCareers\n\nAbout our team\nContact\nNews\nShop by brand\nHelp", False), ("首页\n产品\n新闻\n招聘\n联系\n关于\n帮助\n登录\n注册\n搜索", False),
     ("Yes!\nHe came.\nNo?\nThey left at once.\n“Why?”\nNobody knows.", True), ("A heading\nThe river rose in spring, and nobody was surprised by it.", True), ("一つの文章です\n二つの文章です\n三つの文章です\n四つの文章です\n五 六 七 八 九 十 百", True),
     ("नमस्ते दुनिया यह एक छोटा वाक्य है और यह दूसरा है।", True)],
)
def test_lines_of_punctuation_and_menus(text, kept):
    n, *_, failed, lost, stays, out = lines.clean(text)
    assert n >= 10 and not failed and stays is kept and (out == text if kept else lost > lines.MAX_LOST)


def test_licence_base_places():
    text = "Under the MIT-license. cc by nc; CC BY-NC under the mit license"
    n, base, labels, score = licences.scan(text)
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.encode().lower())
    assert n == len(words) == 14 and base == [(0, "mit"), (4, "cc-by-nc"), (7, "cc-by-nc"), (10, "mit")] and score == 1.0 and set(labels) == {"mit", "cc-by-nc"}
    assert licences.scan(None) == (0, [], [], 0.0) and licences.scan("K under")[0] == 2


@pytest.mark.parametrize(
    ("text", "label"),
    [("Released under the GNU General Public License, version 3.", "gpl-3"), ("GNU Lesser General Public License v2.1", "lgpl-2.1"), ("SPDX-License-Identifier: MIT", "spdx-mit"), ("licensed under CC BY-SA 4.0", "cc-by-sa"),
     ("distributed under the Mozilla Public License 2.0", "mpl-2"), ("the Boost Software License applies", "boost-1")],
)
def test_licence_rules(text, label):
    assert licences.scan(text)[2] == [label]


def test_hundreds_of_rules_have_keywords_that_their_matches_hold():
    rules = licences.rules()
    assert len(rules) > 300 and all(licences.keywords(r) for r in rules) and [r.priority for r in rules] == sorted((r.priority for r in rules), reverse=True)


def spelled(nodes):
    """Strings that a pattern matches: every branch and every optional part, with and without, once."""
    out = [""]
    for op, arg in nodes:
        name = str(op)
        if name in ("LITERAL", "NOT_LITERAL"):
            own = [chr(arg)] if name == "LITERAL" else ["q"]
        elif name == "IN":
            own = [chr(v if str(k) == "LITERAL" else v[0]) for k, v in arg]
        elif name == "ANY":
            own = ["q"]
        elif name == "BRANCH":
            own = [s for b in arg[1] for s in spelled(b)]
        elif name == "SUBPATTERN":
            own = spelled(arg[3])
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            low, _, inner = arg
            own = [s * n for n in {low, max(low, 1)} for s in spelled(inner)]
        else:
            own = [""]  # boundaries and looks ahead
        own = list(dict.fromkeys(own))
        out = [a + b for a in out for b in own] if len(out) * len(own) <= 2000 else [out[i % len(out)] + own[i % len(own)] for i in range(max(len(out), len(own)))]
    return out


def test_every_alternative_of_a_rule_passes_its_keywords():
    for rule in licences.rules():
        for text in spelled(re._parser.parse(rule.pattern)):
            words = f" {text} "
            if re.search(rule.pattern, words):
                assert any(k in words for k in licences.keywords(rule)) and (not rule.also or any(k in words for k in rule.also)), (rule, words)


@pytest.mark.parametrize(
    ("text", "label"),
    [("this code is epl 2 0", "epl-2"), ("mozilla firefox is mpl 2 0 code", "mpl-2"), ("cddl 1 0", "cddl-1"), ("eupl 1 2", "eupl-1.2"), ("wtfpl", "wtfpl"), ("ncsa", "ncsa"), ("gfdl", "gfdl"), ("the expat license", "mit"),
     ("released under x11", "mit"), ("cc attribution noncommercial", "cc-by-nc"), ("gnu general public license either version 3 of the license or any later version", "gpl-3-or-later")],
)
def test_licences_need_no_word_beside_their_name(text, label):
    assert label in licences.scan(text)[2]


def test_language_learns_and_labels_switches():
    en, de = "the house of the old man stands near the water and the wind blows", "das haus des alten mannes steht nahe dem wasser und der wind weht"
    field = language.train([(en, "en"), (de, "de")] * 5)
    tagger = language.Tagger(field)
    assert [p[0] for p in tagger.predict([en, de, None, "", "123 !", "the house"])] == ["en", "de", "und", "und", "und", "en"]
    mixed = [*en.split()[:6], *de.split()[:6]]
    got = [field.labels[k] for k in tagger.marginals([mixed]).argmax(1)]
    assert got.count("en") in (5, 6, 7) and got == sorted(got, reverse=True)
    assert language.train([]) is None and language.held_out(None) is False


def test_forward_backward_against_enumeration():
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    emit, moves, starts = rng.normal(size=(4, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    want = np.zeros((4, 3))
    for path in itertools.product(range(3), repeat=4):
        w = np.exp(starts[path[0]] + sum(emit[i, k] for i, k in enumerate(path)) + sum(moves[a, b] for a, b in itertools.pairwise(path)))
        for i, k in enumerate(path):
            want[i, k] += w
    got = language.forward_backward(emit, np.array([0]), np.array([4]), moves, starts)[0]
    assert np.allclose(got, want / want.sum(1, keepdims=True))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab 'sé²³12\n\t\x1c\x85 .,日Z", max_size=40))
def test_ids_equal_the_tokenizer(text):
    assert IDS([text])[0] == packing.packed(TOKENIZER.encode(text, add_special_tokens=False).ids + [0])


def setup_module():
    global IDS, TOKENIZER
    from tokenizers import Tokenizer

    IDS = packing.token_maker(packing.default_tokenizer())
    TOKENIZER = Tokenizer.from_file(packing.default_tokenizer())
    TOKENIZER.encode_special_tokens = True


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=12))
def test_plans_pack_everything_without_gaps(counts):
    entries, n = packing.best_plan(counts, 64)
    used: dict = {}
    keys = sorted(entries)
    for length, total in counts.items():
        own = [e for e in keys if e[0] == length]
        for rank in range(total):
            e = [x for x in own if x[1] <= rank][-1]
            used.setdefault(e[3] + (rank - e[1]) % e[2], []).append((e[4] + (rank - e[1]) // e[2] * length, length))
    assert len(used) == n if counts else n == 0
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    tokens = sum(k * v for k, v in counts.items())
    assert n <= 2 * -(-tokens // 64) + 1


def test_cut():
    assert packing.cut(1, 8) == [(0, 1)] and packing.cut(8, 8) == [(0, 8)] and packing.cut(20, 8) == [(0, 4), (4, 8), (12, 8)]
    assert zlib.crc32(packing.packed([0])) == zlib.crc32(b"\0\0\0\0") and hashlib.sha256(b"").hexdigest().startswith("e3b0")


def plainly_suppressed(found):
    stay = []
    for start, end, rule in sorted(found, key=lambda d: (-d[2].priority, d[0] - d[1], d[0], d[2].label)):
        if not any(s <= start and end <= e for s, e, _ in stay):
            stay.append((start, end, rule))
    return sorted(stay, key=lambda d: d[:2])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(1, 20), st.integers(0, 400)), max_size=40))
def test_suppression_against_brute_force(places):
    rules = licences.rules()
    found = [(start, start + size, rules[i]) for start, size, i in places]
    assert licences.suppressed(found) == plainly_suppressed(found)


def test_many_detections_are_settled_in_time():
    import time

    text = " ".join(f"released under the mit license {i} spdx license identifier mit" for i in range(5_000))
    began = time.time()
    assert len(licences.detections(f" {text} ")) == 10_000 and time.time() - began < 3


SIGNED = [
    ("You may not use this file except in compliance with the License.", "apache-2"), ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mpl-2"),
    ("All advertising materials mentioning features or use of this software must display the following acknowledgement:", "bsd-4-clause"), ("https://creativecommons.org/licenses/by-nc-sa/4.0/", "cc-by-nc-sa"),
    ("The Software shall be used for Good, not Evil.", "json"), ("License :: OSI Approved :: ISC License (ISCL)", "isc"), ("https://www.gnu.org/licenses/agpl-3.0.html", "agpl-3"),
]


@pytest.mark.parametrize(("text", "label"), SIGNED)
def test_signatures_of_licences(text, label):
    assert label in licences.scan(text)[2]


def test_licence_query_against_a_plain_scan(spark):
    """Base columns by plain regexes and labels by every rule without gate or intervals, on a whole table."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = spark.createDataFrame([(-i, t) for i, (t, _) in enumerate(SIGNED, 1)] + [(-99, None), (-98, "")], "doc_id long, text string")
    docs = docs.select("doc_id", "text").unionByName(extra)
    got = {r["doc_id"]: r for r in licences.digest(docs).collect()}
    rules = [(r, re.compile(r.pattern)) for r in licences.rules()]
    for row in docs.collect():
        words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (row["text"] or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))))
        words = [w.decode() for w in words]
        places = [(i, label) for phrase, label in licences.BASE.items() for p in [phrase.split()] for i in range(len(words)) if words[i : i + len(p)] == p]
        line = f" {' '.join(words)} "
        left = plainly_suppressed([(m.start(), m.end(), r) for r, p in rules for m in p.finditer(line)])
        labels = {r.label for *_, r in left} | {label for _, label in places}
        own = got[row["doc_id"]]
        assert own["n_words"] == len(words) and own["n_base"] == len(places) and own["labels"] == ",".join(sorted(labels))
        assert own["base_labels"] == ",".join(sorted({x for _, x in places})) and own["score"] == max([r.score for *_, r in left] + [1.0] * bool(places) + [0.0])
        assert (own["first_word"], own["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
