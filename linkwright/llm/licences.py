"""Licence scans (operator 5): ordered signature rules.

A text becomes its lower-case words, one space apart. The rules are signatures of single licences, written by hand, and the
licences' names in the ways in which texts name them. An automaton of keywords finds which of the rules may match at all;
only those run. Overlapping detections are settled by priority: a detection that lies within one of at least
its priority (or of higher priority with equal bounds) is suppressed. Three fixed phrases are always found as base labels.

Defined results: a null or empty text has no words and no labels, score 0; an empty table gives an empty table; repeated
rows and ids are each treated alone; other columns are not read. Whole texts are scanned, in linear time for the gate.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from typing import NamedTuple

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkwright.llm.common import map_text, once
from linkwright.llm.signatures import SIGNATURES

#: Bytes of words stay (A-Z in lower case), others become spaces; bytes of non-ASCII characters belong to words.
TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

# Phrases and labels of the base.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


class Rule(NamedTuple):
    label: str
    priority: int
    score: float
    keyword: str  # the text must hold it
    pattern: str  # over words that stand one space apart
    also: tuple[str, ...] = ()  # and one of these, if there are any


# Label, keyword, the licence's names as patterns over words. Where no keyword is given, see SEVERAL.
NAMES = [
    ("mit", "", r"(?:mit|expat|x11)"),
    ("mit-0", "mit ", r"mit (?:0|no attribution)"),
    ("apache-2", "apache", r"apache(?: software)?(?: licen[cs]e)?(?: version| v)? ?2(?: 0)?"),
    ("apache-1.1", "apache", r"apache(?: software)?(?: licen[cs]e)?(?: version| v)? ?1 1"),
    ("apache-1.0", "apache", r"apache(?: software)?(?: licen[cs]e)?(?: version| v)? ?1 0"),
    ("bsd-2-clause", "bsd", r"(?:simplified bsd|freebsd|bsd 2 clause|2 clause bsd|two clause bsd)"),
    ("bsd-3-clause", "bsd", r"(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd)"),
    ("bsd-4-clause", "bsd", r"(?:original bsd|bsd 4 clause|4 clause bsd|four clause bsd)"),
    ("0bsd", "bsd", r"(?:0bsd|zero clause bsd|bsd zero clause)"),
    ("gpl-1", "", r"(?:gnu general public licen[cs]e|gnu gpl|gpl)(?: version| v)? ?v?1(?: 0)?"),
    ("gpl-2", "", r"(?:gnu general public licen[cs]e|gnu gpl|gpl)(?: version| v)? ?v?2(?: 0)?"),
    ("gpl-3", "", r"(?:gnu general public licen[cs]e|gnu gpl|gpl)(?: version| v)? ?v?3(?: 0)?"),
    ("gpl", "", r"(?:gnu general public licen[cs]e|gnu gpl|gpl)"),
    ("lgpl-2", "", r"(?:gnu library general public licen[cs]e|gnu lgpl|lgpl)(?: version| v)? ?v?2(?: 0)?"),
    ("lgpl-2.1", "", r"(?:gnu lesser general public licen[cs]e|gnu lgpl|lgpl)(?: version| v)? ?v?2 1"),
    ("lgpl-3", "", r"(?:gnu lesser general public licen[cs]e|gnu lgpl|lgpl)(?: version| v)? ?v?3(?: 0)?"),
    ("lgpl", "", r"(?:gnu (?:lesser|library) general public licen[cs]e|gnu lgpl|lgpl)"),
    ("agpl-3", "", r"(?:gnu affero general public licen[cs]e|affero gpl|gnu agpl|agpl)(?: version| v)? ?v?3(?: 0)?"),
    ("agpl", "", r"(?:gnu affero general public licen[cs]e|affero gpl|gnu agpl|agpl)"),
    ("gfdl", "", r"(?:gnu free documentation licen[cs]e|gfdl)"),
    ("mpl-1.1", "", r"(?:mozilla public licen[cs]e|mpl)(?: version| v)? ?1 1"),
    ("mpl-2", "", r"(?:mozilla public licen[cs]e|mpl)(?: version| v)? ?2(?: 0)?"),
    ("epl-1", "", r"(?:eclipse public licen[cs]e|epl)(?: version| v)? ?1(?: 0)?"),
    ("epl-2", "", r"(?:eclipse public licen[cs]e|epl)(?: version| v)? ?2(?: 0)?"),
    ("eupl-1.2", "", r"(?:european union public licen[cs]e|eupl)(?: version| v)? ?1 2"),
    ("cddl-1", "", r"(?:common development and distribution licen[cs]e|cddl)(?: version| v)? ?1(?: 0)?"),
    ("cpl-1", "common public", r"common public licen[cs]e(?: version| v)? ?1(?: 0)?"),
    ("cecill-2.1", "cecill", r"cecill(?: version| v)? ?2 1"),
    ("isc", "isc", r"isc"),
    ("zlib", "zlib", r"zlib(?: libpng)?"),
    ("boost-1", "boost", r"boost software licen[cs]e(?: version| v)?(?: ?1(?: 0)?)?"),
    ("unlicense", "unlicense", r"unlicense"),
    ("wtfpl", "", r"(?:do what the fuck you want to public licen[cs]e|wtfpl)"),
    ("artistic-1", "artistic", r"artistic licen[cs]e(?: version| v)? ?1(?: 0)?"),
    ("artistic-2", "artistic", r"artistic licen[cs]e(?: version| v)? ?2(?: 0)?"),
    ("python-2", "", r"(?:python software foundation licen[cs]e|psf licen[cs]e)(?: version| v)?(?: ?2(?: 0)?)?"),
    ("php-3.01", "php", r"php licen[cs]e(?: version| v)? ?3 01"),
    ("ruby", "ruby", r"ruby licen[cs]e"),
    ("vim", "vim", r"vim licen[cs]e"),
    ("openssl", "openssl", r"openssl licen[cs]e"),
    ("postgresql", "postgresql", r"postgresql licen[cs]e"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa(?: open source licen[cs]e)?"),
    ("ms-pl", "microsoft", r"microsoft public licen[cs]e"),
    ("ms-rl", "microsoft", r"microsoft reciprocal licen[cs]e"),
    ("osl-3", "open software", r"open software licen[cs]e(?: version| v)? ?3(?: 0)?"),
    ("afl-3", "academic", r"academic free licen[cs]e(?: version| v)? ?3(?: 0)?"),
    ("ofl-1.1", "font", r"(?:sil )?open font licen[cs]e(?: version| v)?(?: ?1 1)?"),
    ("odbl-1", "database", r"open (?:data commons open )?database licen[cs]e(?: version| v)?(?: ?1(?: 0)?)?"),
    ("odc-by-1", "data commons", r"open data commons attribution licen[cs]e(?: version| v)?(?: ?1(?: 0)?)?"),
    ("pddl-1", "data commons", r"open data commons public domain dedication(?: and licen[cs]e)?"),
    ("upl-1", "universal", r"universal permissive licen[cs]e(?: version| v)?(?: ?1(?: 0)?)?"),
    ("blueoak-1", "blue oak", r"blue oak model licen[cs]e(?: 1 0 0)?"),
    ("busl-1.1", "business", r"business source licen[cs]e(?: version| v)?(?: ?1 1)?"),
    ("sspl-1", "server side", r"server side public licen[cs]e(?: version| v)?(?: ?1(?: 0)?)?"),
    ("elastic-2", "elastic", r"elastic licen[cs]e(?: version| v)? ?2(?: 0)?"),
    ("openrail-m", "rail", r"(?:creativeml )?open ?rail m?"),
    ("cc0-1", "", r"(?:cc0|cc zero|creative commons zero)(?: ?1 0)?(?: universal)?"),
    ("cc-by-nc-nd", "", r"(?:cc|creative commons) (?:by nc nd|attribution non ?commercial no ?deriv(?:ative)?s)"),
    ("cc-by-nc-sa", "", r"(?:cc|creative commons) (?:by nc sa|attribution non ?commercial share ?alike)"),
    ("cc-by-nc", "", r"(?:cc|creative commons) (?:by nc|attribution non ?commercial)"),
    ("cc-by-nd", "", r"(?:cc|creative commons) (?:by nd|attribution no ?deriv(?:ative)?s)"),
    ("cc-by-sa", "", r"(?:cc|creative commons) (?:by sa|attribution share ?alike)"),
    ("cc-by", "", r"(?:cc|creative commons) (?:by|attribution)"),
]
# Keywords of licences whose names share none; one of them has to be there.
SEVERAL = {
    "mit": ("mit", "expat", "x11"), "gfdl": ("gfdl", "free documentation"),
    "gpl": ("gpl", "general public"), "lgpl": ("lgpl", "general public"), "agpl": ("agpl", "affero"), "mpl": ("mpl", "mozilla"), "epl": ("epl", "eclipse"),
    "eupl": ("eupl", "european union"), "cddl": ("cddl", "common development"), "wtfpl": ("wtfpl", "what the fuck"), "python": ("python software", "psf licen"),
    "cc": ("cc by", "cc attribution", "creative commons"), "cc0": ("cc0", "cc zero", "creative commons zero"),
}
# How a licence is named; {} is the name. Priority, score, literals of which each match holds one, pattern.
FORMS = [
    (70, 0.95, (" under ",), r"(?:licen[cs]ed|released|distributed|available|provided|published|shared|covered|redistributable|free) under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?{}(?: international)?(?: licen[cs]e)?\b"),
    (60, 0.9, ("subject to", "governed by", "accordance with", "compliance with", "accept", "according to"), r"(?:subject to|governed by|in accordance with|in compliance with|accept(?:ed)?|according to) (?:the )?(?:terms (?:and conditions )?of )?(?:the )?{}(?: licen[cs]e)?\b"),
    (50, 0.8, ("licen",), r"licen[cs]e (?:is )?(?:the )?{}(?: licen[cs]e)?\b"),
    (40, 0.7, ("licen",), r"(?:the )?{} licen[cs]e[ds]?\b"),
    (30, 0.6, ("licen",), r"dual licen[cs]ed (?:under|with) (?:the )?(?:[a-z0-9]+ ){{0,4}}(?:and|or) (?:the )?{}\b"),
]


def rules() -> list[Rule]:
    """All rules by falling priority; ties in the order of the tables, specific licences before general ones."""
    made = [Rule(label, priority - (label in ("gpl", "lgpl", "agpl", "cc-by")), score, keyword, form.format(name), also) for priority, score, also, form in FORMS for label, keyword, name in NAMES]
    named = [Rule(label, 20, 0.5, keyword, rf"\b{name}\b") for label, keyword, name in NAMES if "licen" in name or label.startswith(("cc-", "cc0"))]  # names that say it themselves
    return sorted([*(Rule(*own) for own in SIGNATURES), *made, *named], key=lambda r: -r.priority)


@once
def scanner() -> tuple:
    every = rules()
    gate = ahocorasick.Automaton()
    by_word: dict[str, list[int]] = {}
    for i, r in enumerate(every):
        for word in keywords(r):
            by_word.setdefault(word, []).append(i)
        for word in r.also:
            by_word.setdefault(word, [])
    for word, which in by_word.items():
        gate.add_word(word, (word, tuple(which)))
    gate.make_automaton()
    return every, gate, [re.compile(r.pattern) for r in every]


def keywords(rule: Rule) -> tuple[str, ...]:
    """The literals of which a text must hold one for the rule to match."""
    return (rule.keyword,) if rule.keyword else SEVERAL[rule.label.split("-")[0]]


def detections(words: str) -> list[tuple[int, int, Rule]]:
    """Detections that are left after suppression, in order of place."""
    every, gate, patterns = scanner()
    hits = {hit for _, hit in gate.iter(words)}
    held = {word for word, _ in hits}
    which = sorted({i for _, own in hits for i in own if not every[i].also or not held.isdisjoint(every[i].also)})
    found = [(m.start(), m.end(), every[i]) for i in which for m in patterns[i].finditer(words)]
    return suppressed(found)


def suppressed(found: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """The detections that lie within none of at least their priority, in order of place.

    Detections come by falling priority and length. Of those that stay, the ones that no other holds have rising starts and
    rising ends, so the last of them that starts in time is the only one that can hold the next.
    """
    stay: list[tuple[int, int, Rule]] = []
    starts: list[int] = []
    ends: list[int] = []
    for start, end, rule in sorted(found, key=lambda d: (-d[2].priority, d[0] - d[1], d[0], d[2].label)):
        at = bisect_right(starts, start)
        if at and ends[at - 1] >= end:
            continue
        stay.append((start, end, rule))
        first = bisect_left(starts, start)
        last = bisect_right(ends, end, lo=first)  # those from first to last lie within this one
        starts[first:last], ends[first:last] = [start], [end]
    return sorted(stay, key=lambda d: d[:2])


def scan(text: str | None) -> tuple:
    """(n_words, places of base phrases as (word, label), labels, score)."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(TO_WORDS).split()
    line = b" " + b" ".join(words) + b" "
    base = []
    for phrase, label in BASE.items():
        key, at = b" " + phrase.encode() + b" ", -1
        while (at := line.find(key, at + 1)) >= 0:
            base.append((line.count(b" ", 0, at), label))
    labels, score = {label for _, label in base}, 1.0 if base else 0.0
    for _, _, rule in detections(line.decode("utf-8", "replace")):
        labels.add(rule.label)
        score = max(score, rule.score)
    return len(words), sorted(base), sorted(labels), score


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, base places array<struct<word, label>>, all labels, score."""

    def make():
        def work(texts):
            return [(n, [{"word": w, "label": x} for w, x in base], labels, score) for n, base, labels, score in map(scan, texts)]

        return work

    return map_text(docs, make, "n_words bigint, base array<struct<word:bigint,label:string>>, labels array<string>, score double", id_col, text_col)


def digest(docs: DataFrame) -> DataFrame:
    """What the query op5 returns."""
    return scan_licences(docs).select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min("base.word").alias("first_word"), F.array_max("base.word").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("base.label")), ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score",
    )
