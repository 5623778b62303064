"""Personal data in texts (operator 1): offset-preserving deobfuscation.

Identifiers are first taken from the text as it stands. Then transducers rewrite homoglyphs, foreign digits, invisible
characters, spelled digits and disguised ``@`` and ``.`` into plain ASCII, keeping for every rewritten piece its place in
the source; identifiers of the normalised text that touch a rewritten piece are mapped back to source characters and added, unless one
of the text as it stands holds them. Spans that overlap are masked as one.

Defined results: a null text counts as empty (no spans); an empty table gives an empty table; repeated rows and ids are
each treated alone; null ids stay null; other columns are not read by ``find_personal_data`` and kept by
``mask_personal_data``. Every text is read whole, in time linear in its length.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from operator import and_, itemgetter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkwright.llm.common import map_text, once, small_batches

KINDS = ("email", "ip", "card", "phone")
MASKS = {"email": "<EMAIL>", "ip": "<IP>", "card": "<CARD>", "phone": "<PHONE>"}

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits that fails from its first digit fails from every other, so only its first is tried.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NON_DIGIT = str.maketrans("", "", " -+().")

# Letters of other scripts that look like Latin ones, and digits as words.
LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ι": "i", "ρ": "p", "ɡ": "g", "ı": "i", "ℓ": "l", "․": ".", "。": ".", "∙": ".",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-",
}
SPELLED = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
EDGE = ".,;:!?()[]{}<>\"'"
INVISIBLE = "­​‌‍⁠﻿"

_DIGIT = "(?:" + "|".join(sorted(SPELLED, key=len, reverse=True)) + ")"
_OPEN, _CLOSE = r"\s{0,9}[\[({<]\s{0,9}", r"\s{0,9}[\])}>]\s{0,9}"
_DOT_WORD = r"(?:dot|punto|punkt|point)"
_DOT = rf"(?:{_OPEN}(?:{_DOT_WORD}|\.){_CLOSE}|\s{{1,9}}dot\s{{1,9}})"
DIGIT_WORD = re.compile(rf"\b{_DIGIT}\b", re.I)
DIGIT_RUN = re.compile(rf"\b{_DIGIT}(?:[\s-]{{1,9}}{_DIGIT})+\b|\b{_DIGIT}(?={_DOT})|(?<=dot ){_DIGIT}\b", re.I)
# Top domains that end an address of real dots whose @ is a plain word; ones that are common words are left out.
TOP = "com|net|org|edu|gov|mil|int|info|biz|io|ai|dev|app|eu|uk|de|fr|es|nl|ca|au|ch|br|cn|jp|pl|ru|se|mx|ar|co"
# Words before "dot" that make it a noun, words after it that are no top domain, and top domains that are words
# of a sentence as well, which end an address only where no word follows.
NOUN = "the|a|an|this|that|each|every|any|one|which|what|my|our|your|his|her|its|their|another|some|no"
PROSE = "on|and|or|of|the|that|which|with|was|were|are|has|had|from|where|when|then|but|if|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety"
BOTH = "in|is|it|to|at|be|no|me|us|so|my|am|by|as|an|do"
_TOP = rf"(?!(?:{PROSE}|{_DIGIT})\b)(?!(?:{BOTH})\s{{1,9}}\w)[A-Za-z]{{2,63}}\b"
_LABELS = rf"(?!(?:{NOUN})\s)[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}}){{0,4}}{_DOT}{_TOP}"
_LOCAL = r"(?<=[0-9._%+-])"  # before a plain word and real dots: a local part that is no word
AT_SIGN = re.compile(
    rf"{_OPEN}(?:at|arroba|@){_CLOSE}|\s{{1,9}}(?:at|arroba)\s{{1,9}}(?={_LABELS})|{_LOCAL}\s{{1,9}}at\s{{1,9}}(?=(?:[A-Za-z0-9-]{{1,63}}\.){{1,4}}(?:{TOP})\b)", re.I
)
DOT_SIGN = re.compile(rf"(?<=[A-Za-z0-9]){_DOT}(?=[A-Za-z0-9])", re.I)
PLUS_SIGN = re.compile(rf"\bplus\s{{1,9}}(?=[0-9(]|{_DIGIT}\b)", re.I)
# What a text must hold for a rewrite to be possible at all; these are quick to look for.
MAYBE_ODD = re.compile("[\xad\u0131\u0261\u0370-\U0010ffff]")
MAYBE_IP = re.compile(r"[0-9]\.[0-9]+\.")
PLAIN_AT = re.compile(r"[0-9._%+-]\sat\s")
TELL_DOT, TELL_AT = ("dot", "punto", "punkt", "point"), re.compile(r"[\[({<]\s{0,9}(?:at|arroba|@|\.)\s{0,9}[\])}>]", re.I)


@once
def odd_characters() -> dict[str, str]:
    """Characters with a plain ASCII reading: look-alikes, wide and styled forms, decimal digits of any script, invisible ones."""
    plain = set("@.+-_%()") | {c for c in map(chr, range(128)) if c.isalnum()}
    table = dict(LOOKALIKES) | dict.fromkeys(INVISIBLE, "")
    for code in (*range(0x600, 0x2000), *range(0x2100, 0x2500), *range(0xA600, 0xAC00), *range(0xFE50, 0x10000), *range(0x10400, 0x1FC00)):
        c = chr(code)
        if (digit := unicodedata.decimal(c, None)) is not None:
            table[c] = str(digit)
        elif unicodedata.decomposition(c).startswith(("<wide>", "<font>", "<circle>", "<small>")) and (to := unicodedata.normalize("NFKC", c)) in plain:
            table[c] = to
    return table


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def identifiers(text: str) -> list[tuple[str, int, int]]:
    """The identifiers of a text as it stands: leftmost, non-overlapping within a kind."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            found.append(("email", start, end := m.end()))
        else:
            end = max(end, at)  # what stands before a failed @ cannot be part of a later local part
        at = text.find("@", max(at + 1, end))
    for m in IP.finditer(text) if MAYBE_IP.search(text) else ():
        if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := m[0].translate(NON_DIGIT)) <= 19 and luhn(d):
            found.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(m[0].translate(NON_DIGIT)) <= 15:
                found.append(("phone", *m.span()))
    return found


class Transduced:
    """A text under rewrites, with the source place of every piece."""

    def __init__(self, text: str, rewrites: list[tuple[int, int, str]]) -> None:
        pieces, self.starts, self.sources, self.copied = [], [], [], []
        done = size = 0
        for start, end, to in rewrites:
            for piece, begin, stop, copied in ((text[done:start], done, start, True), (to, start, end, False)):
                if piece or not copied:
                    self.starts.append(size)
                    self.sources.append((begin, stop))
                    self.copied.append(copied)
                    pieces.append(piece)
                    size += len(piece)
            done = end
        self.starts.append(size)
        self.sources.append((done, len(text)))
        self.copied.append(True)
        self.text = "".join([*pieces, text[done:]])

    def source(self, start: int, end: int) -> tuple[int, int, bool]:
        """The source span of a span here, and whether it touches a rewritten piece."""
        i, j = bisect_right(self.starts, start) - 1, bisect_right(self.starts, end - 1) - 1
        begin = self.sources[i][0] + (start - self.starts[i] if self.copied[i] else 0)
        stop = self.sources[j][0] + end - self.starts[j] if self.copied[j] else self.sources[j][1]
        return begin, stop, not all(self.copied[i : j + 1])


def spells_digits(low: str) -> bool:
    """Whether two digit words may stand together, or one beside a dot word."""
    words = low.replace("-", " ").split()
    if SPELLED.keys().isdisjoint(words):
        return False
    near = [w.strip(EDGE) in SPELLED for w in words]
    return any(map(and_, near, near[1:])) or any(a and b in TELL_DOT for a, b in zip(near, words[1:], strict=False))


def rewrites(text: str) -> list[tuple[int, int, str]]:
    """Non-overlapping rewrites in order of place: (start, end, replacement)."""
    found: list[tuple[int, int, str]] = []
    if not text.isascii():
        table = odd_characters()
        found += [(m.start(), m.end(), table[m[0]]) for m in MAYBE_ODD.finditer(text) if m[0] in table]
    low = text.lower()
    dots = any(map(low.__contains__, TELL_DOT))
    if dots or TELL_AT.search(text) or PLAIN_AT.search(low):
        found += [(*m.span(), "@") for m in AT_SIGN.finditer(text)]
        found += [(*m.span(), ".") for m in DOT_SIGN.finditer(text)]
    runs = list(DIGIT_RUN.finditer(text)) if spells_digits(low) else []
    for run in runs:
        words = list(DIGIT_WORD.finditer(text, *run.span()))
        for i, m in enumerate(words):  # the gap after a digit goes with it
            found.append((m.start(), words[i + 1].start() if i + 1 < len(words) else m.end(), SPELLED[m[0].lower()]))
    if "plus" in low:
        found += [(*m.span(), "+") for m in PLUS_SIGN.finditer(text)]
    out, end = [], 0
    for r in sorted(found, key=lambda r: (r[0], -r[1])):
        if r[0] >= end:
            out.append(r)
            end = r[1]
    return out


def find(text: str | None) -> tuple[list, list]:
    """(base spans, added spans), each a list of (kind, start, end) in code points."""
    text = text or ""
    base, added = identifiers(text), []
    if changes := rewrites(text):
        view = Transduced(text, changes)
        own = {k: [(s, e) for kind, s, e in base if kind == k] for k in KINDS}  # by rising start, and apart
        for kind, start, end in identifiers(view.text):
            begin, stop, touched = view.source(start, end)
            at = bisect_right(own[kind], begin, key=itemgetter(0)) - 1
            if touched and not (at >= 0 and stop <= own[kind][at][1]):
                added.append((kind, begin, stop))
    return base, added


def joined(spans: list) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2])))


def masked(text: str | None) -> str | None:
    """The text with every span replaced by its kind's mark; where spans overlap, they are one, marked as the first."""
    if text is None:
        return None
    base, added = find(text)
    out, done = [], 0
    for kind, start, end in sorted(base + added, key=lambda s: (s[1], -s[2])):
        if start >= done:
            out += [text[done:start], MASKS[kind]]
        done = max(done, end)
    return "".join([*out, text[done:]]) if out else text


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id and spans array<struct<kind, start, end, added>>, by kind as in KINDS and then start."""

    def make():
        def work(texts):
            out = []
            for text in texts:
                base, added = find(text)
                both = [(*s, False) for s in base] + [(*s, True) for s in added]
                both.sort(key=lambda x: (KINDS.index(x[0]), x[1], x[2]))
                out.append(([dict(zip(("kind", "start", "end", "added"), s, strict=True)) for s in both],))
            return out

        return work

    return map_text(docs, make, "spans array<struct<kind:string,start:bigint,end:bigint,added:boolean>>", id_col, text_col)


def mask_personal_data(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with every span of its texts replaced by a mark of its kind; ``length_col``, if there, counts the new text."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def mask(texts):
        return texts.map(masked)

    out = docs.withColumn(text_col, mask(F.col(text_col).cast("string")))
    if length_col in docs.columns:
        out = out.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType))
    return out.select(*docs.columns)


def digest(docs: DataFrame) -> DataFrame:
    """What the query op1 returns, from the spans of ``find_personal_data``.

    The counts by kind and base_sha256 are of base spans, n_spans is of all.
    """
    found = find_personal_data(docs)
    base = F.filter("spans", lambda s: ~s["added"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    every, added = F.size("spans").cast("long").alias("n_spans"), F.size(F.filter("spans", lambda s: s["added"])).cast("long").alias("n_added")
    return found.select("doc_id", *map(count, KINDS), F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"), every, added)


def reference(text: str | None) -> tuple:
    """The same by hand, for tests: (base, all) as joined strings."""
    base, added = find(text)
    return hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + added)
