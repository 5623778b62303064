"""Line-first cleaning of texts (operator 3).

Every line is judged by rules for punctuation, navigation and boilerplate. A long line has to end in a mark of its script's
(anything but a letter or digit counts); short lines without one are judged by their neighbours: some in a row are a menu,
while a heading stays. Failing lines are removed, and a document that
loses too much of its text, or keeps too few words, is rejected. Beside that stand base counts of the whole text, of which
two thresholds reject a document outright.

Defined results: a null or empty text has no words, is ``base_failed`` and not kept, and its cleaned text is empty; an
empty table gives an empty table; repeated rows and ids are each treated alone; other columns are not read. The rules read
no language, so a sentence in any script passes. Time and memory are linear in the length of a text.
"""

from __future__ import annotations

import re
from collections import defaultdict
from itertools import count, islice
from operator import eq
from unicodedata import category

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkwright.llm.common import map_text

SPACES, SYMBOLS = " \t\n\v\f\r", "#*$%&|<>"
WINDOW = 5

# Fixed values of the line rules.
MIN_WORDS, MAX_REPEATED = 10, 20  # base: words of a text; percent of its words in repeated windows
MAX_SEPARATORS = 0.25  # navigation: share of words that are separators
MAX_SYMBOLS = 0.25  # symbols a word
MAX_SHOUTING = 0.5  # share of a line's words in capitals, of lines with at least SHOUT_WORDS
SHOUT_WORDS = 6
MAX_SAME_WORD = 0.5  # share of a line's words that follow the same word
MAX_PUNCTUATION = 0.5  # share of a line's characters that are neither letters, digits nor marks of letters
LONG_WORDS = 12  # a line of so many words is prose, which ends in a mark
MENU_LINES, MENU_WORDS = 4, 4  # a menu: lines in a row, apart from blank ones, of so few words and without a mark at the end
MAX_LOST = 0.5  # share of a text's word characters that removed lines may hold
SEPARATORS = frozenset("| » « › ‹ > < / • · – — - ::".split())
NO_MARK = re.compile(r"[^\W_]\Z")
#: Scripts without spaces: each letter counts as a word, as else a sentence would be one.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
#: Scripts that end sentences with a space or nothing: Thai, Lao, Khmer and the like.
NO_MARKS = re.compile("[\u0e00-\u0eff\u1780-\u17ff\u1950-\u19ff]")
SEPARATOR = re.compile(r"[|»«›‹<>/•·–—:-]")
BOILERPLATE = re.compile(
    r"(?i)^\W*(?:accept (?:all )?cookies|all rights reserved|back to top|click here|cookie (?:policy|settings)|copyright\b.{0,40}\b\d{4}"
    r"|enable javascript|follow us|home\b(?: \W)?|javascript (?:is|must be)|log ?in|lorem ipsum|menu|next page|privacy policy|read more"
    r"|related (?:articles|posts)|share (?:on|this)|sign (?:in|up)|skip to (?:main )?content|subscribe\b|terms (?:of (?:use|service)|and conditions))\b.{0,60}$"
)


def punctuated(words: list[str]) -> bool:
    """Whether punctuation and symbols hold more than their share of a line."""
    joined = "".join(words)
    least = (1 - MAX_PUNCTUATION) * len(joined)
    if 2 * sum(map(str.isalnum, words)) > len(words) and sum(len(w) for w in words if w.isalnum()) >= least:
        return False  # quick: most words have nothing else
    return sum(c.isalnum() or category(c)[0] == "M" for c in joined) < least


def like_menu(words: list[str]) -> bool:
    """Whether a line could be an entry of a menu: few words, of which the last ends in a letter or digit."""
    return len(words) <= MENU_WORDS and NO_MARK.search(words[-1]) is not None and sum(max(1, len(UNSPACED.findall(w))) for w in words) <= MENU_WORDS


def line_verdict(line: str, words: list[str]) -> str:
    """'' for a line that stays, else the rule that it breaks. ``words``: those between white space of any kind."""
    n = len(words)
    if punctuated(words):
        return "punctuation"
    if SEPARATOR.search(line) and sum(map(SEPARATORS.__contains__, words)) > MAX_SEPARATORS * n:
        return "navigation"
    if n >= 2 and sum(map(line.count, SYMBOLS)) > MAX_SYMBOLS * n:
        return "symbols"
    if n >= SHOUT_WORDS:
        if sum(len(w) > 1 for w in words if w.isupper()) > MAX_SHOUTING * n:
            return "shouting"
        if len(set(words)) < (1 - MAX_SAME_WORD) * n and sum(map(eq, words, islice(words, 1, None))) > MAX_SAME_WORD * n:
            return "repetition"
    if n <= 12 and BOILERPLATE.match(line):
        return "boilerplate"
    return "unfinished" if n >= LONG_WORDS and NO_MARK.search(words[-1]) and not NO_MARKS.search(line) else ""


def repeated_words(words: list) -> int:
    """Words that lie in a window of WINDOW words found twice or more; exact, as windows get keys without collisions."""
    n, ids = len(words) - WINDOW + 1, defaultdict(count().__next__)
    if n < 2:
        return 0
    at = np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
    if (size := len(ids)) == len(words):
        return 0
    if size < 6000:  # size ** 5 < 2 ** 63
        key = at[:n].copy()
        for i in range(1, WINDOW):
            key *= size
            key += at[i : i + n]
    else:  # pairs get ranks, below the number of words
        pair = np.unique(at[:-1] * size + at[1:], return_inverse=True)[1]
        key = (pair[:n] * len(words) + pair[2 : 2 + n]) * size + at[4 : 4 + n]
    order = np.sort(key)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    starts = np.isin(key, twice)
    cover = np.zeros(len(words), bool)
    for i in range(WINDOW):
        cover[i : i + n] |= starts
    return int(cover.sum())


def clean(text: str | None) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lost share, kept, cleaned text)."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes are split at exactly the six ASCII white space characters
    n, chars = len(words), len(text) - sum(map(text.count, SPACES))
    lines = text.split("\n")
    seen: set[str] = set()
    stay, n_dup, lost = [], 0, 0
    menu: list[tuple[int, list[str]]] = []  # the run of entries so far: places in stay, words

    def end_menu() -> int:
        gone = 0
        if len(menu) >= MENU_LINES:
            for at, own in menu:
                stay[at] = None
                gone += sum(map(len, own))
        menu.clear()
        return gone

    for line in lines:
        if own := line.split():
            if line in seen:
                n_dup += 1
            else:
                seen.add(line)
            if line_verdict(line, own):
                lost += sum(map(len, own))
                continue
            if like_menu(own):
                menu.append((len(stay), own))
            elif menu:
                lost += end_menu()
        elif line.strip("".join(SPACES)):  # a word of white space of other kinds
            n_dup += line in seen
            seen.add(line)
        stay.append(line)
    lost += end_menu()
    repeat = repeated_words(words)
    failed = n < MIN_WORDS or 100 * repeat > MAX_REPEATED * n
    share = min(1.0, lost / chars) if chars else 0.0
    return n, chars, sum(map(text.count, SYMBOLS)), n_dup, repeat, failed, share, not failed and share <= MAX_LOST, "\n".join(line for line in stay if line is not None)


def clean_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, the base counts, base_failed, lost_share, kept and the cleaned text."""
    return map_text(
        docs, lambda: lambda texts: [clean(t) for t in texts],
        "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, lost_share double, kept boolean, clean_text string",
        id_col, text_col,
    )


def digest(docs: DataFrame) -> DataFrame:
    """What the query op3 returns."""
    return clean_lines(docs).withColumn("clean_sha256", F.sha2("clean_text", 256)).drop("clean_text")
