"""Column functions for names and addresses: cleaning, normal tokens, phonetic skeletons, canonical address words.

All of them are built-in expressions, so they stay inside whole-stage code generation. Rewrites of single tokens are
made on the joined tokens of a record, so a record costs one pass a rule however many tokens it has.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# First-generation cleaning expands these words, in this order.
ABBREVIATIONS = {
    "co": "company", "inc": "incorporated", "corp": "corporation", "ltd": "limited", "pvt": "private", "llc": "limited liability company",
    "st": "street", "rd": "road", "ave": "avenue", "blvd": "boulevard", "dr": "drive", "ln": "lane", "ct": "court", "sq": "square", "pl": "place",
    "hwy": "highway", "ste": "suite", "apt": "apartment", "fl": "floor",
}
# Phonetic rewrites, in this order; vowels and h go last, then repeats collapse.
PHONETIC = [
    ("tion", "sn"), ("gh", ""), (r"ng\b", "n"), ("ph", "f"), ("bh", "b"), ("kh", "k"), ("dh", "d"), ("th", "t"), ("sh", "s"), ("ck", "k"),
    ("c(?=[eiy])", "s"), ("[cq]", "k"), ("x", "ks"), ("[vw]", "b"), ("g", "j"), ("z", "j"), ("m", "n"), ("[aeiouyh]", ""),
]
# Words that carry no identity, legal forms, and the short forms of address words.
NAME_STOP = ["the", "and", "of", "dba", "formerly"]
LEGAL = [
    "pvt", "private", "ltd", "limited", "llc", "inc", "incorporated", "co", "company", "corp", "corporation", "llp", "pllc", "lp", "plc", "pc", "pa",
    "the", "and", "of", "sas", "sarl", "sa", "sasu", "eurl", "sci", "com", "www", "dba", "formerly",
]
ADDRESS = {
    "street": "st", "road": "rd", "avenue": "ave", "boulevard": "blvd", "drive": "dr", "lane": "ln", "court": "ct", "place": "pl", "highway": "hwy",
    "suite": "ste", "apartment": "apt", "floor": "fl", "near": "nr", "opposite": "opp",
}
ADDRESS_PAIR = ADDRESS | {
    "r": "rue", "bd": "blvd", "blv": "blvd", "av": "ave", "imp": "impasse", "ch": "chemin", "che": "chemin", "rte": "route", "fg": "faubourg",
    "fbg": "faubourg", "sq": "square", "saint": "st", "sainte": "st", "all": "allee", "pl": "pl", "place": "pl", "qu": "quai",
}
# Number words. Cardinals and ordinals from 0 to 19, and the tens.
CARDINALS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
ORDINALS = "zeroth first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth thirteenth fourteenth fifteenth sixteenth seventeenth eighteenth nineteenth".split()
TENS = {
    "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90, "twentieth": 20, "thirtieth": 30,
    "fortieth": 40, "fiftieth": 50, "sixtieth": 60, "seventieth": 70, "eightieth": 80, "ninetieth": 90,
}
SMALL = {w: i for words in (CARDINALS, ORDINALS) for i, w in enumerate(words)}
NUMBER_WORDS = {w: str(i) for words in (CARDINALS, ORDINALS) for i, w in enumerate(words) if 1 <= i <= 10}
PLAIN_WORDS = ["zero", "zeroth", "one", "first", "second"]  # too often not a number
WIDE = {"ß": "ss", "æ": "ae", "œ": "oe", "Æ": "AE", "Œ": "OE", "þ": "th", "Þ": "TH"}


def latin_table() -> tuple[str, str]:
    """Accented Latin letters and their bases, from Unicode's own decompositions."""
    pairs = [(c, unicodedata.normalize("NFD", c)[0]) for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)])]
    pairs = [(c, base) for c, base in pairs if base.isascii() and base != c] + [("ø", "o"), ("Ø", "O"), ("đ", "d"), ("Đ", "D"), ("ł", "l"), ("Ł", "L"), ("ð", "d"), ("ı", "i")]
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


def lookup(table: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def clean_text(c: Column) -> Column:
    """Lower case, letters a-z, digits and single spaces only; null becomes empty."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9\s]", " "), r"\s+", " "))


def expand_abbreviations(c: Column) -> Column:
    for short, full in ABBREVIATIONS.items():
        c = F.regexp_replace(c, rf"\b{short}\b", full)
    return c


def to_latin(c: Column) -> Column:
    """Latin letters without their diacritics."""
    for wide, plain in WIDE.items():
        c = F.replace(c, F.lit(wide), F.lit(plain))
    return F.translate(c, *latin_table())


def normal_text(c: Column) -> Column:
    """Tokens with single spaces between them: lower case, ``&`` as a word, zeros in words as o, ordinals as numbers, digits apart."""
    c = F.regexp_replace(F.replace(F.lower(to_latin(F.coalesce(c, F.lit("")))), F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", " ")
    c = F.regexp_replace(c, "(?<=[a-z])0(?=[a-z])", "o")
    c = F.regexp_replace(c, r"\b([0-9]+)(?:st|nd|rd|th)\b", "$1")
    return F.trim(F.regexp_replace(c, "(?<=[0-9])(?=[a-z])|(?<=[a-z])(?=[0-9])", " "))


def first_normal_text(c: Column) -> Column:
    """The first generation's tokens: letters in lower case and ``&`` as a word, nothing else rewritten."""
    return F.trim(F.regexp_replace(F.replace(F.lower(to_latin(F.coalesce(c, F.lit("")))), F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", " "))


def words(c: Column) -> Column:
    """The words of a text with single spaces; none for an empty one."""
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, " "))


def tokens(c: Column, first: bool = False) -> Column:
    return words(first_normal_text(c) if first else normal_text(c))


def skeletons(tokens: Column, first: bool = False) -> Column:
    """The phonetic skeleton of each token, in place; a token may become empty. The first generation's only drops vowels."""
    c = F.array_join(tokens, " ")
    for pattern, to in PHONETIC[-1:] if first else PHONETIC:
        c = F.regexp_replace(c, pattern, to)
    c = F.regexp_replace(c, r"([^ ])\1+", "$1")
    return F.when(F.size(tokens) == 0, F.array().cast("array<string>")).otherwise(F.split(c, " "))


def without(tokens: Column, words: list[str]) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(words))


def mapped(tokens: Column, table: dict) -> Column:
    of = lookup(table)
    return F.transform(tokens, lambda t: F.coalesce(F.element_at(of, t), t))


def is_number(token: Column) -> Column:
    return token.rlike("^[0-9]+$")


def no_zeros(token: Column) -> Column:
    return F.regexp_replace(token, "^0+(?=.)", "")


def initials(core: Column) -> Column:
    """First letters of two or more tokens, else empty."""
    return F.when(F.size(core) >= 2, F.array_join(F.transform(core, lambda t: F.substring(t, 1, 1)), "")).otherwise("")


def number_sequence(tokens: Column) -> Column:
    """The numbers of an address in order: digits of up to 12 places, number words to 99, tens joined with a following unit."""
    small, tens = lookup(SMALL), lookup(TENS)
    digits = lambda t: F.when(is_number(t) & (F.length(t) <= 12), t.cast("bigint"))
    unit = lambda t: F.when(F.element_at(small, t) < 10, F.element_at(small, t)).cast("bigint")
    ten = lambda t: F.element_at(tens, t).cast("bigint")
    at = lambda i: F.when((i >= 0) & (i < F.size(tokens)), F.get(tokens, i))

    def value(t: Column, i: Column) -> Column:
        follows = ten(at(i - 1)).isNotNull() & unit(t).isNotNull()  # its ten has taken it
        own = F.when(~t.isin(PLAIN_WORDS), F.element_at(small, t).cast("bigint"))
        return F.coalesce(digits(t), ten(t) + F.coalesce(unit(at(i + 1)), F.lit(0)), F.when(~follows, own))

    return F.filter(F.transform(tokens, value), lambda v: v.isNotNull())
