"""Romanisation of scripts other than Latin, for the rows that need it."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

NOT_ASCII = r"[^\x00-\x7F]"
NOT_LATIN = r"[\p{L}\p{N}&&[^\p{IsLatin}]&&[^\x00-\x7F]]"


# Usual Latin readings of letters whose names don't spell them.
READINGS = {
    **dict(zip("αβγδεζηθικλμνξοπρσςτυφχψω", "a v g d e z i th i k l m n x o p r s s t y f ch ps o".split(), strict=True)),
    **dict(zip("абвгдежзийклмнопрстуфхцчшщъыьэюяіїєґёў", "a b v g d e zh z i y k l m n o p r s t u f kh ts ch sh shch  y  e yu ya i yi ye g yo u".split(" "), strict=True)),
    **dict(zip("אבגדהוזחטיכךלמםנןסעפףצץקרשת", "a b g d h v z h t y k k l m m n n s a p p ts ts k r sh t".split(), strict=True)),
    **dict(zip("ابتثجحخدذرزسشصضطظعغفقكلمنهوىيةءپچژگکی", "a b t th j h kh d dh r z s sh s d t z a gh f q k l m n h w a y h  p ch zh g k y".split(" "), strict=True)),
}
#: Scripts whose last consonant of a word loses the vowel that it bears.
SILENT = ("DEVANAGARI", "BENGALI", "GURMUKHI", "GUJARATI", "ORIYA")
#: Marks and what becomes of them; "-" takes the vowel of the consonant before.
MARKS = (("VIRAMA", "-"), ("NUKTA", ""), ("ANUSVARA", "n"), ("CANDRABINDU", "n"), ("TIPPI", "n"), ("BINDI", "n"), ("VISARGA", "h"), ("JOINER", ""))


def romanise_character(c: str) -> str:
    """A letter's reading, mostly from its Unicode name: 'DEVANAGARI LETTER KA' is 'ka', a vowel sign '+' and its vowel, a virama '-'."""
    if c.isascii():
        return c
    digit = unicodedata.digit(c, None)
    if digit is not None:
        return str(digit)
    low = c.lower()
    if low in READINGS:
        return READINGS[low] if low == c else READINGS[low].capitalize()
    base = unicodedata.normalize("NFKD", c)
    if base[0] != c and (base[0].isascii() or base[0].lower() in READINGS):
        return "".join(map(romanise_character, base))
    name = unicodedata.name(c, "")
    for mark, to in MARKS:
        if mark in name:
            return to
    for kind in (" LETTER ", " VOWEL SIGN ", " SYLLABLE "):
        if kind in name:
            return "+" * (kind == " VOWEL SIGN ") + name.split(kind)[1].split(" WITH ")[0].split()[-1].lower()
    return "".join(map(romanise_character, base)) if base != c else "" if unicodedata.combining(c) else " "


def romanise(text: str) -> str:
    """Consonants bear the vowel a, which a vowel sign replaces and a virama drops, as does the end of a word in some scripts."""
    out: list[str] = []
    silent: list[bool] = []  # whether a piece loses its vowel at the end of a word
    for c in text:
        to = romanise_character(c)
        if to[:1] in ("+", "-") and not c.isascii():
            if out and out[-1].endswith("a") and len(out[-1]) > 1:
                out[-1] = out[-1][:-1]
            to = to[1:]
            silent.append(False)
        else:
            silent.append(not c.isascii() and unicodedata.name(c, "").startswith(SILENT) and to.endswith("a") and len(to) > 1)
        out.append(to)
    follows = False  # whether a letter follows in the word
    for i in range(len(out) - 1, -1, -1):
        if out[i]:
            if silent[i] and not follows and out[i].endswith("a"):
                out[i] = out[i][:-1]
            follows = out[i][:1].isalnum()
    return "".join(out)


@F.pandas_udf(StringType())
def romanised(texts: pd.Series) -> pd.Series:
    return texts.map(romanise, na_action="ignore")


def romanise_columns(df: DataFrame, *columns: str, pattern: str = NOT_LATIN) -> DataFrame:
    """``df`` with the columns romanised; values of Latin letters and digits only never reach Python."""
    other = F.lit(False)
    for name in columns:
        other = other | F.coalesce(F.col(name).rlike(pattern), F.lit(False))
    made = {name: F.when(F.col(name).rlike(pattern), romanised(F.col(name))).otherwise(F.col(name)) for name in columns}
    return df.where(~other).unionByName(df.where(other).withColumns(made).select(*df.columns))


def latin_records(records: DataFrame, name: str = "business_name", address: str = "business_address") -> DataFrame:
    """``records`` in Latin letters, with ``name_nonascii``: whether the name as it came had letters beyond ASCII."""
    if "name_nonascii" in records.columns:
        return records
    return romanise_columns(records.withColumn("name_nonascii", F.coalesce(F.col(name).rlike(NOT_ASCII), F.lit(False))), name, address)
