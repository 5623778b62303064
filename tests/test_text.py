"""Golden vectors of the text functions."""

import pytest
from pyspark.sql import functions as F

from linkwright.functions import text as T
from linkwright.functions.scripts import romanise_columns

NORMAL = {
    "Vijay F0ods": "vijay foods", "Harb0r & Sons": "harbor and sons", "203-B 26rd St, Talladega, Alabama": "203 b 26 st talladega alabama", "158ND AVE": "158 ave",
    "002050 LEAGUE CITY PKWY": "002050 league city pkwy", "Wz-1082": "wz 1082", "A/0B0C": "a 0 boc", "": "", None: "", "Société d'Œuvres": "societe d oeuvres",
}
SKELETON = {
    "marketing": "nrktn", "management": "njnt", "finance": "fns", "phainyans": "fns", "private": "prbt", "praibhet": "prbt", "indian": "ndn", "imdiyn": "ndn", "construction": "knstrksn",
    "morganton": "nrjntn", "morgantno": "nrjntn", "warren": "brn", "wrren": "brn", "vijay": "bj", "guru": "jr", "foods": "fds", "aeiou": "",
}


def test_normal_text(spark):
    df = spark.createDataFrame([(k,) for k in NORMAL], "s string")
    got = {r["s"]: r["n"] for r in df.select("s", T.normal_text(F.col("s")).alias("n")).collect()}
    assert got == NORMAL


def test_skeletons_keep_their_places(spark):
    df = spark.createDataFrame([(list(SKELETON),), ([],)], "t array<string>")
    got = [r[0] for r in df.select(T.skeletons(F.col("t"))).collect()]
    assert got == [list(SKELETON.values()), []]


@pytest.mark.parametrize(("text", "numbers"), [("fourteenth", [14]), ("twenty first", [21]), ("017954", [17954]), ("first floor", []), ("thirty 5 two", [30, 5, 2]), ("twenty thirty nine", [20, 39]), ("1234567890123", [])])
def test_number_sequence(spark, text, numbers):
    df = spark.createDataFrame([(text.split(),)], "t array<string>")
    assert df.select(T.number_sequence(F.col("t"))).first()[0] == numbers


def test_other_scripts(spark):
    df = romanise_columns(spark.createDataFrame([("राम मार्केटिंग",), ("plain",), (None,)], "s string"), "s")
    got = {r[0] for r in df.collect()}
    assert "plain" in got and None in got
    named = df.where("s <> 'plain'").select(T.skeletons(T.tokens(F.col("s")))).first()[0]
    assert named[0] == "rn" and named[1].startswith("nrkt")


def test_abbreviations(spark):
    df = spark.createDataFrame([("ACME Co. LLC, 5 Main St",), (None,)], "s string")
    got = [r[0] for r in df.select(T.expand_abbreviations(T.clean_text(F.col("s")))).collect()]
    assert got == ["acme company limited liability company 5 main street", ""]
