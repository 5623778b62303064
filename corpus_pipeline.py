"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``, extra
ones included. Defined results of the stages: a document without letters (null and empty texts among them) or with no
language goes in the first; a row with a null id stays and is in no group of near duplicates; of rows with equal id and text
one stays; a null source is a source of its own; an empty table gives empty tables of the same columns and no sequence.
``run`` writes what a stage returns to the shared folder and reads it again for the next one. Packing takes the order of the mix
from the order of the files and of their rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linkwright.llm import language, mixing, neardup, packing, personal
from linkwright.llm.common import with_places, written

#: Texts whose language has a smaller share of their words' marginals are rejected, as are those without letters.
LEAST_LANGUAGE = 0.4


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised."""
    return language.accepted(docs, language.fit(docs), LEAST_LANGUAGE)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (shingles of five words, a similarity of 0.8)."""
    return neardup.keep_one(docs, words=5, threshold=0.8)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by marks; n_chars counts the new text."""
    return personal.mask_personal_data(docs)


def balance(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of a mix of the sources to tempered weights; a source that runs out leaves the mix."""
    return mixing.continued(docs)


def bundle(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens, numbered in the order of the mix: their ids, and which piece of which document stands where."""
    return packing.sequences(with_places(docs, "_place"), order_col="_place")


STAGES = [("language", identify), ("near_duplicates", deduplicate), ("personal_data", redact), ("mixing", balance), ("packing", bundle)]

#: No SQL: learned language identification and the public tokenizer are beyond it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
