"""The registered queries of the subpackage, each over whole tables."""

from __future__ import annotations

import corpus_pipeline

from linkwright.llm import language, licences, lines, mixing, neardup, neighbours, oracle, packing, personal, substrings, warc
from linkwright.llm.common import table

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_personal_data": lambda spark, d: personal.digest(table(spark, d, "documents")),
    "op2_mixing": lambda spark, d: mixing.digest(table(spark, d, "documents")),
    "op3_line_quality": lambda spark, d: lines.digest(table(spark, d, "documents")),
    "op4_packing": lambda spark, d: packing.digest(table(spark, d, "documents")),
    "op5_licences": lambda spark, d: licences.digest(table(spark, d, "documents")),
    "op6_language": lambda spark, d: language.digest(table(spark, d, "documents")),
    "op7_warc": lambda spark, d: warc.digest(table(spark, d, "pages")),
    "op8_near_duplicates": lambda spark, d: neardup.digest(table(spark, d, "documents")),
    "op9_neighbours": lambda spark, d: neighbours.digest(table(spark, d, "embeddings")),
    "op10_repeats": lambda spark, d: substrings.digest(table(spark, d, "documents")),
}
ORACLE: dict[str, str] = oracle.SQL
