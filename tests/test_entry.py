"""The driver's contract, and a whole linkage."""

import json

import duckdb
import pytest

import __spark_entry__ as entry
from linkwright.plans import catalogue, linkage
from linkwright.operators import decide, measure

SMALL = "/root/testdata/sf0.001"


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["normalize_tokens", "feature_bag", "topk_forward", "select_threshold", "emit_matches"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM '{SMALL}/documents.parquet'")
    want = con.sql(catalogue.ORACLE[name])
    got = catalogue.QUERIES[name](spark, SMALL)
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    assert sorted(map(tuple, got.select(*order).collect())) == sorted(map(tuple, want.select(", ".join(order)).fetchall()))


def test_linkage_learns_more_than_nothing(spark):
    work = linkage.documents(spark, SMALL, catalogue.SETTINGS, keep=True)
    matches, candidates, selection = linkage.link(work.records, work.truth, catalogue.SETTINGS)
    assert matches.count() == work.s1.count() == candidates.count()
    assert json.dumps(selection) and selection["mode"] in ("threshold", "expected")
    kept = matches.withColumnRenamed("source1_entity_id", "entity_id").selectExpr("entity_id AS source1_entity_id", "explode(filter(split(matched_entity_ids, ','), x -> x <> '')) AS candidate_entity_id")
    assert kept.count() == kept.select("candidate_entity_id").distinct().count()
    whole = decide.macro_f05(measure.label_pairs(kept, work.truth), work.entities).first()[0]
    none = decide.macro_f05(measure.label_pairs(kept.limit(0), work.truth), work.entities).first()[0]
    assert whole > none
