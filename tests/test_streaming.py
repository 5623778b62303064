"""A stream of records finds what a batch finds."""

from linkwright.operators import bag, retrieve
from linkwright.sources import records as R
from linkwright.streaming import incremental


def test_stream_equals_batch(spark, tmp_path):
    own = R.document_records(spark, "/root/testdata/sf0.001").select("entity_id", "src", "business_name", "business_address", "country")
    bags = bag.bags(own)
    postings, idf = retrieve.build_index(bags.where("src <> 'S1'"), 2.0)
    retrieve.save_index(postings, idf, str(tmp_path / "index"))
    s1 = own.where("src = 'S1'").drop("src")
    R.write_tsv(s1, str(tmp_path / "in"))
    stream = incremental.resolve_stream(incremental.read_stream(spark, str(tmp_path / "in")), str(tmp_path / "index"), str(tmp_path / "out"), str(tmp_path / "check"), 5)
    stream.awaitTermination()
    got = {(r["source1_entity_id"], r["candidate_entity_id"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r["source1_entity_id"], r["candidate_entity_id"]) for r in retrieve.forward(bags.where("src = 'S1'"), (postings, idf), 5).collect()}
    assert got == want
