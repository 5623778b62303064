"""What Python workers hold at a time."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from linkwright.llm import common, language, personal

STAGES = {
    "map_text": lambda docs: common.map_text(docs, lambda: lambda texts: [(1,) for _ in texts], "n long"),
    "accepted": lambda docs: language.accepted(docs, None, 0.5),
    "mask_personal_data": personal.mask_personal_data,
}


def _largest(docs) -> tuple[int, int]:
    """Bytes of the largest Arrow batch that a task gets, and of all of them."""

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    rows = docs.select("text").mapInArrow(sizes, "n long").collect()
    return max(r.n for r in rows), sum(r.n for r in rows)


@pytest.mark.parametrize("stage", STAGES)
def test_batches_of_long_texts_are_bounded(spark, stage):
    session = spark.newSession()
    docs = session.range(0, 300, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 20_000).alias("text"))
    STAGES[stage](docs)
    largest, whole = _largest(docs)
    assert whole >= 300 * 100_000 and largest <= common.BATCH_BYTES + 200_000


def test_a_bound_of_the_session_stays(spark):
    session = spark.newSession()
    session.conf.set(common.BATCH, "1m")
    common.small_batches(session)
    assert session.conf.get(common.BATCH) == "1m"


def test_filtered_languages_do_not_depend_on_slices(spark, monkeypatch):
    texts = ["the cat and the dog", "der hund und die katze", None, "12 34", "", "the house of the king", "das haus und der garten"] * 5
    docs = spark.createDataFrame([(i, t, "en" if t and "the" in t.split() else "de") for i, t in enumerate(texts)], "doc_id long, text string, lang string").coalesce(1)
    field = language.fit(docs)
    want = [i for i, (lang, score) in enumerate(language.Tagger(field).predict(texts)) if lang != "und" and score >= 0.6]
    for size in (512, 3):
        monkeypatch.setattr(language, "TEXTS", size)
        got = language.accepted(docs, field, 0.6)
        assert "ArrowEvalPython" in got._jdf.queryExecution().executedPlan().toString()
        assert sorted(r.doc_id for r in got.collect()) == want
    assert 0 < len(want) < len(texts)
    assert language.accepted(docs, None, 0.6).count() == 0
