"""New first-source records against a stored index, as a stream: the same plan as a batch, one micro-batch at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from linkwright.functions.scripts import latin_records
from linkwright.operators import bag, retrieve
from linkwright.sources.records import RECORD


def read_stream(spark: SparkSession, folder: str, schema: str = RECORD) -> DataFrame:
    """Records from tab-separated files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("sep", "\t").option("header", True).option("quote", '"').option("escape", '"').csv(folder)


def resolve_stream(records: DataFrame, index_path: str, out: str, checkpoint: str, k: int = 50) -> StreamingQuery:
    """Writes each micro-batch's candidates under ``out``; a batch that is run again replaces its own folder."""

    def each(batch: DataFrame, number: int) -> None:
        postings, idf = retrieve.load_index(batch.sparkSession, index_path)
        found = retrieve.forward(bag.bags(latin_records(batch.na.fill(""))), (postings, idf), k)
        found.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return records.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
