"""What the operators share: Arrow row mapping, the shared folder, tables and two-level ranking."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

#: Rows of an Arrow batch that are Python objects at the same time; an operator may ask for another number.
SLICE = 256

#: Bytes of an Arrow batch that goes to Python, where the session has no bound of its own. Spark's is 64 MB, which a task holds
#: several times over, in the executor and in Python.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def once(make: Callable) -> Callable:
    """``make`` without arguments, called at most once in a process or task; unlike lru_cache it travels by value."""
    made: list = []

    def get():
        if not made:
            made.append(make())
        return made[0]

    return get


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """From now on Arrow batches of the session are bounded by BATCH_BYTES; plans ask for that only when they run, so it stays."""
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, str(BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the place that all machines share, ``spark.checkpoint.dir``.

    Where that is unset, a local master gets a folder of this machine; on a cluster this is an error, as executors would
    write to disks that others don't see.
    """
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all machines share")
        top = f"{tempfile.gettempdir()}/checkpoints"
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top}/linkwright-{uuid.uuid4().hex}"


def deleted(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


#: Folders that ``written`` wrote, for each block of ``scratch`` that is open.
OPEN: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """What ``written`` writes inside is deleted at the end, but for what is taken off the list that this gives."""
    OPEN.append(made := [])
    try:
        yield made
    finally:
        OPEN.pop()
        for path in made:
            deleted(spark, path)


def forget(df: DataFrame) -> None:
    """Deletes what ``written`` wrote for ``df``, which nothing may read any more."""
    folders = {f"{top}/linkwright-{rest.split('/')[0]}" for top, mark, rest in (f.rpartition("/linkwright-") for f in df.inputFiles()) if mark}
    for path in folders:
        deleted(df.sparkSession, path)


def written(df: DataFrame, *partitioned: str) -> DataFrame:
    """``df`` after a round through Parquet in the shared folder: its lineage ends there, so a lost executor costs no recomputation."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession)
    out = df.write.option("compression", "zstd")
    (out.partitionBy(*partitioned) if partitioned else out).parquet(path)
    if OPEN:
        OPEN[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def with_places(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with ``name``: places from 0 in the order in which its rows stand, which is that of its files and of the rows in them.

    Readers deal files out by size, so the order of a sorted table is only in the names of its files. What isn't read from
    files as it is gets written first.
    """
    own = docs if docs._jdf.queryExecution().analyzed().nodeName().startswith("LogicalRelation") else written(docs)
    rows = own.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    files = rows.groupBy("_file").agg((F.max("_row") + 1).alias("_n"))  # a row a file
    before = Window.orderBy(F.length("_file"), "_file").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return rows.join(F.broadcast(starts), "_file").select(*docs.columns, (F.col("_start") + F.col("_row")).alias(name))


def map_text(docs: DataFrame, make: Callable[[], Callable[[list], list]], returns: str, id_col: str = "doc_id", text_col: str = "text", rows: int = SLICE) -> DataFrame:
    """``doc_id`` and the fields of ``returns`` (DDL) for each row of ``docs``; other columns are not read.

    ``make()`` runs once a task and gives a function from a list of texts (None for null) to a list of tuples.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    small_batches(docs.sparkSession)
    fields = StructType.fromDDL(returns)
    schema = StructType([source.schema["doc_id"], *fields])
    types = [(f.name, to_arrow_type(f.dataType)) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                made = work(part.column(1).to_pylist())
                columns = list(zip(*made, strict=True)) or [()] * len(types)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(c, t) for c, (_, t) in zip(columns, types, strict=True))],
                    names=["doc_id", *(n for n, _ in types)],
                )

    return source.mapInArrow(run, schema)


def ranked(df: DataFrame, keys: list[str], order: list[Column], spread: Column, name: str) -> DataFrame:
    """Adds ``name``: the rank from 0 of each row within ``keys``, by ``spread`` and then ``order``.

    A key may hold most rows: rows are ranked within (key, spread), and the counts of those buckets, a table bounded by
    keys times distinct values of ``spread`` (never null), are summed up to the offset of each bucket.
    """
    # Null keys get a value and a mark, so that the join is on plain columns, by which the window has dealt the rows already.
    dealt = []
    for i, k in enumerate(keys):
        kind = df.schema[k].dataType
        df = df.withColumns({f"_k{i}": F.coalesce(F.col(k), F.lit("" if kind.simpleString() == "string" else 0).cast(kind)), f"_n{i}": F.col(k).isNull()})
        dealt += [f"_k{i}", f"_n{i}"]
    df = df.withColumn("_spread", spread)
    sizes = df.groupBy(*dealt, "_spread").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*dealt).orderBy("_spread").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*dealt, "_spread", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy(*dealt, "_spread").orderBy(*order)
    rows = df.withColumn("_within", F.row_number().over(within) - 1)
    return rows.join(offsets, [*dealt, "_spread"]).withColumn(name, F.col("_offset") + F.col("_within")).drop("_spread", "_offset", "_within", *dealt)
