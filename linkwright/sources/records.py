"""Records in and out: tab-separated files, Parquet, id lists, and the records of the test documents."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RECORD = "entity_id string, business_name string, business_address string, country string"
TRUTH = "source1_entity_id string, matched_entity_ids string"


@dataclass
class Places:
    """Where data and results lie; from the environment unless given."""

    data: str = field(default_factory=lambda: os.environ.get("ER_DATA_DIR", "data"))
    work: str = field(default_factory=lambda: os.environ.get("ER_WORK_DIR", "work"))

    def source(self, split: str, number: int) -> str:
        return f"{self.data}/{split}/{split}_source{number}.tsv"

    def truth(self, split: str) -> str:
        return f"{self.data}/{split}/{split}_ground_truth.tsv"

    def artefact(self, name: str) -> str:
        return f"{self.work}/{name}"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is such a file or folder, in whatever store its path names."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def find_training_folder(spark: SparkSession, top: str, depth: int = 4) -> str | None:
    """The first folder under an input root, by name and at most so deep, that holds a folder ``train``."""
    place = spark._jvm.org.apache.hadoop.fs.Path(top)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    level = [place] if store.exists(place) else []
    for _ in range(depth):
        below = [x.getPath() for p in level for x in store.listStatus(p) if x.isDirectory()]
        found = sorted(str(p.getParent()) for p in below if p.getName() == "train")
        if found:
            return found[0]
        level = below
    return None


def read_tsv(spark: SparkSession, paths: str | list[str], schema: str = RECORD) -> DataFrame:
    """One or more tab-separated files; doubled quotes are literal, 'NA' is a text, a missing value is empty."""
    return spark.read.schema(schema).option("sep", "\t").option("header", True).option("quote", '"').option("escape", '"').csv(paths).na.fill("")


def write_tsv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """A folder of files with headers; an empty value is written as nothing."""
    kept = {"sep": "\t", "header": True, "quote": '"', "escape": '"', "emptyValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    (df.coalesce(1) if one_file else df).write.mode("overwrite").options(**kept).csv(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """The distinct first fields of a file's lines after the header; blank lines don't count."""
    lines = spark.read.option("sep", "\t").option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return lines.select(F.col(lines.columns[0]).alias("entity_id")).where(F.trim("entity_id") != "").distinct()


def only(records: DataFrame, ids: DataFrame, id_col: str = "entity_id") -> DataFrame:
    """The records whose ids are listed."""
    return records.join(ids.select(F.col(ids.columns[0]).alias(id_col)).distinct(), id_col, "left_semi")


def source_of(entity_id: Column) -> Column:
    return F.substring(entity_id, 1, 2)


def id_code(entity_id: Column, third: int = 10_000_000_000) -> Column:
    """An id as a number; those of the third source are set off."""
    number = F.substring_index(entity_id, "-", -1).cast("bigint")
    return number + F.when(entity_id.startswith("S3-"), F.lit(third)).otherwise(F.lit(0))


def decode_id(code: Column, third: int = 10_000_000_000) -> Column:
    """The id of a second- or third-source code."""
    return F.when(code >= third, F.concat(F.lit("S3-"), (code - third).cast("string"))).otherwise(F.concat(F.lit("S2-"), code.cast("string")))


def document_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Business records made of ``documents``: four words of name, length and eight words of address; near copies share ``rep``.

    The first of a cluster is of source S1, unless the cluster is one whose first is left out; others are of S2 or S3.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang", "n_chars")
    docs = docs.withColumn("t", F.slice(F.filter(F.split("text", r"\s+", 14), lambda x: x != ""), 1, 12)).withColumn("head", F.substring("text", 1, 50)).drop("text")
    cluster = Window.partitionBy("lang", "head")
    docs = docs.withColumn("rep", F.min("doc_id").over(cluster)).withColumn("size", F.count(F.lit(1)).over(cluster))
    first = (F.col("doc_id") == F.col("rep")) & ~((F.col("size") > 1) & (F.col("rep") % 5 == 0))
    src = F.when(first, "S1").when(F.col("doc_id") % 2 == 0, "S2").otherwise("S3")
    part = lambda a, n: F.array_join(F.slice("t", a, n), " ")
    return docs.select(
        F.concat(src, F.lit("-"), F.col("doc_id").cast("string")).alias("entity_id"), src.alias("src"), F.col("lang").alias("country"), part(1, 4).alias("business_name"),
        F.concat(F.col("n_chars").cast("string"), F.lit(" "), part(5, 8)).alias("business_address"), "doc_id", "rep",
    )


def document_truth(records: DataFrame) -> DataFrame:
    """(source1_entity_id, candidate_entity_id): members of clusters whose first is of S1."""
    firsts = records.where("src = 'S1'").select(F.col("entity_id").alias("source1_entity_id"), F.col("doc_id").alias("_rep"))
    return records.where("src <> 'S1'").join(firsts, F.col("rep") == F.col("_rep")).select("source1_entity_id", F.col("entity_id").alias("candidate_entity_id"))
