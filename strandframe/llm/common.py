"""What the operators share: reading tables, the word rule, and tables staged in the cluster's shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java pattern of what separates words; words are ``[^\x20\x09-\x0D]+``. ``bytes.split()`` splits at the same bytes.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def quoted(columns: list[str]) -> list[Column]:
    """Columns by their whole names, whatever characters are in them."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in columns]


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, also where the body is evaluated for each element of an array."""
    return F.transform(F.array(value), body)[0]


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or where that is unset on one machine (local mode) one of our own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="strandframe-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses; it goes when the application ends."""
    path = f"{shared_dir(spark)}/strandframe-{label}-{uuid.uuid4().hex}"
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(conf)
    fs.mkdirs(hadoop.getParent())
    fs.deleteOnExit(hadoop)
    return path


#: Spark's own setting by which a query's shuffle files go when it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, label: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """df written as a table in the shared folder and read again: its lineage ends there, a lost executor costs nothing, and its shuffle files go."""
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").option("parquet.block.size", 32 << 20).partitionBy(*partition_by).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes staged tables that are no longer needed."""
    for df in tables:
        spark = df.sparkSession
        for path in {re.match(r".*/strandframe-[^/]+", f)[0] for f in df.inputFiles()}:
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
