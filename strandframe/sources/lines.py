"""Text files as numbered lines, in file order however the files were split."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """line_no (from 0, through all files in order of their names), line, and block. "-" reads standard input to its end."""
    if path == "-":
        rows = [(i, x.rstrip("\r\n"), "-", 0) for i, x in enumerate(sys.stdin)]
        return spark.createDataFrame(rows, "line_no long, line string, file string, block long")
    rows = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("m"))
    # a block is read by one task, so its rows have consecutive ids: its first id and its size are enough, and no line is shuffled
    counts = rows.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("m").alias("first"))
    before = counts.withColumn("before", F.sum("n").over(W.orderBy("file", "block")) - F.col("n")).drop("n")  # a row a block
    return rows.join(F.broadcast(before), ["file", "block"]).select((F.col("before") + F.col("m") - F.col("first")).alias("line_no"), "line", "file", "block")


def fields(rows: DataFrame) -> DataFrame:
    return rows.withColumn("f", F.split("line", "\t"))
