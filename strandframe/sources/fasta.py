"""FASTA references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandframe.operators.bases import WIDTH
from strandframe.sources.lines import numbered


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """contig, start, seq of each line of sequence, as it is written. Of records with one name the last counts.

    A line's record is the last header before it: in its own block of the file, or else in the blocks before.
    """
    rows = numbered(spark, path).withColumn("head", F.when(F.col("line").startswith(">"), F.col("line_no")))
    inside = W.partitionBy("file", "block").orderBy("line_no")
    rows = rows.withColumn("own", F.last("head", ignorenulls=True).over(inside))
    ends = rows.groupBy("file", "block").agg(F.max("head").alias("last"))
    carried = ends.withColumn("carried", F.max("last").over(W.orderBy("file", "block").rowsBetween(W.unboundedPreceding, -1))).drop("last")
    rows = rows.join(carried, ["file", "block"]).withColumn("record", F.coalesce("own", "carried"))
    names = rows.where("head is not null").select(F.col("head").alias("record"), F.regexp_extract("line", r"^>\s*(\S*)", 1).alias("contig"))
    last = names.groupBy("contig").agg(F.max("record").alias("record"))
    body = rows.where("head is null and record is not null").withColumn("seq", F.trim("line")).where("seq <> ''").join(last, "record")
    start = F.sum(F.length("seq")).over(W.partitionBy("contig").orderBy("line_no")) - F.length("seq")
    return body.select("contig", start.cast("long").alias("start"), "seq")


def read_bins(spark: SparkSession, path: str, width: int = WIDTH) -> DataFrame:
    """A reference by schema.REFERENCE; no contig is ever one string."""
    rows = read_lines(spark, path)
    lengths = rows.groupBy("contig").agg(F.max(F.col("start") + F.length("seq")).alias("length"))
    to = F.col("start") + F.length("seq") - 1
    parts = rows.withColumn("bin", F.explode(F.sequence(F.expr(f"start div {width}"), F.floor(to / width))))
    low = F.greatest("start", F.col("bin") * width)
    part = F.col("seq").substr((low - F.col("start") + 1).cast("int"), (F.least(to + 1, (F.col("bin") + 1) * width) - low).cast("int"))
    joined = parts.select("contig", "bin", F.struct(low.alias("at"), part.alias("s")).alias("x")).groupBy("contig", "bin").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return joined.join(lengths, "contig").select("contig", "bin", (F.col("bin") * width).alias("bin_start"), "length", F.array_join(F.transform("x", lambda v: v["s"]), "").alias("seq"))


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """contig, seq: whole strings, for small references."""
    rows = read_lines(spark, path).groupBy("contig").agg(F.array_sort(F.collect_list(F.struct("start", "seq"))).alias("x"))
    return rows.select("contig", F.array_join(F.transform("x", lambda v: v["seq"]), "").alias("seq"))
