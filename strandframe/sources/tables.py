"""BED intervals, discount tables and rescaling matrices from tab-separated text."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandframe.operators import intervals
from strandframe.sources.lines import fields, numbered

log = logging.getLogger(__name__)


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """Merged intervals. Comments, track and browser lines and lines of fewer than three fields are passed over, as are empty
    intervals; numbers that aren't, and starts that go back within a contig, are errors."""
    rows = fields(numbered(spark, path).where((F.trim("line") != "") & ~F.col("line").rlike("^(#|track|browser)")))
    short = rows.where(F.size("f") < 3).count()
    if short:
        log.warning("%d lines with fewer than three fields passed over in %s", short, path)
    rows = rows.where(F.size("f") >= 3).select("line_no", F.col("f")[0].alias("contig"), F.col("f")[1].cast("long").alias("start"), F.col("f")[2].cast("long").alias("end")).where(F.col("start") < F.col("end"))
    before = F.lag("start").over(W.partitionBy("contig").orderBy("line_no"))
    sorted_start = F.when(before > F.col("start"), F.raise_error(F.concat(F.lit("BED intervals are not sorted on "), "contig")).cast("long")).otherwise(F.col("start"))
    return intervals.merged(rows.select("contig", sorted_start.alias("start"), "end"))


def maybe_bed(spark: SparkSession, path: str | None) -> DataFrame | None:
    return read_bed(spark, path) if path else None


def read_discounts(spark: SparkSession, path: str) -> DataFrame:
    """The first line is a header whatever it says; rows of other than four fields or with numbers that aren't go; equal keys add up."""
    rows = fields(numbered(spark, path).where("line_no > 0")).where(F.size("f") == 4)
    number = lambda i, kind: F.col("f")[i].try_cast(kind)
    rows = rows.select(F.col("f")[0].alias("base_change"), number(1, "int").alias("read_num"), number(2, "long").alias("base_position"), number(3, "long").alias("discount_count")).na.drop()
    rows = rows.where((F.col("read_num").between(0, 255)) & (F.col("base_position") >= 0) & (F.col("discount_count") >= 0))
    return rows.groupBy("base_change", "read_num", "base_position").agg(F.sum("discount_count").alias("discount_count"))


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """No header is needed: rows that can't be read go, and of equal keys the last counts. Bases are the first letters of their fields."""
    rows = fields(numbered(spark, path).withColumn("line", F.trim("line"))).where(F.size("f") >= 5)
    rows = rows.select("line_no", F.col("f")[0].try_cast("int").alias("read_num"), F.col("f")[1].try_cast("int").alias("position"), F.substring(F.col("f")[2], 1, 1).alias("ref_base"), F.substring(F.col("f")[3], 1, 1).alias("read_base"), F.col("f")[4].try_cast("float").alias("scaling_factor")).na.drop()
    rows = rows.where(F.col("read_num").between(0, 255) & F.col("position").between(0, 65535) & (F.col("ref_base") != "") & (F.col("read_base") != ""))
    return rows.groupBy("read_num", "position", "ref_base", "read_base").agg(F.max_by("scaling_factor", "line_no").alias("scaling_factor"))


def read_plot_table(spark: SparkSession, path: str) -> tuple[DataFrame, bool]:
    """A table of counts with its position column named position, and whether it is of insert mode."""
    table = spark.read.csv(path, sep="\t", header=True, inferSchema=False)
    insert = "fragment_position" in table.columns
    if not insert and "read_position" not in table.columns:
        raise ValueError("neither read_position nor fragment_position is a column")
    y = "count" if "count" in table.columns else "normalized_frequency"
    kinds = {"read_num": "int", "reference_order": "int", "position": "long", y: "long" if y == "count" else "double"}
    table = table.withColumnRenamed("fragment_position" if insert else "read_position", "position")
    return table.withColumns({c: F.col(c).cast(k) for c, k in kinds.items()}), insert
