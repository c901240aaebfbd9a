"""Base qualities rewritten by a table of factors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.config import RescaleConfig
from strandframe.functions import exprs
from strandframe.operators import bases


def changed_bases(alignments: DataFrame, reference: DataFrame, matrix: DataFrame, config: RescaleConfig = RescaleConfig(), width: int = bases.WIDTH) -> DataFrame:
    """rec_idx, r_pos and new_qual of each base that differs from the reference and whose key is in matrix. No read is left out.

    matrix is of bounded size (positions of 16 bits, 24 keys each); Spark broadcasts it if it is as small as it mostly is. Of equal
    keys the largest factor counts (read_matrix() leaves none).
    """
    reads = bases.prepared(alignments.where(F.col("tid") >= 0))
    shift = F.lit(0).cast("long")
    if config.clip_keeps_offset:
        first = F.col("ops")[0]
        clips = F.filter("ops", lambda x: x["op"] == "S")
        lead = F.when(first["op"] == "S", first["len"]).when((first["op"] == "H") & (F.size("ops") > 1) & (F.get("ops", F.lit(1))["op"] == "S"), F.get("ops", F.lit(1))["len"]).otherwise(0)
        shift = F.when(F.size(clips) > 0, lead).otherwise(0).cast("long")
    rows = bases.on_reference(reads.withColumn("shift", shift), reference, width)
    rows = bases.aligned(rows, ["rec_idx", "read_num", "is_rev"], F.col("shift")).withColumn("r_pos", F.col("r_pos").cast("int"))
    differ = exprs.countable(F.col("read_base")) & exprs.countable(F.col("ref_base")) & (F.col("read_base") != F.col("ref_base"))
    turned = lambda c: exprs.strand(F.col(c), F.col("is_rev"))
    rows = rows.where(differ).select("rec_idx", "r_pos", "qual", "read_num", (F.col("r_pos") % 65536).alias("position"), turned("ref_base").alias("ref_base"), turned("read_base").alias("read_base"))
    keys = ["read_num", "position", "ref_base", "read_base"]
    met = rows.join(matrix.groupBy(*keys).agg(F.max("scaling_factor").alias("scaling_factor")), keys)
    scaled = F.round(F.col("qual").cast("float") * F.col("scaling_factor"))
    # a byte holds 0 to 255, and what is no number is 0
    new = F.least(F.when(F.isnan(scaled) | (scaled < 0), 0).when(scaled > 255, 255).otherwise(scaled).cast("int"), F.lit(config.max_quality))
    return met.select("rec_idx", "r_pos", new.alias("new_qual"))


def rescale(alignments: DataFrame, reference: DataFrame, matrix: DataFrame, config: RescaleConfig = RescaleConfig(), width: int = bases.WIDTH) -> DataFrame:
    """alignments with new qualities, unplaced records among them. Only changed bases are regrouped; records meet them by rec_idx."""
    changes = changed_bases(alignments, reference, matrix, config, width).groupBy("rec_idx").agg(F.map_from_entries(F.collect_list(F.struct("r_pos", "new_qual"))).alias("changes"))
    joined = alignments.join(changes, "rec_idx", "left")
    new = F.transform("qual", lambda q, i: F.coalesce(F.try_element_at("changes", i), q))
    return joined.withColumn("qual", F.when(F.col("changes").isNull(), F.col("qual")).otherwise(new)).select(*alignments.columns)


def in_order(records: DataFrame) -> DataFrame:
    """The order in which records are written: by place, unplaced ones last."""
    return records.orderBy(F.col("tid") < 0, "tid", "pos", "rec_idx")
