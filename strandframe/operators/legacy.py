"""Operators that no query uses, kept for users of the functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.config import DiagnosticsConfig
from strandframe.functions import exprs
from strandframe.operators import bases, intervals


def insert_merged(counts: DataFrame, longest: int) -> DataFrame:
    """mismatch_type, read_position, read_num, count added up by canonical type and place on the insert: mismatch_type, insert_position, count."""
    place = F.when(F.col("read_num") == 1, F.col("read_position")).otherwise(2 * longest + 10 - F.col("read_position"))
    return counts.groupBy(exprs.canonical(F.col("mismatch_type")).alias("mismatch_type"), place.alias("insert_position")).agg(F.sum("count").cast("long").alias("count"))


def wide_positions(counts: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Read, Position and a column for each mismatch_type, sorted; missing counts are 0. types: the columns, if they are known."""
    grouped = counts.groupBy(F.col("read_num").alias("Read"), F.col("read_position").alias("Position")).pivot("mismatch_type", types)
    return grouped.agg(F.sum("count").cast("long")).na.fill(0)


def wide_inconsistencies(counts: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Read1_Pos, Read2_Pos and a column for each discordance_type."""
    grouped = counts.groupBy(F.col("read1_position").alias("Read1_Pos"), F.col("read2_position").alias("Read2_Pos")).pivot("discordance_type", types)
    return grouped.agg(F.sum("count").cast("long")).na.fill(0)


def clip_mismatches(reads: DataFrame, reference: DataFrame, config: DiagnosticsConfig, bed: DataFrame | None = None, width: int = bases.WIDTH) -> DataFrame:
    """Mismatches in soft clips whose bases of sufficient quality agree with the reference to softclip_threshold: mismatch_type, read_num, read_position, count."""
    from pyspark.sql import Window as W

    reference = reference if bed is None else intervals.masked_reference(reference, bed, width)
    rows = bases.clipped(bases.on_reference(reads, reference, width), ["rec_idx", "contig", "read_num", "is_rev", "seq_len"])
    rows = rows.where(F.col("qual") >= config.min_base_quality)
    identity = F.avg((F.col("read_base") == F.col("ref_base")).cast("double")).over(W.partitionBy("rec_idx", "side"))
    rows = rows.withColumn("identity", identity).where((F.col("identity") >= config.softclip_threshold) & (F.col("read_base") != F.col("ref_base")))
    change = exprs.base_change(F.col("ref_base"), F.col("read_base"), F.col("is_rev"), F.col("read_num"), config.methylation)
    place = exprs.diagnostic_position(F.col("r_pos"), F.col("seq_len"), F.col("is_rev"), F.col("read_num"), config.mode_length, config.insert_mode)
    return rows.groupBy(change.alias("mismatch_type"), "read_num", place.cast("long").alias("read_position")).agg(F.count(F.lit(1)).alias("count"))


def overlap_mismatches(reads: DataFrame, reference: DataFrame, config: DiagnosticsConfig, width: int = bases.WIDTH) -> DataFrame:
    """Mismatches inside the overlaps of routed pairs, both records in full: mismatch_type, read_num, read_position, count."""
    keep = ["pair", "read_num", "is_rev", "seq_len", "overlap_start", "overlap_end"]
    rows = bases.aligned(bases.on_reference(reads.where("pair is not null"), reference, width), keep)
    differ = exprs.countable(F.col("read_base")) & exprs.countable(F.col("ref_base")) & (F.col("read_base") != F.col("ref_base"))
    rows = rows.where(differ & (F.col("qual") >= config.min_base_quality) & (F.col("g_pos") >= F.col("overlap_start")) & (F.col("g_pos") < F.col("overlap_end")))
    change = exprs.base_change(F.col("ref_base"), F.col("read_base"), F.col("is_rev"), F.col("read_num"), config.methylation)
    place = exprs.diagnostic_position(F.col("r_pos"), F.col("seq_len"), F.col("is_rev"), F.col("read_num"), config.mode_length, config.insert_mode)
    return rows.groupBy(change.alias("mismatch_type"), "read_num", place.cast("long").alias("read_position")).agg(F.count(F.lit(1)).alias("count"))
