"""Mismatch counts by base change, read, order on the reference and position, and what is made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandframe.config import MismatchConfig, check_bed_mode
from strandframe.functions import exprs
from strandframe.operators import bases, intervals

_KEEP = ["rec_idx", "contig", "read_num", "is_rev", "seq_len", "reference_order", "frag_len", "overlap_start", "overlap_end"]


def _reads(alignments: DataFrame, config: MismatchConfig, bed: DataFrame | None, contigs: DataFrame | None) -> DataFrame:
    reads = bases.prepared(alignments.where((F.col("tid") >= 0) & ~exprs.skipped(config.reads)))
    if bed is not None and check_bed_mode(config.bed_mode) == "filter":
        reads = intervals.without_reads(reads, bed, config.region_size, contigs)
    return bases.with_mates(reads)


def _aligned(reads: DataFrame, config: MismatchConfig) -> DataFrame:
    rows = bases.aligned(reads, _KEEP).withColumn("ref_base", F.upper("ref_base"))
    rows = rows.where(exprs.countable(F.col("read_base")) & exprs.countable(F.col("ref_base")))
    if config.overlap_mode == "cut":
        inside = exprs.sure((F.col("g_pos") >= F.col("overlap_start")) & (F.col("g_pos") < F.col("overlap_end")))
        rows = rows.where(~((F.col("read_num") == 2) & inside))
    return rows.withColumn("source", F.lit("align"))


def aligned_bases(alignments: DataFrame, reference: DataFrame, config: MismatchConfig, width: int = bases.WIDTH, bed: DataFrame | None = None, contigs: DataFrame | None = None) -> DataFrame:
    """The aligned bases that count, without clips; narrow but for the joins with the reference and, in filter mode, the intervals.
    A mask is laid on the reference beforehand."""
    return _aligned(bases.on_reference(_reads(alignments, config, bed, contigs), reference, width), config)


def placed(rows: DataFrame, config: MismatchConfig, longest: int | Column) -> DataFrame:
    """Bases of sufficient quality as base_change, read_num, reference_order, base_position, source."""
    length, top = F.col("seq_len"), (F.lit(longest) if isinstance(longest, int) else longest).cast("long")
    if config.position_mode == "read":
        place = exprs.read_position(F.col("r_pos"), length, top, F.col("is_rev"))
    else:
        place = exprs.insert_position(F.col("r_pos"), length, top, F.col("frag_len"), F.col("reference_order"), config.overlap_mode == "stretch")
    change = exprs.base_change(F.col("ref_base"), F.col("read_base"), F.col("is_rev"), F.col("read_num"), config.methylation)
    good = rows.where(F.col("qual") >= config.min_base_quality)
    return good.select(change.alias("base_change"), "read_num", "reference_order", place.cast("long").alias("base_position"), "source")


def counted_bases(alignments: DataFrame, reference: DataFrame, config: MismatchConfig, longest: int | None = None, bed: DataFrame | None = None, contigs: DataFrame | None = None, width: int = bases.WIDTH) -> DataFrame:
    """A row for each base that counts: base_change, read_num, reference_order, base_position, source (align, clip).

    Without longest it is a scalar of the same plan; nothing runs while the query is built. Masked bases have no letter in the reference.
    """
    if bed is not None and check_bed_mode(config.bed_mode) == "mask":
        reference = intervals.masked_reference(reference, bed, width)
    reads = _reads(alignments, config, bed, contigs)
    # few reads have clips: only those go a second time to the reference
    with_clips = bases.on_reference(reads.where(bases.has_clips()), reference, width)
    clips = bases.clipped(with_clips, _KEEP)
    matches = F.avg((F.col("read_base") == F.col("ref_base")).cast("double")).over(W.partitionBy("rec_idx", "side"))
    clips = clips.withColumn("identity", matches).where(F.col("identity") >= config.softclip_identity).drop("identity", "side")
    top = bases.longest(alignments, config.length_sample).scalar() if longest is None else longest
    return placed(_aligned(bases.on_reference(reads, reference, width), config).unionByName(clips.withColumn("source", F.lit("clip"))), config, top)


def mismatch_counts(alignments: DataFrame, reference: DataFrame, config: MismatchConfig = MismatchConfig(), bed: DataFrame | None = None, contigs: DataFrame | None = None, longest: int | None = None, width: int = bases.WIDTH) -> DataFrame:
    """base_change, read_num, reference_order, base_position, count; matches count too."""
    rows = counted_bases(alignments, reference, config, longest, bed, contigs, width)
    return rows.groupBy("base_change", "read_num", "reference_order", "base_position").agg(F.count(F.lit(1)).alias("count"))


def apply_discounts(counts: DataFrame, discounts: DataFrame) -> DataFrame:
    """Takes discounts from the counts of their key: from the larger of the two orders first (order 1 if equal), the rest from
    the other, never below zero. Rows that come to zero stay."""
    key = ["base_change", "read_num", "base_position"]
    table = discounts.groupBy(*key).agg(F.sum("discount_count").alias("d"))
    joined = counts.join(table, key, "left").withColumn("other", F.sum("count").over(W.partitionBy(*key)) - F.col("count"))
    c, o, d = F.col("count"), F.col("other"), F.coalesce("d", F.lit(0))
    first = F.when(F.col("reference_order") == 1, c >= o).otherwise(c > o)
    left = F.when(first, F.greatest(c - d, F.lit(0))).otherwise(c - F.least(c, F.greatest(d - o, F.lit(0))))
    return joined.select("base_change", "read_num", "reference_order", "base_position", left.cast("long").alias("count"))


def touched_keys(counts: DataFrame, discounts: DataFrame) -> DataFrame:
    """How many keys apply_discounts() changes: those with a discount and a count above zero."""
    key = ["base_change", "read_num", "base_position"]
    return counts.where("count > 0").select(*key).distinct().join(discounts.select(*key).distinct(), key, "left_semi").agg(F.count(F.lit(1)).alias("touched"))


def normalized(counts: DataFrame) -> DataFrame:
    """Each count over all of its read, position and reference base, both orders together."""
    total = F.sum("count").over(W.partitionBy("read_num", "base_position", F.substring("base_change", 1, 1)))
    return counts.withColumn("total", total).select("base_change", "read_num", "reference_order", "base_position", F.when(F.col("total") == 0, 0.0).otherwise(F.col("count") / F.col("total")).alias("normalized_frequency"))


def rescaling_matrix(frequencies: DataFrame, factor=None) -> DataFrame:
    """read_num, position, ref_base, read_base, scaling_factor: factor (a column; one if None) for each key that occurs. Positions are 16 bits wide."""
    rows = frequencies.select("read_num", (F.col("base_position") % 65536).cast("int").alias("position"), F.substring("base_change", 1, 1).alias("ref_base"), F.substring("base_change", 3, 1).alias("read_base"), (F.lit(1.0) if factor is None else factor).cast("float").alias("scaling_factor"))
    return rows.dropDuplicates(["read_num", "position", "ref_base", "read_base"])


def report(counts: DataFrame, discounts: DataFrame | None = None, normalize: bool = False, matrix: bool = False) -> tuple[str, DataFrame]:
    """What is to be written, and its kind: matrix before normalized before raw; discounts come first."""
    if discounts is not None:
        counts = apply_discounts(counts, discounts)
    if matrix:
        return "matrix", rescaling_matrix(normalized(counts))
    return ("normalized", normalized(counts)) if normalize else ("raw", counts)
