"""Mismatch counts over a stream of alignments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.config import MismatchConfig, check_bed_mode
from strandframe.operators import bases, intervals, mismatch


def running_counts(alignments: DataFrame, reference: DataFrame, config: MismatchConfig, longest: int, width: int = bases.WIDTH, bed: DataFrame | None = None, contigs: DataFrame | None = None) -> DataFrame:
    """Counts over all records so far, for output mode update or complete. Clips need a window over a read's bases, which
    streams don't have, so reads are taken by their aligned bases; longest is given, as there is no first part of a stream to sample. reference is a
    table that was written (fasta.read_bins() numbers lines, which a stream's plan may not). Intervals are a table like the
    reference: they mask it, or leave out the reads that touch them (contigs, also a written table, are needed then), by config.bed_mode."""
    if bed is not None and check_bed_mode(config.bed_mode) == "mask":
        reference = intervals.masked_reference(reference, bed, width)
    rows = mismatch.aligned_bases(alignments, reference, config, width, bed, contigs)
    return mismatch.placed(rows, config, longest).groupBy("base_change", "read_num", "reference_order", "base_position").agg(F.count(F.lit(1)).alias("count"))
