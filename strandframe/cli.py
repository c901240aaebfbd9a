"""Command line: python -m strandframe.cli {mismatch,diagnostics,rescale} ... ("-" is standard input or output)."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from strandframe.config import DiagnosticsConfig, MismatchConfig, ReadFilter, RescaleConfig
from strandframe.operators import bases, diagnostics, mismatch, plotprep, rescale
from strandframe.sources import bam, fasta, sam, sinks, tables


def _alignments(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    source = bam if path.endswith(".bam") else sam
    return source.read_alignments(spark, path), source.read_contigs(spark, path)


def _reads(a, primary_only: bool) -> ReadFilter:
    return ReadFilter(a.min_map_quality, a.required_flags, a.filter_flags, a.excl_flags, primary_only)


def _mismatch(spark: SparkSession, a) -> None:
    reads, contigs = _alignments(spark, a.alignments)
    config = MismatchConfig(_reads(a, False), a.min_base_quality, a.position_mode, a.overlap_mode, a.methylation_mode, region_size=a.region_size, bed_mode=a.bed_filter_mode, min_fragment_length=a.min_fragment_length, max_fragment_length=a.max_fragment_length)
    counts = mismatch.mismatch_counts(reads, fasta.read_bins(spark, a.reference), config, tables.maybe_bed(spark, a.bed_file), contigs)
    kind, table = mismatch.report(counts, tables.read_discounts(spark, a.discount_table) if a.discount_table else None, a.normalize, a.emit_rescaling_matrix)
    insert = config.position_mode == "insert"
    if a.plot and kind != "matrix":
        y = "count" if kind == "raw" else "normalized_frequency"
        sinks.write_series(plotprep.zero_filled(plotprep.prepared(table.withColumnRenamed("base_position", "position"), y, insert)), a.plot)
    {"raw": lambda: sinks.write_counts(table, a.output, insert), "normalized": lambda: sinks.write_normalized(table, a.output, insert), "matrix": lambda: sinks.write_matrix(table, a.output)}[kind]()


def _diagnostics(spark: SparkSession, a) -> None:
    reads, contigs = _alignments(spark, a.alignments)
    length = a.use_read_len_max
    length = bases.longest_read(reads, 100_000) if length == "sample" else int(length or 0)
    config = DiagnosticsConfig(_reads(a, True), a.min_base_quality, a.use_insert_mode, length, a.methylation, a.genomic_threshold, a.genomic_depth_threshold, a.region_size, a.bed_filter_mode, a.softclip_threshold)
    found = diagnostics.diagnose(reads, fasta.read_bins(spark, a.reference), config, tables.maybe_bed(spark, a.bed_file), contigs)
    sinks.write_variants(found["variants"], a.variants_output)
    sinks.write_inconsistencies(found["inconsistencies"], a.inconsistencies_output)
    sinks.write_discounts(found["discounts"], a.discount_output)


def _rescale(spark: SparkSession, a) -> None:
    reads, contigs = _alignments(spark, a.alignments)
    out = rescale.rescale(reads, fasta.read_bins(spark, a.reference), tables.read_matrix(spark, a.matrix), RescaleConfig())
    if a.alignments.endswith(".bam"):
        text, names, _ = bam.header(a.alignments)
    else:
        text, names = "".join(f"{x}\n" for x in sam.read_header(spark, a.alignments)), [(r["contig"], r["length"]) for r in contigs.orderBy("tid").collect()]
    if a.output.endswith(".bam"):
        bam.write_alignments(out, text, names, a.output)
    else:
        sinks.write_sam(out, text.splitlines(), a.output)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strandframe")
    p.add_argument("--master", default=None, help="Spark master, such as local[8]")
    sub = p.add_subparsers(dest="query", required=True)

    def common(name: str, region: int):
        s = sub.add_parser(name)
        s.add_argument("alignments", help="SAM or BAM")
        s.add_argument("reference", help="FASTA")
        s.add_argument("-r", "--region-size", type=int, default=region)
        s.add_argument("-t", "--threads", type=int, default=0, help="threads on this machine, if there is no --master; 0: as Spark is set up")
        return s

    def filters(s, short: bool) -> None:
        s.add_argument("-q", "--min-base-quality", type=int, default=20)
        s.add_argument(*(["-m"] if short else []), "--min-map-quality", type=int, default=10)
        s.add_argument("-f", "--required-flags", type=int, default=0)
        s.add_argument("-F", "--filter-flags", type=int, default=0)
        s.add_argument("-G", "--excl-flags", type=int, default=0)
        s.add_argument("-b", "--bed-file")
        s.add_argument("--bed-filter-mode", default="mask")

    m = common("mismatch", 1_000_000)
    filters(m, True)
    m.add_argument("--overlap-mode", choices=("cut", "stretch"), default="cut")
    m.add_argument("--position-mode", choices=("read", "insert"), default="insert")
    m.add_argument("--methylation-mode", action="store_true")
    m.add_argument("--min-fragment-length", type=int, default=0)
    m.add_argument("--max-fragment-length", type=int, default=1500)
    m.add_argument("--discount-table")
    m.add_argument("--normalize", action="store_true")
    m.add_argument("--emit-rescaling-matrix", action="store_true")
    m.add_argument("-o", "--output", default="-")
    m.add_argument("--plot", metavar="FILE", help="write the series behind a plot of the counts as a table (nothing is drawn)")
    d = common("diagnostics", 10_000_000)
    filters(d, False)
    d.add_argument("-m", "--methylation", action="store_true")
    d.add_argument("--use-insert-mode", action="store_true")
    d.add_argument("--use-read-len-max", nargs="?", const="sample")
    d.add_argument("--softclip-threshold", type=float, default=0.66)
    d.add_argument("--genomic-threshold", type=int, default=7)
    d.add_argument("--genomic-depth-threshold", type=int, default=10)
    d.add_argument("--variants-output", default="potential_variants.tsv")
    d.add_argument("--inconsistencies-output", default="read_pair_inconsistencies.tsv")
    d.add_argument("--discount-output", default="variant_discounts.tsv")
    r = common("rescale", 10_000_000)
    r.add_argument("matrix")
    r.add_argument("-o", "--output", default="-")
    return p


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(arguments)
    if spark is None:
        builder = SparkSession.builder.appName(f"strandframe {a.query}")
        master = a.master or (f"local[{a.threads}]" if a.threads else None)
        spark = (builder.master(master) if master else builder).getOrCreate()
    {"mismatch": _mismatch, "diagnostics": _diagnostics, "rescale": _rescale}[a.query](spark, a)


if __name__ == "__main__":
    main()
