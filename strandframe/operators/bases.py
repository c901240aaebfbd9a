"""Reads joined with the reference, as a row for each base.

A read meets the reference once, by (contig, bin): never base by base. What is needed of a read is computed before its
bases are exploded, and a base's reference letter comes from the read's own slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.functions import cigar, exprs

#: Reference bases in a bin, unless a table says otherwise.
WIDTH = 16_384


def reference_bins(sequences: DataFrame, width: int = WIDTH) -> DataFrame:
    """contig, bin, bin_start, width, length (of the contig) and seq (width bases) of a table contig, seq."""
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.length("seq").cast("long") - 1, F.lit(0)), F.lit(width).cast("long"))
    rows = sequences.select("contig", F.length("seq").cast("long").alias("length"), "seq", F.explode(starts).alias("bin_start"))
    return rows.select("contig", F.expr(f"bin_start div {width}").alias("bin"), "bin_start", "length", F.expr(f"substring(seq, int(bin_start) + 1, {width})").alias("seq"))


def regions(contigs: DataFrame, size: int) -> DataFrame:
    """tid, contig, start, end of stretches of a contig; the last ends with it."""
    starts = F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long"))
    return contigs.where("length > 0").select("tid", "contig", F.explode(starts).alias("start"), "length").select("tid", "contig", "start", F.least(F.col("start") + size, "length").alias("end"))


def longest(alignments: DataFrame, sample: int) -> DataFrame:
    """n: the length of the longest of the first records of the file, whatever they are; 0 if there are none."""
    first = alignments.select("rec_idx", F.length("seq").alias("n")).orderBy("rec_idx").limit(sample)
    return first.agg(F.coalesce(F.max("n"), F.lit(0)).cast("long").alias("n"))


def longest_read(alignments: DataFrame, sample: int) -> int:
    return longest(alignments, sample).first()["n"]


def prepared(alignments: DataFrame) -> DataFrame:
    """alignments with ops, end, read_num, is_rev, seq_len."""
    return alignments.withColumns({"ops": cigar.operations(F.col("cigar")), "read_num": exprs.read_number(), "is_rev": exprs.has(exprs.REVERSE), "seq_len": F.length("seq").cast("long")}).withColumn("end", F.col("pos") + cigar.span(F.col("ops")))


def with_mates(reads: DataFrame) -> DataFrame:
    """prepared reads with reference_order, mate_end, frag_len, overlap_start and overlap_end, from the mate's fields."""
    reads = reads.withColumns({"mate_end": exprs.mate_end(cigar.text_span(F.col("mc"))), "reference_order": exprs.reference_order(F.col("read_num"))})
    low, high = exprs.overlap(F.col("pos"), F.col("end"), F.col("mpos"), F.col("mate_end"))
    return reads.withColumns({"frag_len": exprs.fragment_length(F.col("end"), F.col("mate_end")), "overlap_start": low, "overlap_end": high})


def on_reference(reads: DataFrame, reference: DataFrame, width: int = WIDTH) -> DataFrame:
    """A row for each read and bin that it touches, clips included, with the bin's part of the reference under it: ref_seq
    from ref_start to before ref_end, and contig_length. Contigs without a sequence go.

    Nearly all reads touch one bin. Any base is in one bin, so long reads and reads with skipped parts need no wider bins.
    """
    first, last = F.col("ops")[0], F.element_at("ops", -1)
    some = F.size("ops") > 0
    clip = lambda x: F.when(some, F.when(x["op"] == "S", x["len"]).otherwise(0)).otherwise(0).cast("long")
    reads = reads.withColumns({"from": F.greatest(F.col("pos") - clip(first), F.lit(0)), "to": F.col("end") + clip(last)})
    reads = reads.withColumn("bin", F.explode(F.sequence(F.expr(f"`from` div {width}"), F.expr(f"greatest(`from`, `to` - 1) div {width}"))))
    bins = reference.select("contig", "bin", "bin_start", F.col("length").alias("contig_length"), F.col("seq").alias("stretch"))
    joined = reads.join(bins, ["contig", "bin"])
    joined = joined.withColumns({"ref_start": F.greatest("from", "bin_start"), "ref_end": F.least("to", F.col("bin_start") + width)})
    part = F.col("stretch").substr((F.col("ref_start") - F.col("bin_start") + 1).cast("int"), F.greatest(F.col("ref_end") - F.col("ref_start"), F.lit(0)).cast("int"))
    return joined.withColumn("ref_seq", part).drop("stretch", "bin", "bin_start", "from", "to")


#: Bases of a read that go through the explode together, with their letters and qualities and nothing else of the read.
PIECE = 64


def _exploded(rows: DataFrame, keep: list[str]) -> DataFrame:
    """A row for each base of the stretch s whose reference base is in the row's part: keep's columns, r_pos, g_pos, read_base, ref_base, qual.

    The stretch is cut into pieces first, so that what is copied for a base doesn't grow with the read.
    """
    low, high = F.greatest(F.col("ref_start") - F.col("s.genome"), F.lit(0)), F.least(F.col("ref_end") - F.col("s.genome"), F.col("s.len").cast("long"))
    rows = rows.withColumns({"low": low, "high": high}).where("low < high")
    rows = rows.withColumn("at", F.explode(F.sequence("low", F.col("high") - 1, F.lit(PIECE).cast("long")))).withColumn("n", F.least(F.lit(PIECE), F.col("high") - F.col("at")).cast("int"))
    rows = rows.withColumns({"r_from": F.col("s.read") + F.col("at"), "g_from": F.col("s.genome") + F.col("at")})
    # a piece may end behind the read's last base: those bases have empty letters
    inside = lambda c, at: F.col(c).substr(at.cast("int") + 1, F.col("n"))
    pieces = rows.select(*keep, "r_from", "g_from", "n", inside("seq", F.col("r_from")).alias("letters"), inside("ref_seq", F.col("g_from") - F.col("ref_start")).alias("under"), F.slice("qual", F.col("r_from").cast("int") + 1, F.col("n")).alias("quals"))
    bases = pieces.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    letter = lambda c: F.col(c).substr(F.col("k") + 1, F.lit(1))
    return bases.select(*keep, (F.col("r_from") + F.col("k")).alias("r_pos"), (F.col("g_from") + F.col("k")).alias("g_pos"), letter("letters").alias("read_base"), letter("under").alias("ref_base"), F.get("quals", F.col("k")).alias("qual"))


def aligned(reads: DataFrame, keep: list[str], shift: Column | None = None) -> DataFrame:
    """A row for each base that is aligned to a reference base: keep's columns, r_pos, g_pos, read_base, ref_base (as it is written), qual.

    Bases past the ends of the sequence or of the contig have empty letters, past the qualities a null quality. r_pos, and with it the
    read's letter and quality, is shift places to the left if that is given.
    """
    parts = F.filter(cigar.segments(F.col("ops"), F.col("pos")), lambda s: s["op"].isin(*cigar.ALIGNED) & (s["len"] > 0))
    if shift is not None:
        parts = F.transform(parts, lambda s: F.struct((s["read"] - shift).alias("read"), s["genome"].alias("genome"), s["len"].alias("len")))
    return _exploded(reads.select(*keep, "seq", "qual", "ref_seq", "ref_start", "ref_end", F.explode(parts).alias("s")), keep)


def has_clips() -> Column:
    """Whether the very first or last operation of a read is a soft clip."""
    return (F.size("ops") > 0) & ((F.get("ops", F.lit(0))["op"] == "S") | (F.get("ops", F.size("ops") - 1)["op"] == "S"))


def clipped(reads: DataFrame, keep: list[str]) -> DataFrame:
    """As aligned(), for soft-clipped ends laid on the reference beside the read, with side (left, right).

    A side counts only if the clip is the very first or last operation and lies within the read and the contig; bases
    that aren't ACGT (the reference in upper case) go.
    """
    first, last = F.col("ops")[0], F.element_at("ops", -1)
    some = F.size("ops") > 0
    left = F.when(some & (first["op"] == "S") & (F.col("pos") >= first["len"]) & (F.col("pos") <= F.col("contig_length")) & (first["len"] <= F.col("seq_len")), F.struct(F.lit("left").alias("side"), F.lit(0).cast("long").alias("read"), (F.col("pos") - first["len"]).alias("genome"), first["len"].alias("len")))
    right_read = F.col("seq_len") - last["len"]
    right = F.when(some & (F.size("ops") > 1) & (last["op"] == "S") & (F.col("end") + last["len"] <= F.col("contig_length")) & (right_read >= 0), F.struct(F.lit("right").alias("side"), right_read.alias("read"), F.col("end").alias("genome"), last["len"].alias("len")))
    sides = F.filter(F.array(left, right), lambda s: s.isNotNull() & (s["len"] > 0))
    rows = reads.select(*keep, "seq", "qual", "ref_seq", "ref_start", "ref_end", F.explode(sides).alias("s")).withColumn("side", F.col("s.side"))
    rows = _exploded(rows, [*keep, "side"]).withColumn("ref_base", F.upper("ref_base"))
    return rows.where(exprs.countable(F.col("read_base")) & exprs.countable(F.col("ref_base")))
