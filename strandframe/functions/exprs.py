"""Expressions over the columns of a read or of a base; none is a Python function at run time.

A condition on something that can be null (a mate's end, an overlap) is false where it is null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PAIRED, UNMAPPED, MATE_UNMAPPED, REVERSE, FIRST, LAST, SECONDARY, SUPPLEMENTARY = 0x1, 0x4, 0x8, 0x10, 0x40, 0x80, 0x100, 0x800


def has(bits: int, flag: str | Column = "flag") -> Column:
    """Whether all of these bits are set."""
    return (F.col(flag) if isinstance(flag, str) else flag).bitwiseAND(F.lit(bits)) == bits


def sure(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def complement(base: Column) -> Column:
    return F.translate(base, "ACGT", "TGCA")


def countable(base: Column) -> Column:
    return base.isin("A", "C", "G", "T")


def read_number() -> Column:
    return F.when(has(FIRST), 1).when(has(LAST), 2).otherwise(1)


def mapped_pair() -> Column:
    return has(PAIRED) & ~has(UNMAPPED) & ~has(MATE_UNMAPPED)


def reference_order(read_num: Column) -> Column:
    """1 if the read comes first on the reference, of the pair; equal places by read number."""
    here, there = F.struct("tid", "pos"), F.struct(F.col("mtid").alias("tid"), F.col("mpos").alias("pos"))
    return F.when(~has(PAIRED) | has(MATE_UNMAPPED), 1).when(here < there, 1).when(here > there, 2).otherwise(F.when(read_num == 1, 1).otherwise(2))


def mate_end(span: Column) -> Column:
    """span: reference bases under the mate, from its CIGAR."""
    known = has(PAIRED) & ~has(MATE_UNMAPPED) & (F.col("tid") >= 0) & (F.col("mtid") >= 0) & (F.col("tid") == F.col("mtid"))
    return F.when(known, F.col("mpos") + span)


def fragment_length(end: Column, mate: Column) -> Column:
    length = F.when(mate.isNotNull(), F.greatest(end, mate) - F.least("pos", "mpos"))
    return F.when(length > 0, length)


def overlap(start: Column, end: Column, other_start: Column, other_end: Column) -> tuple[Column, Column]:
    """Start and end of what two intervals share; nulls if nothing."""
    low, high = F.greatest(start, other_start), F.least(end, other_end)
    some = other_start.isNotNull() & other_end.isNotNull() & (low < high)
    return F.when(some, low), F.when(some, high)


def read_position(p: Column, length: Column, longest: Column, reverse: Column) -> Column:
    """From 1, counted from the read's start in its first half and from the longest read's end in its second."""
    early = p <= F.ceil(length / 2)
    return F.when(reverse & early, longest - p).when(reverse, length - p).when(early, p + 1).otherwise(p + longest - length + 1)


def insert_position(p: Column, length: Column, longest: Column, fragment: Column, order: Column, stretch: bool) -> Column:
    """Place on a fragment of twice the longest read; p is the offset as stored, whatever the strand."""
    short, trail, first = sure(fragment <= longest - 10), length - (p + 1), order == 1
    back = 2 * longest - trail
    late = (p >= F.floor(length / 2)) & short
    plain = F.when(first, F.when(late, back).otherwise(p + 1)).otherwise(F.when(late, p + 1).otherwise(back))
    if not stretch:
        return plain
    t = F.when(first, p).otherwise(length - 1 - p) / (length - 1)
    far = F.round(t * t * (3 - 2 * t) * (longest - 1)).cast("long")
    return F.when(length > 1, F.when(first, 1 + far).otherwise(2 * longest - far)).otherwise(plain)


def diagnostic_position(p: Column, length: Column, reverse: Column, read_num: Column, mode_length: int, insert_mode: bool) -> Column:
    """From 0, turned round on the reverse strand; may be negative in insert mode without a mode length."""
    q = F.when(reverse, length - p - 1).otherwise(p)
    if insert_mode:
        return F.when(read_num == 1, q).otherwise(2 * mode_length + 10 - (length - q))
    return F.when(q > F.floor(length / 2), q + mode_length - length).otherwise(q) if mode_length > 0 else q


def strand(base: Column, reverse: Column) -> Column:
    return F.when(reverse, complement(base)).otherwise(base)


def methylation_collapsed(ref: Column, read: Column, read_num: Column) -> Column:
    """The read base on the read's strand, or the reference's where the change is what bisulfite makes."""
    made = ((read_num == 1) & (ref == "C") & (read == "T")) | ((read_num == 2) & (ref == "G") & (read == "A"))
    return F.when(made, ref).otherwise(read)


def base_change(ref: Column, read: Column, reverse: Column, read_num: Column, methylation: bool = False) -> Column:
    r, b = strand(ref, reverse), strand(read, reverse)
    return F.concat(r, F.lit(">"), methylation_collapsed(r, b, read_num) if methylation else b)


def canonical(change: Column) -> Column:
    """X>Y with X one of A and C: changes of G and T are complemented."""
    turned = F.when(F.substring(change, 1, 1).isin("G", "T"), complement(change)).otherwise(change)
    return F.when((F.length(change) == 3) & (F.substring(change, 2, 1) == ">"), turned).otherwise(change)


def skipped(reads) -> Column:
    """Whether a read is left out. reads: ReadFilter."""
    out = has(UNMAPPED) | (F.col("mapq") < reads.min_map_quality)
    if reads.required_flags:
        out = out | ~has(reads.required_flags)
    if reads.filter_flags:
        out = out | (F.col("flag").bitwiseAND(F.lit(reads.filter_flags)) != 0)
    if reads.excl_flags:
        out = out | has(reads.excl_flags)
    if reads.primary_only:
        out = out | has(SECONDARY) | has(SUPPLEMENTARY)
    return out


def fixed6(value: Column) -> Column:
    """Six decimals, halves to even."""
    return F.regexp_replace(F.format_number(value, 6), ",", "")
