"""CIGAR strings and MD tags as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VALID = r"^(\d*[MIDNSHP=X])*$"
ON_REFERENCE, ON_READ, ALIGNED = ("M", "D", "N", "=", "X"), ("M", "I", "S", "=", "X"), ("M", "=", "X")


def operations(cigar: Column) -> Column:
    """array<struct<len: int, op: string>>; empty for "*"."""
    parts = F.regexp_extract_all(cigar, F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(0))
    return F.transform(parts, lambda x: F.struct(F.regexp_extract(x, r"(\d+)", 1).cast("int").alias("len"), F.substring(x, -1, 1).alias("op")))


def _total(ops: Column, kinds: tuple[str, ...]) -> Column:
    return F.aggregate(ops, F.lit(0).cast("long"), lambda a, x: a + F.when(x["op"].isin(*kinds), x["len"]).otherwise(0))


def span(ops: Column) -> Column:
    return _total(ops, ON_REFERENCE)


def text_span(cigar: Column) -> Column:
    """Reference bases under a CIGAR text; null if it is malformed, 0 if empty."""
    return F.when(cigar.rlike(VALID), span(operations(cigar)))


def segments(ops: Column, pos: Column) -> Column:
    """array<struct<read: long, genome: long, len: int, op>> of all operations, with the offsets at which they start."""
    start = F.struct(F.lit(0).cast("long").alias("read"), pos.cast("long").alias("genome"), F.array().cast("array<struct<read: bigint, genome: bigint, len: int, op: string>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        here = F.struct(a["read"].alias("read"), a["genome"].alias("genome"), x["len"].alias("len"), x["op"].alias("op"))
        forward = lambda kinds: F.when(x["op"].isin(*kinds), x["len"].cast("long")).otherwise(F.lit(0).cast("long"))
        return F.struct((a["read"] + forward(ON_READ)).alias("read"), (a["genome"] + forward(ON_REFERENCE)).alias("genome"), F.concat(a["out"], F.array(here)).alias("out"))

    return F.aggregate(ops, start, step)["out"]


def md_tag(md: Column) -> tuple[Column, Column]:
    """Mismatches array<struct<pos, base>> and matches array<struct<start, len>> of an MD tag; other characters are an error."""
    parts = F.regexp_extract_all(md, F.lit(r"\d+|\^[A-Za-z]+|[A-Za-z]"), F.lit(0))
    start = F.struct(F.lit(0).alias("pos"), F.array().cast("array<struct<pos: int, base: string>>").alias("miss"), F.array().cast("array<struct<start: int, len: int>>").alias("match"))

    def step(a: Column, x: Column) -> Column:
        number = F.when(x.rlike(r"^\d"), x.try_cast("int")).otherwise(0)
        letter = x.rlike("^[A-Za-z]")
        miss = F.when(letter, F.concat(a["miss"], F.array(F.struct(a["pos"].alias("pos"), F.upper(x).alias("base"))))).otherwise(a["miss"])
        match = F.when(number > 0, F.concat(a["match"], F.array(F.struct(a["pos"].alias("start"), number.alias("len"))))).otherwise(a["match"])
        return F.struct((a["pos"] + number + letter.cast("int")).alias("pos"), miss.alias("miss"), match.alias("match"))

    valid = F.when(md.rlike(r"^(\d+|\^[A-Za-z]*|[A-Za-z])*$"), F.aggregate(parts, start, step)).when(md.isNotNull(), F.raise_error(F.concat(F.lit("unexpected character in MD tag "), md)).cast("struct<pos: int, miss: array<struct<pos: int, base: string>>, match: array<struct<start: int, len: int>>>"))
    return valid["miss"], valid["match"]
