"""SAM text: header and records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandframe.sources.lines import fields, numbered
from strandframe.staging import written


def read_contigs(spark: SparkSession, path: str) -> DataFrame:
    """tid, contig, length of the @SQ lines, in order."""
    rows = numbered(spark, path).where(F.col("line").startswith("@SQ\t"))
    of = lambda tag: F.regexp_extract("line", rf"\t{tag}:([^\t]+)", 1)
    return rows.select((F.row_number().over(W.orderBy("line_no")) - 1).cast("int").alias("tid"), of("SN").alias("contig"), of("LN").cast("long").alias("length"))


def read_header(spark: SparkSession, path: str) -> list[str]:
    return [r["line"] for r in numbered(spark, path).where(F.col("line").startswith("@")).orderBy("line_no").collect()]


def _qualities(text: Column, seq: Column) -> Column:
    """Missing qualities are 255 each, as in BAM."""
    known = F.transform(F.split(text, ""), lambda c: F.ascii(c) - 33)
    return F.when(text == "*", F.array_repeat(F.lit(255), F.length(seq))).otherwise(F.filter(known, lambda q: q >= 0))


def read_alignments(spark: SparkSession, path: str) -> DataFrame:
    """Records by schema.ALIGNMENTS; rec_idx numbers them in file order. Positions count from 0; no contig is tid -1."""
    rows = fields(numbered(spark, path).where(~F.col("line").startswith("@") & (F.col("line") != "")))
    f = lambda i: F.get("f", F.lit(i))
    seq = F.when(f(9) == "*", "").otherwise(f(9))
    rest = F.slice("f", 12, 10_000)
    contigs = written(read_contigs(spark, path), "contigs")  # few rows, looked up twice: the file is read once for them
    records = rows.select(
        F.col("line_no").alias("rec_idx"), f(0).alias("qname"), f(1).cast("int").alias("flag"), f(2).alias("contig"), (f(3).cast("long") - 1).alias("pos"), f(4).cast("int").alias("mapq"), f(5).alias("cigar"),
        F.when(f(6) == "=", f(2)).otherwise(f(6)).alias("next"), (f(7).cast("long") - 1).alias("mpos"), seq.alias("seq"), _qualities(f(10), seq).alias("qual"),
        F.get(F.filter(rest, lambda x: x.startswith("MC:Z:")), F.lit(0)).substr(6, 1 << 20).alias("mc"), F.array_join(rest, "\t").alias("tags"), f(8).cast("int").alias("tlen"),
    )
    tids, nexts = contigs.select("contig", "tid"), contigs.select(F.col("contig").alias("next"), F.col("tid").alias("mtid"))
    joined = records.join(tids, "contig", "left").join(nexts, "next", "left")
    minus = lambda c: F.coalesce(c, F.lit(-1)).alias(c)
    return joined.select("rec_idx", "qname", "flag", minus("tid"), "contig", "pos", "mapq", "cigar", minus("mtid"), "mpos", "seq", "qual", "mc", "tags", F.col("next").alias("mcontig"), "tlen")


def line(records: DataFrame) -> Column:
    """The SAM line of a record."""
    qual = F.when((F.size("qual") == 0) | (F.get("qual", F.lit(0)) == 255), "*").otherwise(F.array_join(F.transform("qual", lambda q: F.char(q + 33)), ""))
    here = F.when(F.col("tid") < 0, "*").otherwise(F.col("contig"))
    there = F.when(F.col("mtid") < 0, "*").when(F.col("mtid") == F.col("tid"), "=").otherwise(F.coalesce("mcontig", F.lit("*")))
    # SAM has one kind of integers; BAM's six widths are kept in tags
    tags = F.regexp_replace("tags", r"(^|\t)([^\t]{2}):[cCsSI]:", "$1$2:i:")
    star = lambda c: F.when(c == "", "*").otherwise(c)
    cells = [F.col("qname"), F.col("flag").cast("string"), here, (F.col("pos") + 1).cast("string"), F.col("mapq").cast("string"), F.col("cigar"), there, (F.col("mpos") + 1).cast("string"), F.coalesce("tlen", F.lit(0)).cast("string"), star(F.col("seq")), qual]
    return F.concat(F.concat_ws("\t", *cells), F.when(F.col("tags") != "", F.concat(F.lit("\t"), tags)).otherwise(""))
