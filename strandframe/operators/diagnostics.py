"""Sites with mismatches and their depth, disagreements of read pairs, and the discounts that follow.

Pairs are made within a chunk: a read belongs to the chunk in which it starts, thresholds hold in each chunk, and a site that
passes in two chunks keeps the row of the later one (discounts of both count).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandframe.config import DiagnosticsConfig, check_bed_mode
from strandframe.functions import cigar, exprs
from strandframe.operators import bases, intervals


def routed(alignments: DataFrame, config: DiagnosticsConfig, bed: DataFrame | None = None, contigs: DataFrame | None = None) -> DataFrame:
    """Reads that count, as grouped() has them: flags and quality are looked at after pairs are made."""
    return grouped(alignments, config, bed, contigs).where(~exprs.skipped(config.reads))


def grouped(alignments: DataFrame, config: DiagnosticsConfig, bed: DataFrame | None = None, contigs: DataFrame | None = None) -> DataFrame:
    """Reads with chunk, pair (null: single), record (1 or 2) and the pair's overlap.

    A pair is two mapped reads of one name that overlap, both mates mapped, in one chunk, and no third one.
    """
    reads = bases.prepared(alignments.where(F.col("tid") >= 0)).withColumn("chunk", F.expr(f"pos div {config.region_size}"))
    if bed is not None and check_bed_mode(config.bed_mode) == "filter":
        reads = intervals.without_reads(reads, bed, config.region_size, contigs)
    pairable = exprs.mapped_pair()
    group = W.partitionBy("chunk", "contig", "qname", pairable)
    order = group.orderBy("rec_idx")
    lead = lambda c: F.first(c).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    last = lambda c: F.last(c).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    low, high = exprs.overlap(lead("pos"), lead("end"), last("pos"), last("end"))
    is_pair = pairable & (F.count(F.lit(1)).over(group) == 2)
    reads = reads.withColumns({"overlap_start": F.when(is_pair, low), "overlap_end": F.when(is_pair, high), "record": F.row_number().over(order), "pair": F.min("rec_idx").over(group)})
    joined = F.col("overlap_start").isNotNull()
    return reads.withColumns({"record": F.when(joined, F.col("record")), "pair": F.when(joined, F.col("pair"))})


def read_counters(reads: DataFrame) -> DataFrame:
    """total_records and overlap_pairs of grouped() reads."""
    return reads.agg(F.count(F.lit(1)).alias("total_records"), F.count_if(F.col("record") == 1).alias("overlap_pairs"))


_KEEP = ["contig", "chunk", "pair", "record", "overlap_start", "overlap_end", "read_num", "is_rev", "seq_len"]


def _inside() -> Column:
    return exprs.sure((F.col("g_pos") >= F.col("overlap_start")) & (F.col("g_pos") < F.col("overlap_end")))


#: Stands in the reference for bases that are left out.
_GONE = "."


def base_rows(reads: DataFrame, reference: DataFrame, bed: DataFrame | None = None, mode: str = "mask", width: int = bases.WIDTH) -> DataFrame:
    """Bases of routed reads with in_overlap; masked bases have reference N in mask mode and are left out in filter mode."""
    if bed is not None:
        reference = intervals.masked_reference(reference, bed, width, _GONE if mode == "filter" else "N")
    rows = bases.aligned(bases.on_reference(reads, reference, width), _KEEP).withColumn("in_overlap", _inside())
    return rows.where(F.col("ref_base") != _GONE) if bed is not None and mode == "filter" else rows


_SITE = ["chunk", "contig", "g_pos"]


def site_table(rows: DataFrame, config: DiagnosticsConfig) -> DataFrame:
    """chunk, contig, g_pos, depth and keys, in one pass over the bases: sums by site and key first, then a site's few sums together.

    depth counts bases of any quality; the first record of a pair counts double where the two overlap, the second not. keys are
    the distinct (mismatch_type, read_num, read_position) of bases that differ, outside of overlaps, of single reads and first
    records: at most 24 a position of a read, so a site's list is small however deep the site is.
    """
    weight = F.when(F.col("in_overlap"), F.when(F.col("record") == 1, 2).otherwise(0)).otherwise(1)
    differ = exprs.countable(F.col("read_base")) & exprs.countable(F.col("ref_base")) & (F.col("read_base") != F.col("ref_base"))
    counted = differ & (F.col("qual") >= config.min_base_quality) & ~F.col("in_overlap") & exprs.sure(F.col("record").isNull() | (F.col("record") == 1))
    change = exprs.base_change(F.col("ref_base"), F.col("read_base"), F.col("is_rev"), F.col("read_num"), config.methylation)
    place = exprs.diagnostic_position(F.col("r_pos"), F.col("seq_len"), F.col("is_rev"), F.col("read_num"), config.mode_length, config.insert_mode)
    key = {"mismatch_type": change, "read_num": F.col("read_num"), "read_position": place.cast("long")}
    sums = rows.groupBy(*_SITE, *(F.when(counted, c).alias(n) for n, c in key.items())).agg(F.sum(weight).cast("long").alias("weight"))
    return sums.groupBy(*_SITE).agg(F.sum("weight").alias("depth"), F.collect_list(F.when(F.col("mismatch_type").isNotNull(), F.struct(*key))).alias("keys"))


def depth(sites: DataFrame) -> DataFrame:
    return sites.where("depth > 0").select(*_SITE, "depth")


def mismatch_keys(sites: DataFrame) -> DataFrame:
    """chunk, contig, g_pos, mismatch_type, read_num, read_position of a site_table()."""
    return sites.select(*_SITE, F.explode("keys").alias("key")).select(*_SITE, "key.*")


def passing_keys(sites: DataFrame, config: DiagnosticsConfig) -> DataFrame:
    """Keys of the sites over both thresholds, with count (the distinct keys of the site's mismatch type, not reads) and depth. No
    shuffle is needed: a site's keys are together."""
    rows = sites.where(F.col("depth") >= config.min_depth).select(*_SITE, "depth", F.explode("keys").alias("key")).select(*_SITE, "depth", "key.*")
    alike = F.count(F.lit(1)).over(W.partitionBy(*_SITE, "mismatch_type"))
    return rows.withColumn("count", alike).where(F.col("count") >= config.min_count)


def passing_sites(keys: DataFrame) -> DataFrame:
    """chunk, contig, g_pos, mismatch_type, count and depth of passing_keys()."""
    return keys.groupBy(*_SITE, "mismatch_type").agg(F.first("count").alias("count"), F.first("depth").alias("depth"))


def variants(sites: DataFrame) -> DataFrame:
    """chromosome, position (from 0), reference_base and mismatch_base (on the read's strand), count, depth."""
    last = sites.groupBy("contig", "g_pos", "mismatch_type").agg(F.max_by(F.struct("count", "depth"), "chunk").alias("x"))
    parts = F.split("mismatch_type", ">")
    return last.where(F.size(parts) == 2).select(F.col("contig").alias("chromosome"), F.col("g_pos").alias("position"), parts[0].alias("reference_base"), parts[1].alias("mismatch_base"), "x.count", "x.depth")


def discounts(keys: DataFrame) -> DataFrame:
    """mismatch_type, read_num, read_position, discount_count: of each passing site, one for each of its keys."""
    return keys.groupBy("mismatch_type", "read_num", "read_position").agg(F.count(F.lit(1)).alias("discount_count"))


def inconsistencies(reads: DataFrame, config: DiagnosticsConfig) -> DataFrame:
    """read1_position, read2_position (offsets as stored, from 0), discordance_type, count: where the records of a pair differ.

    The pair meets as two reads, and only the places where they differ become rows; no reference is needed, and intervals mask nothing here.
    """
    parts = F.filter(cigar.segments(F.col("ops"), F.col("pos")), lambda s: s["op"].isin(*cigar.ALIGNED) & (s["len"] > 0))
    rows = reads.where("pair is not null").select("pair", "record", F.col("seq").cast("binary").alias("seq"), "qual", parts.alias("parts"), "overlap_start", "overlap_end")
    side = lambda n: rows.where(F.col("record") == n).select("pair", *([] if n == 2 else ["overlap_start", "overlap_end"]), *(F.col(c).alias(f"{c}{n}") for c in ("seq", "qual", "parts")))
    met = side(1).join(side(2), "pair")

    def shared(s: Column, t: Column) -> Column:
        """Places (offsets in both) of the stretch that two parts share with the overlap."""
        low = F.greatest(F.col("overlap_start"), s["genome"], t["genome"])
        high = F.least(F.col("overlap_end"), s["genome"] + s["len"], t["genome"] + t["len"])
        return F.when(low < high, F.transform(F.sequence(low, high - 1), lambda g: F.struct((s["read"] + g - s["genome"]).cast("int").alias("x"), (t["read"] + g - t["genome"]).cast("int").alias("y")))).otherwise(F.array().cast("array<struct<x: int, y: int>>"))

    places = F.flatten(F.transform("parts1", lambda s: F.flatten(F.transform("parts2", lambda t: shared(s, t)))))
    base = lambda n, at: F.substring(f"seq{n}", at + 1, F.lit(1))
    good = lambda n, at: F.get(f"qual{n}", at) >= config.min_base_quality
    differ = F.filter(places, lambda p: exprs.sure((base(1, p["x"]) != base(2, p["y"])) & good(1, p["x"]) & good(2, p["y"])))
    found = met.select(F.explode(differ).alias("p"), "seq1", "seq2").select("p", base(1, F.col("p.x")).cast("string").alias("a"), base(2, F.col("p.y")).cast("string").alias("b"))
    letter = lambda c: F.when(exprs.countable(F.col(c)), F.col(c)).otherwise("N")
    kind = F.concat(F.lit("R1:"), letter("a"), F.lit("_R2:"), letter("b"))
    return found.groupBy(F.col("p.x").cast("long").alias("read1_position"), F.col("p.y").cast("long").alias("read2_position"), kind.alias("discordance_type")).agg(F.count(F.lit(1)).alias("count"))


def diagnose(alignments: DataFrame, reference: DataFrame, config: DiagnosticsConfig = DiagnosticsConfig(), bed: DataFrame | None = None, contigs: DataFrame | None = None, width: int = bases.WIDTH) -> dict[str, DataFrame]:
    """depth, keys, sites, variants, discounts and inconsistencies."""
    reads = routed(alignments, config, bed, contigs)
    table = site_table(base_rows(reads, reference, bed, config.bed_mode, width), config)
    passing = passing_keys(table, config)
    sites = passing_sites(passing)
    return {"depth": depth(table), "keys": mismatch_keys(table), "sites": sites, "variants": variants(sites), "discounts": discounts(passing), "inconsistencies": inconsistencies(reads, config)}
