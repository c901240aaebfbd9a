"""Interval tables: half-open [start, end) on a contig.

Masks are laid on the reference's bins before reads meet it. Filters of reads join by (contig, chunk, cell) with merged intervals,
never by nested loops. A table of intervals may be large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def merged(bed: DataFrame) -> DataFrame:
    """Overlapping or adjacent intervals made one. Repeated ones go first, so that a window has no more rows than there are places."""
    bed = bed.select("contig", "start", "end").distinct()
    order = W.partitionBy("contig").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    fresh = bed.withColumn("fresh", F.when(F.coalesce(F.col("start") > reach, F.lit(True)), 1).otherwise(0))
    island = fresh.withColumn("island", F.sum("fresh").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return island.groupBy("contig", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).select("contig", "start", "end")


def masked_reference(reference: DataFrame, bed: DataFrame, width: int, letter: str = "N") -> DataFrame:
    """A reference in bins of this width with every base that lies in an interval replaced by letter.

    Masking the reference costs what the reference has, not what the reads have: no base of a read meets an interval. A bin's
    intervals, once merged, are at most half its width.
    """
    pieces = merged(bed).where("end > 0").withColumn("bin", F.explode(F.expr(f"sequence(greatest(start, 0L) div {width}, greatest(start, end - 1) div {width})")))
    low, high = F.greatest(F.col("start") - F.col("bin") * width, F.lit(0)), F.least(F.col("end") - F.col("bin") * width, F.lit(width))
    cuts = pieces.select("contig", "bin", F.struct(low.cast("int").alias("low"), high.cast("int").alias("high")).alias("cut")).groupBy("contig", "bin").agg(F.sort_array(F.collect_list("cut")).alias("cuts"))
    seq, cut = F.col("seq"), F.col("cuts")

    def piece(c: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get(cut, i - 1)["high"]).otherwise(0)
        return F.concat(seq.substr(before + 1, c["low"] - before), F.repeat(F.lit(letter), F.least(c["high"], F.length(seq)) - c["low"]))

    tail = seq.substr(F.element_at(cut, -1)["high"] + 1, F.lit(width))
    whole = F.when(cut.isNull(), seq).otherwise(F.concat(F.array_join(F.transform(cut, piece), ""), tail))
    return reference.join(cuts, ["contig", "bin"], "left").withColumn("seq", whole).select(*reference.columns)


def chunk_intervals(bed: DataFrame, region_size: int, contigs: DataFrame) -> DataFrame:
    """Each interval once for every chunk that it overlaps: bed_contig, bed_start, bed_end, bed_chunk."""
    lengths = contigs.select(F.col("contig").alias("bed_contig"), "length")
    met = bed.select(F.col("contig").alias("bed_contig"), F.col("start").alias("bed_start"), F.col("end").alias("bed_end")).distinct().join(lengths, "bed_contig")
    met = met.where((F.col("bed_start") < F.col("length")) & (F.col("bed_end") > 0))
    first, last = F.expr(f"greatest(bed_start, 0L) div {region_size}"), F.expr(f"least(bed_end - 1, greatest(length - 1, 0L)) div {region_size}")
    return met.withColumns({"first": first, "last": last}).where("first <= last").withColumn("bed_chunk", F.explode(F.sequence("first", "last"))).select("bed_contig", "bed_start", "bed_end", "bed_chunk")


#: Width of the cells by which reads look for the interval behind their start.
CELL = 256


def cell_intervals(bed: DataFrame, region_size: int, contigs: DataFrame) -> DataFrame:
    """chunk_intervals() for lookups by bed_cell (of a position): of all cells those intervals that touch the cell, and the next behind it.

    A read starts in its chunk, so what an interval has before the chunk counts as the place before it. Of a start the farthest end
    is enough, and intervals that touch are one; so however many intervals there are, a chunk has no more than places, and a cell
    no more than half its width. Each is listed for its own cells and those of the gap before it: a read that touches any interval
    touches the first one that ends at or behind its start.
    """
    listed = chunk_intervals(bed, region_size, contigs).withColumn("from", F.col("bed_chunk") * region_size)
    there = ["bed_contig", "bed_chunk"]
    cells = lambda low, high: F.explode(F.sequence(F.expr(f"{low} div {CELL}"), F.expr(f"{high} div {CELL}"))).alias("bed_cell")
    straight = listed.where("bed_start <= bed_end").groupBy(*there, "from", F.greatest("bed_start", F.col("from") - 1).alias("bed_start")).agg(F.max("bed_end").alias("bed_end"))
    order = W.partitionBy(*there).orderBy("bed_start")
    fresh = F.coalesce(F.col("bed_start") > F.max("bed_end").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(True))
    island = F.sum(F.when(F.col("fresh"), 1).otherwise(0)).over(order.rowsBetween(W.unboundedPreceding, 0))
    apart = straight.withColumn("fresh", fresh).withColumn("island", island).groupBy(*there, "from", "island").agg(F.min("bed_start").alias("bed_start"), F.max("bed_end").alias("bed_end"))
    gap = F.coalesce(F.lag("bed_end").over(order), F.col("from"))
    # no read of the chunk starts behind its end
    apart = apart.withColumns({"gap": gap, "till": F.least(F.col("bed_end"), F.col("from") + (region_size - 1))})
    placed = apart.where("gap <= till").select(*there, "bed_start", "bed_end", cells("gap", "till"))
    # one that ends before it starts is touched by what reaches over both
    turned = listed.where("bed_start > bed_end").select(*there, "bed_start", "bed_end", cells("`from`", "bed_end"))
    return placed.unionByName(turned)


def without_reads(reads: DataFrame, bed: DataFrame, region_size: int, contigs: DataFrame) -> DataFrame:
    """Reads that touch no interval of their chunk; both ends count, so a read that ends where an interval starts touches it."""
    listed = cell_intervals(bed, region_size, contigs)
    touch = (F.col("contig") == F.col("bed_contig")) & (F.expr(f"pos div {region_size}") == F.col("bed_chunk")) & (F.expr(f"pos div {CELL}") == F.col("bed_cell"))
    return reads.join(listed, touch & (F.col("pos") <= F.col("bed_end")) & (F.col("end") >= F.col("bed_start")), "left_anti")


def masked_count(bed: DataFrame, contigs: DataFrame) -> Column | DataFrame:
    """How many bases of each contig the intervals cover: contig, masked."""
    inside = merged(bed).join(contigs, "contig").select("contig", (F.least("end", "length") - F.least("start", "length")).alias("n"))
    return inside.groupBy("contig").agg(F.sum("n").cast("long").alias("masked"))
