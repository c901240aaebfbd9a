"""Filters of reads by intervals against brute force, with many intervals on few places."""

import random

from pyspark.sql import functions as F

from strandframe.operators import intervals

LENGTHS = {"a": 1000, "b": 790}


def touches(read, bed, size):
    contig, pos, end = read
    low, high = pos // size * size, min((pos // size + 1) * size, LENGTHS[contig])
    return any(c == contig and s < high and e > low and pos <= e and end >= s for c, s, e in bed)


def test_filter_matches_brute_force(spark):
    r = random.Random(7)
    contigs = spark.createDataFrame([(i, c, n) for i, (c, n) in enumerate(LENGTHS.items())], "tid int, contig string, length long")
    reads = [(r.choice("ab"), p, p + r.choice([0, 1, 5, 30, 300])) for p in (r.randrange(780) for _ in range(3000))]
    table = spark.createDataFrame([(i, *x) for i, x in enumerate(reads)], "rec_idx long, contig string, pos long, end long")
    few = [(r.choice("ab"), s, s + r.choice([-40, -1, 0, 1, 3, 12])) for s in (r.randrange(-20, 1010) for _ in range(12))]
    for bed in (few, [*few, ("a", 249, 251), ("b", -5, 2000)], [("a", 600, 610)], []):
        for size in (250, 300, 10_000_000):
            kept = intervals.without_reads(table, spark.createDataFrame(bed, "contig string, start long, end long"), size, contigs)
            assert {x["rec_idx"] for x in kept.collect()} == {i for i, x in enumerate(reads) if not touches(x, bed, size)}


def test_reads_meet_few_rows_however_many_intervals(spark):
    """The rows a read is compared with don't grow with the table of intervals."""
    contigs = spark.createDataFrame([(0, "a", 1000)], "tid int, contig string, length long")
    bed = spark.range(20_000).select(F.lit("a").alias("contig"), (F.col("id") % 19 * 50).alias("start"), (F.col("id") % 19 * 50 + 1 + F.col("id") % 20).alias("end"))
    listed = intervals.cell_intervals(bed, 250, contigs)
    assert listed.groupBy("bed_chunk", "bed_cell").count().agg(F.max("count")).first()[0] <= 7
    assert listed.count() < 40


def test_merged_sees_repeated_intervals_once(spark):
    bed = spark.createDataFrame([("a", 5, 9), ("a", 5, 9), ("a", 9, 12), ("a", 20, 21)] * 50, "contig string, start long, end long")
    assert sorted(tuple(x) for x in intervals.merged(bed).collect()) == [("a", 5, 12), ("a", 20, 21)]
    plan = intervals.merged(bed)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("Aggregate [contig") > plan.rindex("Window")
