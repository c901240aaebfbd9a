"""Connected components of a graph kept in tables, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.llm.common import discard, staged


def connected(edges: DataFrame) -> DataFrame:
    """node and root (the least node that it is connected to) of each node of edges (a, b) that isn't a root itself.

    Each round is two aggregations and two joins by node, written to the shared folder; the number of rounds grows with
    the logarithm of the number of nodes. Minima are combined before the shuffle and written as tables of their own, so that
    both sides of a join are plain exchanges (never broadcast: packed ids are many more rows than their files' size tells) and Spark
    can split a hot node's edges.
    """
    now = staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    mark = None
    while True:
        both = now.union(now.select("v", "u"))
        least = staged(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m")), "least")
        large = staged(both.join(least.hint("merge"), F.col("u") == F.col("k")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        discard(least)
        least = staged(large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m"), "least")
        met = large.join(least.hint("merge"), F.col("u") == F.col("k"))
        small = staged(met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct(), "small")
        discard(now, large, least)
        now, last = small, mark
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_003)).first())
        if mark == last:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
