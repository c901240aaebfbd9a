"""Mixing sources to target weights: Efraimidis-Spirakis sampling without replacement, after whole epochs.

Sources in order of their code points, null last, weigh WEIGHTS in turn and share SHARE times all words; no source gets
more than CAP times its own words, and what is over goes to the others by weight (a water level, found by one sort of the
sources). A source's target is whole epochs of all its documents and a remainder. For the remainder each document draws
an exponential key -ln(u) / quality weight; documents are taken in order of their keys while their words fit.

The order within a source is cut into bins of the key's logarithm: sums of bins are added up in order, the one bin in which
the budget ends is cut into finer bins in the same way, and only the one of those in which it ends is put in order row by row:
a row in a million or so. So a source with a third of all rows is no larger task than others.

Defined cases: a null text is empty, has size 0 and nothing is taken of it; documents with equal keys (repeated rows) are
ordered by id and size, and equal ones are all taken or all left; a null id draws as the text "null"; a null source is a source;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandframe.llm.common import WORD, quoted, read, staged, text_of

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
SEED = 17
#: Bins to a doubling of the key, and finer bins to a bin.
FINENESS, FINER = 1024, 1024


def quality_weight(text: Column) -> Column:
    """Percent, 5 to 100: 100 less three times the share of the characters # * $ % & | < > among all."""
    symbols = F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long")
    return F.greatest(F.lit(5), 100 - F.floor(300 * symbols / F.greatest(F.length(text), F.lit(1))))


def drawn(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """keep's columns with size, and place: the key, then the id and the size."""
    text = text_of()
    number = F.conv(F.substring(F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary")), 1, 12), 16, 10).cast("long")
    key = -F.log((number + 0.5) / F.lit(float(1 << 48))) * 100.0 / quality_weight(text)
    size = F.regexp_count(text, F.lit(WORD)).cast("long")
    return docs.select(*keep, size.alias("size"), F.struct(key.alias("key"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1).cast("long")).alias("id"), size.alias("n")).alias("place"))


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size and target for rows of source and size."""
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in WEIGHTS)), F.pmod(rank - 1, F.lit(len(WEIGHTS))) + 1)
    each = each.withColumn("weight", weight).withColumn("level", CAP * F.col("source_size") / F.col("weight"))
    order = W.orderBy("level", F.col("source").asc_nulls_last())
    full = F.coalesce(F.sum(CAP * F.col("source_size")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    water = each.withColumn("water", (SHARE * F.sum("source_size").over(W.partitionBy()) - full) / left)
    level = F.min(F.when(F.col("water") <= F.col("level"), F.struct("level", "water"))).over(W.partitionBy())["water"]
    return water.select("source", "source_size", F.when(F.col("level") <= level, F.lit(float(CAP)) * F.col("source_size")).otherwise(level * F.col("weight")).alias("target"))


def _edge(rows: DataFrame, cuts: DataFrame, fineness: int) -> DataFrame:
    """Of rows (source, size, place), those in the bin in which their source's rest of words ends: with rest and start, the words before that bin.
    cuts: a row a source, with rest and start, the words before all its rows."""
    rows = rows.withColumn("bin", F.floor(F.log2("place.key") * fineness)).drop("rest")
    bins = rows.groupBy("source", "bin").agg(F.sum("size").alias("words"))
    bins = bins.withColumn("upto", F.sum("words").over(W.partitionBy("source").orderBy("bin"))).alias("b")
    met = bins.join(cuts.alias("e"), F.expr("b.source <=> e.source and start + upto - words < rest and start + upto >= rest"))
    cut = staged(met.select("b.source", "bin", (F.col("start") + F.col("upto") - F.col("words")).alias("start"), "rest"), "edge").alias("c")
    return rows.alias("r").join(cut, F.expr("r.source <=> c.source and r.bin = c.bin")).select("r.source", "size", "place", "start", "rest")


def budgets(rows: DataFrame) -> DataFrame:
    """A row for each source: source_size, target, epochs, and last, the place of the last document in the remainder (null: none)."""
    each = targets(rows).withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    each = staged(each.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "targets")
    edge = _edge(rows, each.withColumn("start", F.lit(0).cast("long")), FINENESS)
    edge = _edge(edge.drop("start"), edge.groupBy("source").agg(F.first("start").alias("start"), F.first("rest").alias("rest")), FINENESS * FINER)
    upto = F.col("start") + F.sum("size").over(W.partitionBy("source").orderBy("place"))
    edge = edge.withColumn("upto", upto).groupBy("source").agg(F.max(F.when(2 * F.col("upto") - F.col("size") <= 2 * F.col("rest"), F.col("place"))).alias("place"), F.min("place.key").alias("from")).alias("x")
    cuts = each.alias("e").join(edge, F.expr("e.source <=> x.source"), "left")
    # nothing of the bin in which the budget ends may fit: then all that comes before the bin is taken
    return cuts.select("e.source", "source_size", "target", "epochs", "x.place", "x.from")


def copies() -> Column:
    """How often the mix takes a document of drawn() joined to its source's budgets()."""
    fits = F.coalesce(F.col("p.place") <= F.col("b.place"), F.lit(False)) | F.coalesce(F.col("p.place.key") < F.col("b.from"), F.lit(False))
    return F.when(F.col("size") > 0, F.col("epochs") + fits.cast("long")).otherwise(0)


def mix(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken."""
    rows = staged(drawn(docs, ("doc_id", "source")), "drawn")
    at = staged(budgets(rows), "budgets").alias("b")
    return rows.alias("p").join(at, F.expr("p.source <=> b.source"), "left").select("doc_id", "size", "source_size", "target", (F.col("size") * copies()).alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it is taken, with all its columns. Texts aren't moved."""
    at = staged(budgets(staged(drawn(docs, ("source",)), "drawn")), "budgets").alias("b")
    columns = docs.columns
    rows = drawn(docs.select("doc_id", "source", "text", F.struct(*quoted(columns)).alias("whole")), ("whole", "source")).alias("p")
    taken = rows.join(at, F.expr("p.source <=> b.source"), "left").select("whole", F.explode(F.array_repeat(F.lit(1), copies().cast("int"))).alias("one"))
    return taken.select(*(F.col("whole").getField(c).alias(c) for c in columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"))


ORACLE_SQL = rf"""
with d as (select doc_id, source, coalesce(text, '') as t from documents),
k as (select doc_id, source, len([x for x in regexp_split_to_array(t, '[\x20\x09-\x0D]+') if x <> ''])::bigint as size,
  -ln((('0x' || substr(md5('{SEED}:' || doc_id), 1, 12))::bigint + 0.5) / {1 << 48}::double) * 100.0
    / greatest(5, 100 - floor(300 * length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) / greatest(length(t), 1))) as key from d),
s as (select source, sum(size)::bigint as source_size, [{", ".join(map(str, WEIGHTS))}][1 + (row_number() over (order by source nulls last) - 1) % {len(WEIGHTS)}] as weight from k group by source),
l as (select *, {CAP} * source_size / weight as level,
  ({SHARE} * sum(source_size) over () - coalesce(sum({CAP} * source_size) over (order by {CAP} * source_size / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (order by {CAP} * source_size / weight, source nulls last rows between current row and unbounded following) as water from s),
g as (select source, source_size, case when level <= w then {CAP}.0 * source_size else w * weight end::double as target
  from (select *, arg_min(water, level) filter (water <= level) over () as w from l)),
e as (select *, case when source_size > 0 then floor(target / source_size) else 0 end as epochs from g),
p as (select k.*, source_size, target, epochs, target - epochs * source_size as rest, sum(size) over (partition by k.source order by key, doc_id, size) as upto
  from k join e on k.source is not distinct from e.source)
select doc_id, size, source_size, target, (size * (epochs + (case when rest > 0 and 2 * upto - size <= 2 * rest then 1 else 0 end)))::bigint as taken from p"""
