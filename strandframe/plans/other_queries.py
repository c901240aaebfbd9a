"""Queries over reads' attributes, plot tables, and text forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.functions import cigar, exprs
from strandframe.operators import bases, plotprep
from strandframe.plans import fixtures as fx
from strandframe.staging import written
from strandframe.plans.mismatch_queries import CONFIG, READ_CUT, counts, counts_sql


def _mates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bases.with_mates(bases.prepared(fx.alignments(spark, sf_dir)))


def _longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bases.longest(fx.alignments(spark, sf_dir), CONFIG.length_sample).withColumnRenamed("n", "max_read_len")


def _table(config):
    # a table of a few hundred rows that a plot's queries use more than once
    return lambda spark, sf_dir: written(counts(spark, sf_dir, config).withColumnRenamed("base_position", "position"), "counts")


def _rows(config, insert_mode: bool = False):
    return lambda spark, sf_dir: plotprep.prepared(_table(config)(spark, sf_dir), insert_mode=insert_mode)


def _rows_sql(config, insert_mode: bool = False) -> str:
    base = "select base_change, reference_order, base_position as position, sum(count) as y, 1 as read_num from counts group by all" if insert_mode else "select base_change, reference_order, base_position as position, count as y, read_num from counts"
    return counts_sql(config) + f", p as ({base}), rows as (select base_change, read_num, reference_order, position, y::bigint as y, base_change[1] as source_base, case when t <> 0 then y::double / t else 0.0 end as normalized_count from (select *, (sum(y) over (partition by read_num, reference_order, position, base_change[1]))::double as t from p))"


_CLASSES = ", ".join(f"('{m}')" for m in plotprep.MISMATCHES)
_SERIES = f", mm as (select * from rows where base_change[1] <> base_change[3]), classes as (select * from (values {_CLASSES}) v(base_change))"
_ZERO = _SERIES + ", series as (select s.read_num, base_change, s.reference_order, s.position, coalesce(y, 0)::double as y_count, coalesce(normalized_count, 0.0) as y_norm from (select distinct read_num, reference_order, position from mm) s cross join classes left join mm using (read_num, reference_order, position, base_change))"
_COMBINED = _SERIES + """, top as (select read_num, position, base_change, sum(y) as y from mm group by all), und as (select read_num, position, source_base, sum(y) as u from rows group by all),
comb as (select s.read_num, base_change, s.position, coalesce(y, 0)::double as y_count, case when y is not null and coalesce(u, 0) <> 0 then y::double / u::double else 0.0 end as y_norm
  from (select distinct read_num, position from mm) s cross join classes left join top using (read_num, position, base_change) left join und on und.read_num = s.read_num and und.position = s.position and und.source_base = base_change[1])"""
_SELECTED = ("C>T", "G>A", "A>G")


def _sums(over_reads: bool):
    return lambda spark, sf_dir: plotprep.selected_sums(plotprep.combined(_rows(READ_CUT)(spark, sf_dir)), _SELECTED, over_reads).withColumn("y_norm", F.round("y_norm", 9))


def _sums_sql(keys: str) -> str:
    return _rows_sql(READ_CUT) + _COMBINED + f" select {keys}, sum(y_count) as y_count, round(sum(y_norm), 9) as y_norm from comb where base_change in {_SELECTED} group by {keys}"


def _md(spark: SparkSession, sf_dir: str) -> DataFrame:
    miss, match = cigar.md_tag(F.col("md"))
    # a tag for each record, with a mismatch, a deletion and a lower-case mismatch at distances that follow from its number
    rows = fx.alignments(spark, sf_dir).selectExpr("rec_idx", "concat(rec_idx % 30, 'A', rec_idx % 7, '^AC', rec_idx % 5, 't', rec_idx % 11) as md").select("rec_idx", miss.alias("miss"), match.alias("match"))
    joined = lambda c, a, b: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x[a].cast("string"), x[b].cast("string"))), ",")
    return rows.select("rec_idx", joined("miss", "pos", "base").alias("mismatches"), joined("match", "start", "len").alias("matches"))


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    # every tenth text is made malformed
    rows = fx.alignments(spark, sf_dir).selectExpr("rec_idx", "if(rec_idx % 10 = 0, concat(cigar, '?'), cigar) as cigar")
    return rows.select("rec_idx", cigar.text_span(F.col("cigar")).alias("span"))


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.alignments(spark, sf_dir).select("rec_idx", F.explode(cigar.segments(cigar.operations(F.col("cigar")), F.col("pos"))).alias("s"))
    return rows.where(F.col("s.op").isin(*cigar.ALIGNED)).select("rec_idx", F.col("s.read").alias("read_start"), F.col("s.genome").alias("genome_start"), F.col("s.len").cast("long").alias("length"))


def _fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.alignments(spark, sf_dir).select("rec_idx", exprs.fixed6((F.col("rec_idx") % 100003) / 128.0).alias("text"))


_READ_SQL = f"with {fx.READS}, {fx.BASES}"
QUERIES = {
    "max_read_len": (_longest, f"with {fx.READS} select max(n) as max_read_len from (select n from reads order by rec_idx limit {CONFIG.length_sample})"),
    "regions": (
        lambda spark, sf_dir: bases.regions(fx.contigs(spark, sf_dir), 300),
        f"select r_regionkey as tid, r_name as contig, s as start, least(s + 300, {fx.LENGTH}) as \"end\" from region, (select unnest(range(0, {fx.LENGTH}, 300)) as s)",
    ),
    "read_ends": (lambda spark, sf_dir: _mates(spark, sf_dir).select("rec_idx", F.col("end").alias("read_end"), "mate_end"), _READ_SQL + " select rec_idx, stop as read_end, mate_stop as mate_end from r2"),
    "fragment_length": (lambda spark, sf_dir: _mates(spark, sf_dir).select("rec_idx", F.col("frag_len").alias("fragment_length")), _READ_SQL + " select rec_idx, frag as fragment_length from r2"),
    "reference_order": (lambda spark, sf_dir: _mates(spark, sf_dir).select("rec_idx", "read_num", "reference_order"), _READ_SQL + " select rec_idx, read_num, ord as reference_order from r2"),
    "overlap_interval": (lambda spark, sf_dir: _mates(spark, sf_dir).select("rec_idx", "overlap_start", "overlap_end"), _READ_SQL + " select rec_idx, ov0 as overlap_start, ov1 as overlap_end from r2"),
    "cigar_segments": (
        _segments,
        f"""with {fx.READS} select rec_idx, clip as read_start, pos as genome_start, case when del = 1 then 6 when ins = 1 then 8 else n - clip - ins end as length from reads
union all select rec_idx, clip + 6, pos + 8, n - clip - 6 from reads where del = 1 union all select rec_idx, clip + 9, pos + 8, n - clip - 9 from reads where ins = 1""",
    ),
    "plot_normalized": (_rows(READ_CUT), _rows_sql(READ_CUT) + " select * from rows"),
    "plot_insert": (_rows(CONFIG, True), _rows_sql(CONFIG, True) + " select * from rows"),
    "plot_available": (lambda spark, sf_dir: plotprep.available(_rows(READ_CUT)(spark, sf_dir)), _rows_sql(READ_CUT) + " select distinct read_num, reference_order from rows where base_change[1] <> base_change[3]"),
    "plot_zero_filled": (lambda spark, sf_dir: plotprep.zero_filled(_rows(READ_CUT)(spark, sf_dir)), _rows_sql(READ_CUT) + _ZERO + " select * from series"),
    "plot_combined": (lambda spark, sf_dir: plotprep.combined(_rows(READ_CUT)(spark, sf_dir)), _rows_sql(READ_CUT) + _COMBINED + " select * from comb"),
    "plot_sum": (_sums(False), _sums_sql("read_num, position")),
    "plot_sum_reads": (_sums(True), _sums_sql("position")),
    "md_tag": (_md, f"""with {fx.READS}, n as (select rec_idx, rec_idx % 30 as a, rec_idx % 7 as b, rec_idx % 5 as c, rec_idx % 11 as d from reads)
select rec_idx, a || ':A,' || (a + 1 + b + c) || ':T' as mismatches, concat_ws(',', case when a > 0 then '0:' || a end, case when b > 0 then (a + 1) || ':' || b end,
  case when c > 0 then (a + 1 + b) || ':' || c end, case when d > 0 then (a + b + c + 2) || ':' || d end) as matches from n"""),
    "cigar_span": (_spans, f"with {fx.READS} select rec_idx, case when rec_idx % 10 <> 0 then stop - pos end as span from reads"),
    "fixed_format": (_fixed, f"with {fx.READS} select rec_idx, printf('%.6f', ((rec_idx % 100003) / 128.0)::double) as text from reads"),
}
