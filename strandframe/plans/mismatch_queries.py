"""Queries of the mismatch family."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.config import MismatchConfig, ReadFilter
from strandframe.operators import intervals, mismatch
from strandframe.plans import fixtures as fx

CONFIG = MismatchConfig(region_size=fx.REGION)
READ_CUT = replace(CONFIG, position_mode="read")


def counts(spark: SparkSession, sf_dir: str, config: MismatchConfig, with_bed: bool = False) -> DataFrame:
    table = fx.bed(spark, sf_dir) if with_bed else None
    return mismatch.mismatch_counts(fx.alignments(spark, sf_dir), fx.reference(spark, sf_dir), config, table, fx.contigs(spark, sf_dir), width=fx.WIDTH)


def counts_sql(config: MismatchConfig, with_bed: bool = False) -> str:
    """CTEs that end in counts."""
    f, mask = config.reads, with_bed and config.bed_mode == "mask"
    keep = [f"mapq >= {f.min_map_quality}", "flag & 4 = 0"]
    keep += [f"flag & {f.required_flags} = {f.required_flags}"] if f.required_flags else []
    keep += [f"flag & {f.filter_flags} = 0"] if f.filter_flags else []
    keep += [f"flag & {f.excl_flags} <> {f.excl_flags}"] if f.excl_flags else []
    if with_bed and not mask:
        size = config.region_size
        keep.append(f"not exists (select 1 from bed b where b.contig = bases.contig and b.b0 < least((pos // {size} + 1) * {size}, {fx.LENGTH}) and b.b1 > pos // {size} * {size} and pos <= b.b1 and stop >= b.b0)")
    inside = "not exists (select 1 from bed b where b.contig = bases.contig and g >= b.b0 and g < b.b1)" if mask else "true"
    cut = "not (read_num = 2 and coalesce(g >= ov0 and g < ov1, false))" if config.overlap_mode == "cut" else "true"
    if config.position_mode == "read":
        place = "case when is_rev and j <= (n + 1) // 2 then mx - j when is_rev then n - j when j <= (n + 1) // 2 then j + 1 else j + mx - n + 1 end"
    else:
        late = "(j >= n // 2 and coalesce(frag <= mx - 10, false))"
        place = f"case when ord = 1 then case when {late} then 2 * mx - (n - j - 1) else j + 1 end else case when {late} then j + 1 else 2 * mx - (n - j - 1) end end"
        if config.overlap_mode == "stretch":
            t = "(case when ord = 1 then j else n - 1 - j end / (n - 1)::double)"
            far = f"round({t} * {t} * (3 - 2 * {t}) * (mx - 1))::bigint"
            place = f"case when n > 1 then case when ord = 1 then 1 + {far} else 2 * mx - {far} end else {place} end"
    comp = lambda x: f"case when is_rev then translate({x}, 'ACGT', 'TGCA') else {x} end"
    alt = "case when (read_num = 1 and sr = 'C' and sb = 'T') or (read_num = 2 and sr = 'G' and sb = 'A') then sr else sb end" if config.methylation else "sb"
    return f"""with {fx.READS}, {fx.BED}, {fx.BASES},
lens as (select coalesce(max(n), 0) as mx from (select n from reads order by rec_idx limit {config.length_sample})),
kept as (select * from bases where {" and ".join(keep)} and kind <> 'ins' and rb <> 'N' and {inside}),
clips as (select rec_idx from kept where kind = 'clip' group by rec_idx having avg((rb = up)::int) >= {config.softclip_identity}),
used as (select * from kept where qual >= {config.min_base_quality} and ((kind = 'align' and {cut}) or (kind = 'clip' and rec_idx in (select rec_idx from clips)))),
placed as (select read_num, ord as reference_order, ({place})::bigint as base_position, {comp("up")} as sr, {comp("rb")} as sb from used, lens),
counts as (select sr || '>' || {alt} as base_change, read_num, reference_order, base_position, count(*) as count from placed group by all)"""


def _counts_query(config: MismatchConfig, with_bed: bool = False) -> tuple:
    return (lambda spark, sf_dir: counts(spark, sf_dir, config, with_bed)), counts_sql(config, with_bed) + " select * from counts"


def _softclip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mismatch.counted_bases(fx.alignments(spark, sf_dir), fx.reference(spark, sf_dir), READ_CUT, width=fx.WIDTH)
    return rows.groupBy("source", "base_change", "base_position").agg(F.count(F.lit(1)).alias("count"))


_SOFTCLIP = counts_sql(READ_CUT).replace("select read_num, ord as", "select kind, read_num, ord as") + " select kind as source, sr || '>' || sb as base_change, base_position, count(*) as count from placed group by all"
_KEYS = "partition by base_change, read_num, base_position"
_DISCOUNTED = f""", {fx.DISCOUNTS},
j as (select c.*, coalesce(d, 0) as d, sum(count) over ({_KEYS}) - count as o from counts c left join disc using (base_change, read_num, base_position)),
discounted as (select base_change, read_num, reference_order, base_position, (case when (reference_order = 1 and count >= o) or (reference_order = 2 and count > o) then greatest(count - d, 0) else count - least(count, greatest(d - o, 0)) end)::bigint as count from j)"""
_NORMALIZED = ", normed as (select base_change, read_num, reference_order, base_position, case when t = 0 then 0.0::double else count::double / t end as normalized_frequency from (select *, (sum(count) over (partition by read_num, base_position, base_change[1]))::double as t from counts))"
_MATRIX = ", mat as (select distinct read_num, (base_position % 65536)::int as position, base_change[1] as ref_base, base_change[3] as read_base, 1.0::float as scaling_factor from normed)"


def _then(after):
    return lambda spark, sf_dir: after(counts(spark, sf_dir, READ_CUT), spark, sf_dir)


def _masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.masked_count(fx.bed(spark, sf_dir), fx.contigs(spark, sf_dir))


def _flag_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandframe.functions import exprs

    rows = fx.alignments(spark, sf_dir)
    of = {"plain": ReadFilter(), "paired": ReadFilter(required_flags=1), "forward": ReadFilter(filter_flags=16), "no_secondary_first": ReadFilter(excl_flags=256 + 64), "primary": ReadFilter(primary_only=True), "strict": ReadFilter(min_map_quality=40, required_flags=3, filter_flags=256)}
    return rows.agg(*(F.count_if(~exprs.skipped(x)).alias(n) for n, x in of.items()))


_FLAG_SQL = f"""with {fx.READS} select count(*) filter (ok) as plain, count(*) filter (ok and flag & 1 <> 0) as paired, count(*) filter (ok and flag & 16 = 0) as forward, count(*) filter (ok and flag & 320 <> 320) as no_secondary_first,
count(*) filter (ok and flag & 256 = 0 and flag & 2048 = 0) as "primary", count(*) filter (ok and mapq >= 40 and flag & 3 = 3 and flag & 256 = 0) as strict from (select *, mapq >= 10 and flag & 4 = 0 as ok from reads)"""

QUERIES = {
    "mismatch_read_cut": _counts_query(READ_CUT),
    "mismatch_read_stretch": _counts_query(replace(READ_CUT, overlap_mode="stretch")),
    "mismatch_insert_cut": _counts_query(CONFIG),
    "mismatch_insert_stretch": _counts_query(replace(CONFIG, overlap_mode="stretch")),
    "mismatch_methylation": _counts_query(replace(READ_CUT, methylation=True)),
    "mismatch_flags": _counts_query(replace(READ_CUT, reads=ReadFilter(30, 1, 256, 64 + 32))),
    "mismatch_softclip": (_softclip, _SOFTCLIP),
    "mismatch_bed_mask": _counts_query(READ_CUT, True),
    "mismatch_bed_filter": _counts_query(replace(READ_CUT, bed_mode="filter"), True),
    "bed_merge": (
        lambda spark, sf_dir: intervals.merged(fx.bed(spark, sf_dir)),
        f"with {fx.BED}, m as (select *, max(b1) over (partition by contig order by b0, b1 rows between unbounded preceding and 1 preceding) as reach from bed), i as (select *, sum(case when reach is null or b0 > reach then 1 else 0 end) over (partition by contig order by b0, b1 rows unbounded preceding) as island from m) select contig, min(b0) as start, max(b1) as \"end\" from i group by contig, island",
    ),
    "bed_masked_bases": (_masked, f"with {fx.BED}, p as (select distinct contig, unnest(range(b0, b1)) as g from bed) select contig, count(*) as masked from p where g < {fx.LENGTH} group by contig"),
    "flag_filters": (_flag_filters, _FLAG_SQL),
    "discount_apply": (_then(lambda c, spark, sf_dir: mismatch.apply_discounts(c, fx.discounts(spark, sf_dir))), counts_sql(READ_CUT) + _DISCOUNTED + " select * from discounted"),
    "discount_touched": (_then(lambda c, spark, sf_dir: mismatch.touched_keys(c, fx.discounts(spark, sf_dir))), counts_sql(READ_CUT) + _DISCOUNTED + " select count(*) as touched from (select distinct base_change, read_num, base_position from counts join disc using (base_change, read_num, base_position) where count > 0)"),
    "normalize": (_then(lambda c, *_: mismatch.normalized(c)), counts_sql(READ_CUT) + _NORMALIZED + " select * from normed"),
    "rescaling_matrix": (_then(lambda c, *_: mismatch.rescaling_matrix(mismatch.normalized(c))), counts_sql(READ_CUT) + _NORMALIZED + _MATRIX + " select * from mat"),
}
