"""Queries of the diagnostics family and quality rescaling."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.config import DiagnosticsConfig
from strandframe.operators import diagnostics, legacy, rescale
from strandframe.operators.plotprep import MISMATCHES
from strandframe.plans import fixtures as fx

_DISCORDANT = [f"R1:{a}_R2:{b}" for a in "ACGTN" for b in "ACGTN" if a != b]
CONFIG = DiagnosticsConfig(min_count=3, min_depth=8, region_size=fx.REGION)


def found(part: str, config: DiagnosticsConfig, with_bed: bool = False):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        bed = fx.bed(spark, sf_dir) if with_bed else None
        out = diagnostics.diagnose(fx.alignments(spark, sf_dir), fx.reference(spark, sf_dir), config, bed, fx.contigs(spark, sf_dir), fx.WIDTH)[part]
        return out.withColumnRenamed("g_pos", "position") if part == "depth" else out

    return query


def _sql(config: DiagnosticsConfig, with_bed: bool = False) -> str:
    """CTEs that end in depths, keys, sites and pairs."""
    size, mode = config.region_size, config.bed_mode if with_bed else ""
    touched = f"exists (select 1 from bed b where b.contig = q.contig and b.b0 < least((pos // {size} + 1) * {size}, {fx.LENGTH}) and b.b1 > pos // {size} * {size} and pos <= b.b1 and stop >= b.b0)"
    inside = "exists (select 1 from bed b where b.contig = w.contig and g >= b.b0 and g < b.b1)"
    q = "case when is_rev then n - j - 1 else j end"
    place = q
    if config.insert_mode:
        place = f"case when read_num = 1 then {q} else 2 * {config.mode_length} + 10 - (n - {q}) end"
    elif config.mode_length:
        place = f"case when {q} > n // 2 then {q} + {config.mode_length} - n else {q} end"
    comp = lambda x: f"case when is_rev then translate({x}, 'ACGT', 'TGCA') else {x} end"
    alt = "case when (read_num = 1 and sr = 'C' and sb = 'T') or (read_num = 2 and sr = 'G' and sb = 'A') then sr else sb end" if config.methylation else "sb"
    return f"""with {fx.READS}, {fx.BED}, {fx.BASES},
q1 as (select *, pos // {size} as chunk, flag & 1 <> 0 and flag & 12 = 0 as pairable from reads q{f" where not {touched}" if mode == "filter" else ""}),
q2 as (select rec_idx, chunk, pairable and count(*) over g = 2 and max(pos) over g < min(stop) over g as paired2, row_number() over (partition by chunk, contig, k, pairable order by rec_idx) as rn,
  min(rec_idx) over g as pair, max(pos) over g as o0, min(stop) over g as o1 from q1 window g as (partition by chunk, contig, k, pairable)),
w as (select bases.*, chunk, case when paired2 then rn end as record, case when paired2 then pair end as pair, coalesce(paired2 and g >= o0 and g < o1, false) as inside
  from bases join q2 using (rec_idx) where kind = 'align' and mapq >= 10 and flag & 4 = 0 and flag & 256 = 0),
used as (select *, {inside if mode == "mask" else "false"} as masked from w {f"where not {inside}" if mode == "filter" else ""}),
depths as (select chunk, contig, g as position, sum(case when inside then case when record = 1 then 2 else 0 end else 1 end)::bigint as depth from used group by all having sum(case when inside then case when record = 1 then 2 else 0 end else 1 end) > 0),
diff as (select *, {comp("up")} as sr, {comp("rb")} as sb, ({place})::bigint as read_position from used where rb <> 'N' and not soft and not masked and rb <> up and qual >= {config.min_base_quality} and not inside and coalesce(record, 1) = 1),
keys as (select distinct chunk, contig, g, sr || '>' || {alt} as mismatch_type, read_num, read_position from diff),
sites as (select s.chunk, s.contig, s.g, mismatch_type, s.count, coalesce(depth, 0) as depth from (select chunk, contig, g, mismatch_type, count(*) as count from keys group by all) s
  left join depths d on s.chunk = d.chunk and s.contig = d.contig and s.g = d.position where s.count >= {config.min_count} and coalesce(depth, 0) >= {config.min_depth})"""


_ENDS = {
    "depth": " select * from depths",
    "keys": " select chunk, contig, g as g_pos, mismatch_type, read_num, read_position from keys",
    "variants": " select contig as chromosome, g as position, mismatch_type[1] as reference_base, mismatch_type[3] as mismatch_base, arg_max(count, chunk) as count, arg_max(depth, chunk) as depth from sites group by contig, g, mismatch_type",
    "discounts": " select mismatch_type, read_num, read_position, count(*) as discount_count from keys semi join sites using (chunk, contig, g, mismatch_type) group by all",
    "inconsistencies": " select x.j as read1_position, y.j as read2_position, 'R1:' || x.rb || '_R2:' || y.rb as discordance_type, count(*) as count from w x join w y on x.pair = y.pair and x.g = y.g and x.record = 1 and y.record = 2 and x.inside and y.inside where x.qual >= 20 and y.qual >= 20 and x.rb <> y.rb group by all",
}


def _query(part: str, config: DiagnosticsConfig = CONFIG, with_bed: bool = False) -> tuple:
    return found(part, config, with_bed), _sql(config, with_bed) + _ENDS[part]


_MATRIX = "mat as (select distinct 1 + n_nationkey % 2 as read_num, position, 'ACGT'[(n_nationkey % 4 + 1)::int] as ref_base, 'ACGT'[((n_nationkey + 1 + (n_nationkey // 4) % 3) % 4 + 1)::int] as read_base, (0.25 * (1 + n_nationkey % 6))::float as f from nation, (select unnest(range(24)) as position))"


def _new_qualities(shift: str) -> str:
    turn = lambda x: f"case when a.is_rev then translate({x}, 'ACGT', 'TGCA') else {x} end"
    return f"""with {fx.READS}, {fx.BASES}, {_MATRIX},
old as (select a.rec_idx, b.j as r_pos, b.qual, a.read_num, {turn("a.up")} as ref_base, {turn("b.rb")} as read_base from bases a join bases b on a.rec_idx = b.rec_idx and b.j = a.j - {shift} where a.kind = 'align' and not a.soft and b.rb <> 'N' and b.rb <> a.up),
new as (select rec_idx, r_pos, least(round(qual * f), 40)::int as new_qual from old join mat using (read_num, ref_base, read_base) where position = r_pos)"""


def _changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rescale.changed_bases(fx.alignments(spark, sf_dir), fx.reference(spark, sf_dir), _matrix(spark, sf_dir), width=fx.WIDTH)


def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.matrix(spark, sf_dir)


def _rescaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rescale.rescale(fx.alignments(spark, sf_dir), fx.reference(spark, sf_dir), _matrix(spark, sf_dir), width=fx.WIDTH)
    return out.select("rec_idx", F.concat_ws(",", F.transform("qual", lambda q: q.cast("string"))).alias("qualities"))


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.routed(fx.alignments(spark, sf_dir), CONFIG)


def _counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.read_counters(diagnostics.grouped(fx.alignments(spark, sf_dir), CONFIG))


def _overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return legacy.overlap_mismatches(_routed(spark, sf_dir), fx.reference(spark, sf_dir), CONFIG, fx.WIDTH)


def _clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return legacy.clip_mismatches(_routed(spark, sf_dir), fx.reference(spark, sf_dir), replace(CONFIG, softclip_threshold=0.5), width=fx.WIDTH)


_OVERLAP_SQL = _sql(CONFIG) + ", o as (select *, case when is_rev then translate(up, 'ACGT', 'TGCA') else up end as sr, case when is_rev then translate(rb, 'ACGT', 'TGCA') else rb end as sb, case when is_rev then n - j - 1 else j end as p from used where inside and rb <> 'N' and not soft and rb <> up and qual >= 20) select sr || '>' || sb as mismatch_type, read_num, p as read_position, count(*) as count from o group by all"
_CLIP_SQL = _sql(CONFIG) + ", c as (select *, case when is_rev then n - j - 1 else j end as p, avg((rb = up)::int) over (partition by rec_idx) as same from bases where kind = 'clip' and qual >= 20 and mapq >= 10 and flag & 260 = 0) select case when is_rev then translate(up || '>' || rb, 'ACGT', 'TGCA') else up || '>' || rb end as mismatch_type, read_num, p as read_position, count(*) as count from c where same >= 0.5 and rb <> up group by all"


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _overlaps(spark, sf_dir)
    return legacy.insert_merged(counts, 24)


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return legacy.wide_positions(_overlaps(spark, sf_dir), list(MISMATCHES))


_MERGED_SQL = f"select case when mismatch_type[1] in ('G', 'T') then translate(mismatch_type, 'ACGT', 'TGCA') else mismatch_type end as mismatch_type, case when read_num = 1 then read_position else 58 - read_position end as insert_position, sum(count)::bigint as count from ({_OVERLAP_SQL}) group by all"
_WIDE_SQL = "select read_num as \"Read\", read_position as \"Position\", " + ", ".join(f"coalesce(sum(count) filter (mismatch_type = '{t}'), 0)::bigint as \"{t}\"" for t in MISMATCHES) + f" from ({_OVERLAP_SQL}) group by 1, 2"
_WIDE_INC_SQL = "select read1_position as \"Read1_Pos\", read2_position as \"Read2_Pos\", " + ", ".join(f"coalesce(sum(count) filter (discordance_type = '{t}'), 0)::bigint as \"{t}\"" for t in _DISCORDANT) + f" from ({_sql(CONFIG) + _ENDS['inconsistencies']}) group by 1, 2"

QUERIES = {
    "depth": _query("depth"),
    "depth_bed_filter": _query("depth", replace(CONFIG, bed_mode="filter"), True),
    "mismatch_keys": _query("keys"),
    "mismatch_keys_mode_length": _query("keys", replace(CONFIG, mode_length=24)),
    "mismatch_keys_insert": _query("keys", replace(CONFIG, mode_length=24, insert_mode=True)),
    "variants": _query("variants"),
    "variants_methylation": _query("variants", replace(CONFIG, methylation=True)),
    "variants_bed_mask": _query("variants", CONFIG, True),
    "variants_bed_filter": _query("variants", replace(CONFIG, bed_mode="filter"), True),
    "discounts": _query("discounts"),
    "inconsistencies": _query("inconsistencies"),
    "overlap_mismatches": (_overlaps, _OVERLAP_SQL),
    "clip_mismatches": (_clips, _CLIP_SQL),
    "insert_merge_canonical": (_merged, _MERGED_SQL),
    "wide_position_table": (_wide, _WIDE_SQL),
    "wide_inconsistency_table": (lambda spark, sf_dir: legacy.wide_inconsistencies(found("inconsistencies", CONFIG)(spark, sf_dir), list(_DISCORDANT)), _WIDE_INC_SQL),
    "read_counters": (_counters, _sql(CONFIG) + " select count(*) as total_records, count(*) filter (paired2 and rn = 1) as overlap_pairs from q2"),
    "rescaled_bases": (_changed, _new_qualities("a.clip") + " select rec_idx, r_pos, new_qual from new"),
    "rescale_quality": (_rescaled, _new_qualities("a.clip") + " select b.rec_idx, string_agg(coalesce(new_qual, qual)::varchar, ',' order by j) as qualities from bases b left join new on b.rec_idx = new.rec_idx and b.j = new.r_pos group by 1"),
}
