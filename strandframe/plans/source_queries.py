"""Sources and sinks: files written from the fixtures' tables and read again, held against SQL on the driver's tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.operators import mismatch
from strandframe.plans import diagnostics_queries as dq
from strandframe.plans import fixtures as fx
from strandframe.plans.mismatch_queries import CONFIG, READ_CUT, counts, counts_sql
from strandframe.sources import bam, fasta, sam, sinks, tables
from strandframe.sources.lines import numbered
from strandframe.staging import shared_path


def _file(spark: SparkSession, name: str) -> str:
    """The place of a new file in the shared folder, as a URI."""
    path = shared_path(spark, name)
    return path if "://" in path or path.startswith("file:") else f"file://{path}"


def _put(spark: SparkSession, name: str, lines: Iterable[str]) -> str:
    path = _file(spark, name)
    sinks.write_lines(lines, path)
    return path


def _contigs(spark: SparkSession, sf_dir: str) -> list[tuple[str, int]]:
    return [(r["contig"], r["length"]) for r in fx.contigs(spark, sf_dir).orderBy("tid").collect()]  # five rows


def _head(contigs: list[tuple[str, int]]) -> list[str]:
    return ["@HD\tVN:1.6\tSO:coordinate", *(f"@SQ\tSN:{n}\tLN:{x}" for n, x in contigs)]


def _fields(records: DataFrame) -> DataFrame:
    joined = F.concat_ws(",", F.transform("qual", lambda q: q.cast("string")))
    return records.select("qname", "flag", "contig", "pos", "mapq", "cigar", "mcontig", "mpos", "tlen", "seq", joined.alias("qualities"), "mc", "tags")


def _sam(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _file(spark, "reads.sam")
    sinks.write_sam(fx.alignments(spark, sf_dir), _head(_contigs(spark, sf_dir)), path)
    return _fields(sam.read_alignments(spark, path)).drop("mc")


def _bam_path(spark: SparkSession, sf_dir: str) -> str:
    path, contigs = _file(spark, "reads.bam"), _contigs(spark, sf_dir)
    bam.write_alignments(fx.alignments(spark, sf_dir), "".join(f"{x}\n" for x in _head(contigs)), contigs, path)
    return path


def _bam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fields(bam.read_alignments(spark, _bam_path(spark, sf_dir))).drop("mc")


REGION = (200, 420)


def _bam_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _bam_path(spark, sf_dir)
    bam.write_index(path, spark)
    name = _contigs(spark, sf_dir)[1][0]
    return _fields(bam.read_alignments(spark, path, f"{name}:{REGION[0]}-{REGION[1]}")).drop("mc")


def _records_sql(integers: str, where: str = "true") -> str:
    cigar = "case when clip > 0 then '3S' else '' end || case when del = 1 then '6M2D' || (n - clip - ins - 6) || 'M' when ins = 1 then '8M1I' || (n - clip - ins - 8) || 'M' else (n - clip - ins) || 'M' end"
    floats = "['0.0', '0.125', '0.25', '0.375', '0.5', '0.625', '0.75', '0.875']"
    return f"""with {fx.READS}, {fx.BASES},
letters as (select rec_idx, string_agg(rb, '' order by j) as seq, string_agg(qual::varchar, ',' order by j) as qualities from bases group by 1)
select 'f' || k as qname, flag::int as flag, contig, pos, mapq::int as mapq, {cigar} as cigar, case when mtid >= 0 then contig else '*' end as mcontig, mpos,
  (case when paired = 1 then case when side = 0 then 1 else -1 end * (greatest(stop, pos + 1) - pos + k % 40) else 0 end)::int as tlen, seq, qualities,
  'NM:{integers}:' || (k % 200) || chr(9) || 'XF:f:' || {floats}[(k % 8 + 1)::int] as tags
from reads join letters using (rec_idx) where {where}"""


def _fasta(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a name ends with the first blank
    rows = [(r["contig"].replace(" ", "_"), r["seq"]) for r in fx.sequences(spark, sf_dir).collect()]  # five short contigs
    path = _put(spark, "genome.fa", (x for n, s in rows for x in (f">{n} made", *(s[i : i + 60] for i in range(0, len(s), 60)))))
    return fasta.read_bins(spark, path, fx.WIDTH).select("contig", "bin", "bin_start", "length", "seq")


_FASTA_SQL = f"""select replace(r_name, ' ', '_') as contig, (g // {fx.WIDTH})::bigint as bin, (g // {fx.WIDTH} * {fx.WIDTH})::bigint as bin_start, {fx.LENGTH}::bigint as length,
  string_agg(case when g >= 500 and g < 520 then lower('ACGT'[(ref + 1)::int]) else 'ACGT'[(ref + 1)::int] end, '' order by g) as seq
from (select r_name, g, ((g * 7919 + g * g * 104729 + r_regionkey * 1299709) % 1009) % 4 as ref from region, (select unnest(range({fx.LENGTH})) as g)) group by 1, 2, 3"""


def _texts(table: DataFrame, *columns: str) -> Iterable[str]:
    return (r["x"] for r in table.select(F.concat_ws("\t", *(F.col(c).cast("string") for c in columns)).alias("x")).toLocalIterator())


def _bed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _texts(fx.bed(spark, sf_dir).orderBy("contig", "start", "end"), "contig", "start", "end")
    path = _put(spark, "regions.bed", (x for part in (["# made", "track name=made", ""], rows, ["short\t1"]) for x in part))
    return tables.read_bed(spark, path)


def _discounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _texts(fx.discounts(spark, sf_dir), "base_change", "read_num", "base_position", "discount_count")
    return tables.read_discounts(spark, _put(spark, "discounts.tsv", (x for part in (["a header"], rows, ["C>T\tx\t1\t1", "three\t1\t2"]) for x in part)))


def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _texts(fx.matrix(spark, sf_dir), "read_num", "position", "ref_base", "read_base", "scaling_factor")
    return tables.read_matrix(spark, _put(spark, "matrix.tsv", (x for part in (["read_num\tposition\tref_base\tread_base\tscaling_factor"], rows) for x in part)))


def _plot_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _file(spark, "counts.tsv")
    sinks.write_counts(counts(spark, sf_dir, CONFIG), path, insert_mode=True)
    table, insert = tables.read_plot_table(spark, path)
    return table.withColumn("insert_mode", F.lit(insert))


def _lines(write: Callable[[SparkSession, str, str], None]) -> Callable[[SparkSession, str], DataFrame]:
    """The lines of a file that write makes, numbered from 0."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = _file(spark, "lines")
        write(spark, sf_dir, path)
        return numbered(spark, path).select("line_no", "line")

    return query


def _lines_sql(ctes: str, source: str, order: str, columns: list[str], header: str | None = None) -> str:
    text = " || chr(9) || ".join(columns)
    head = f" union all select 0 as line_no, '{header}' as line" if header else ""
    return f"{ctes} select (row_number() over (order by {order}) - {0 if header else 1})::bigint as line_no, {text} as line from ({source}) x{head}"


def _write_normalized(spark: SparkSession, sf_dir: str, path: str) -> None:
    sinks.write_normalized(mismatch.normalized(counts(spark, sf_dir, READ_CUT)), path, insert_mode=False)


def _write_matrix(spark: SparkSession, sf_dir: str, path: str) -> None:
    sinks.write_matrix(mismatch.rescaling_matrix(mismatch.normalized(counts(spark, sf_dir, READ_CUT))), path)


_TAB = "\t"
_NORMED = counts_sql(READ_CUT) + ", normed as (select base_change, read_num, reference_order, base_position, case when t = 0 then 0.0::double else count::double / t end as f from (select *, (sum(count) over (partition by read_num, base_position, base_change[1]))::double as t from counts))"
_DIAGNOSED = dq._sql(dq.CONFIG)

QUERIES = {
    "source_sam": (_sam, _records_sql("i")),
    "source_bam": (_bam, _records_sql("C")),
    "source_bam_region": (_bam_region, _records_sql("C", f"contig_id = 1 and pos >= {REGION[0]} and pos < {REGION[1]}")),
    "source_fasta": (_fasta, _FASTA_SQL),
    "source_bed": (
        _bed,
        f"with {fx.BED}, m as (select *, max(b1) over (partition by contig order by b0, b1 rows between unbounded preceding and 1 preceding) as reach from bed), i as (select *, sum(case when reach is null or b0 > reach then 1 else 0 end) over (partition by contig order by b0, b1 rows unbounded preceding) as island from m) select contig, min(b0) as start, max(b1) as \"end\" from i group by contig, island",
    ),
    "source_discounts": (_discounts, f"with {fx.DISCOUNTS} select base_change, read_num, base_position, d as discount_count from disc"),
    "source_matrix": (_matrix, f"with {dq._MATRIX} select read_num::int as read_num, position::int as position, ref_base, read_base, f as scaling_factor from mat"),
    "source_plot_table": (_plot_table, counts_sql(CONFIG) + " select base_change, read_num::int as read_num, reference_order::int as reference_order, base_position as position, count, true as insert_mode from counts"),
    "sink_normalized": (
        _lines(_write_normalized),
        _lines_sql(_NORMED, "select * from normed", "reference_order, read_num, base_position, base_change", ["base_change", "read_num", "reference_order", "base_position", "printf('%.6f', f)"], _TAB.join(["base_change", "read_num", "reference_order", "read_position", "normalized_frequency"])),
    ),
    "sink_matrix": (
        _lines(_write_matrix),
        _lines_sql(_NORMED, "select distinct read_num, base_position % 65536 as position, base_change[1] as a, base_change[3] as b from normed", "read_num, position, a, b", ["read_num", "position", "a", "b", "'1.000000'"]),
    ),
    "sink_variants": (
        _lines(lambda spark, sf_dir, path: sinks.write_variants(dq.found("variants", dq.CONFIG)(spark, sf_dir), path)),
        _lines_sql(_DIAGNOSED, dq._ENDS["variants"], "chromosome, position, reference_base, mismatch_base", ["chromosome", "position", "reference_base", "mismatch_base", '"count"', '"depth"'], _TAB.join(["chromosome", "position", "reference_base", "mismatch_base", "count", "depth"])),
    ),
    "sink_inconsistencies": (
        _lines(lambda spark, sf_dir, path: sinks.write_inconsistencies(dq.found("inconsistencies", dq.CONFIG)(spark, sf_dir), path)),
        _lines_sql(_DIAGNOSED, dq._ENDS["inconsistencies"], "read1_position, read2_position, discordance_type", ["read1_position", "read2_position", "discordance_type", '"count"'], _TAB.join(["read1_position", "read2_position", "discordance_type", "count"])),
    ),
    "sink_discounts": (
        _lines(lambda spark, sf_dir, path: sinks.write_discounts(dq.found("discounts", dq.CONFIG)(spark, sf_dir), path)),
        _lines_sql(_DIAGNOSED, dq._ENDS["discounts"], "read_num, read_position, mismatch_type", ["mismatch_type", "read_num", "read_position", "discount_count"], _TAB.join(["mismatch_type", "read_num", "read_position", "discount_count"])),
    ),
}
