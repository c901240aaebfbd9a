"""Files of reads are written, indexed and read by tasks: no step takes a whole file through one process."""

from pyspark.sql import DataFrame

from strandframe.plans import fixtures as fx
from strandframe.plans import source_queries as sq
from strandframe.sources import bam, sam, sinks

SF = "/root/testdata/sf0.001"


def test_index_and_regions_by_ranges(spark):
    path = sq._bam_path(spark, "/root/testdata/sf0.01")
    own = path.removeprefix("file://")
    bam.write_index(path, spark, split=1 << 14)
    parts = open(own + ".bai", "rb").read()
    bam.write_index(path)
    assert parts == open(own + ".bai", "rb").read()
    name = bam.header(path)[1][1][0]
    whole = bam.BamReader({"path": path, "region": f"{name}:100-700"})
    cut = bam.BamReader({"path": path, "region": f"{name}:100-700", "split_bytes": str(1 << 14)})
    assert len(cut.partitions()) > len(whole.partitions())
    rows = lambda r: [x for p in r.partitions() for x in r.rows(p)]
    assert len(rows(whole)) > 20 and rows(cut) == rows(whole)


def test_sam_is_written_by_tasks(spark, tmp_path, monkeypatch):
    records = fx.alignments(spark, SF)
    contigs = sq._contigs(spark, SF)
    monkeypatch.setattr(DataFrame, "toLocalIterator", None)
    sinks.write_sam(records, sq._head(contigs), str(tmp_path / "a.sam"))
    lines = (tmp_path / "a.sam").read_text().splitlines()
    assert lines[: len(contigs) + 1] == sq._head(contigs) and len(lines) == len(contigs) + 1 + records.count()
    back = sam.read_alignments(spark, str(tmp_path / "a.sam")).orderBy("rec_idx").select("qname", "flag", "pos")
    assert [tuple(x) for x in back.collect()] == [tuple(x) for x in records.where("tid >= 0").orderBy("tid", "pos", "rec_idx").select("qname", "flag", "pos").collect()]


def test_line_numbers_need_no_shuffle_of_lines(spark, tmp_path):
    from strandframe.sources.lines import numbered

    (tmp_path / "x").mkdir()
    for n in range(3):
        (tmp_path / "x" / f"{n}.txt").write_text("".join(f"{n} {i}\n" for i in range(2000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        rows = numbered(spark, str(tmp_path / "x"))
        assert [x["line"] for x in rows.orderBy("line_no").collect()] == [f"{n} {i}" for n in range(3) for i in range(2000)]
        assert sorted(x["line_no"] for x in rows.collect()) == list(range(6000))
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "row_number" not in plan
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
