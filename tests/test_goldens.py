"""Expected values for small inputs."""

import pytest
from pyspark.sql import functions as F

from strandframe import cli
from strandframe.config import DiagnosticsConfig, MismatchConfig, ReadFilter, check_bed_mode
from strandframe.functions import cigar, exprs
from strandframe.operators import bases, diagnostics, intervals, legacy, mismatch, plotprep, rescale
from strandframe.sources import bam, fasta, sam, sinks, tables

HEADER = "@HD\tVN:1.6\tSO:coordinate\n@SQ\tSN:chr1\tLN:{}\n"
READ = "read1\t0\tchr1\t1\t60\t8M\t*\t0\t0\tACGTTCGT\tIIIIIIII\tNM:i:1\n"
PAIR = "p\t99\tchr1\t1\t60\t8M\t=\t5\t12\tACGTACGT\tIIIIIIII\tMC:Z:8M\np\t147\tchr1\t5\t60\t8M\t=\t1\t-12\tACGAACGT\tIIIIIIII\tMC:Z:8M\n"


@pytest.fixture
def files(tmp_path):
    def make(records, length=8, sequence="ACGTACGT"):
        (tmp_path / "in.sam").write_text(HEADER.format(length) + records)
        (tmp_path / "ref.fa").write_text(f">chr1 some words\n{sequence}\n")
        return str(tmp_path / "in.sam"), str(tmp_path / "ref.fa")

    return make


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def one(spark, column, **values):
    literal = [F.lit(v).alias(k) for k, v in values.items()]
    return spark.range(1).select(*literal).select(column).first()[0]


def test_mismatch_command(spark, files, tmp_path):
    path, ref = files(READ)
    cli.main(["mismatch", path, ref, "--position-mode", "read", "-o", str(tmp_path / "out.tsv")], spark)
    lines = (tmp_path / "out.tsv").read_text().splitlines()
    assert lines[0] == "base_change\tread_num\treference_order\tread_position\tcount"
    assert "A>T\t1\t1\t5\t1" in lines and len(lines) == 9


def test_plot_series_command(spark, files, tmp_path):
    for more in ([], ["--position-mode", "read", "--normalize"]):
        cli.main(["mismatch", *files(READ), "-o", str(tmp_path / "c.tsv"), "--plot", str(tmp_path / "p.tsv"), "-t", "2", *more], spark)
        head, *lines = (tmp_path / "p.tsv").read_text().splitlines()
        assert head.split("\t") == ["read_num", "base_change", "reference_order", "position", "y_count", "y_norm"] and len(lines) % 12 == 0 and lines


def test_mismatch_normalized_discounted_and_matrix(spark, files, tmp_path):
    path, ref = files(READ)
    (tmp_path / "d.tsv").write_text("anything\nA>T\t1\t5\t1\nA>T\t1\tx\t1\nA>T\t1\t5\n")
    out = tmp_path / "out.tsv"
    cli.main(["mismatch", path, ref, "--position-mode", "read", "--discount-table", str(tmp_path / "d.tsv"), "--normalize", "-o", str(out)], spark)
    assert "A>T\t1\t1\t5\t0.000000" in out.read_text().splitlines()
    cli.main(["mismatch", path, ref, "--position-mode", "read", "--normalize", "--emit-rescaling-matrix", "-o", str(out)], spark)
    assert "1\t5\tA\tT\t1.000000" in out.read_text().splitlines() and "read_num" not in out.read_text()


def test_diagnostics_command(spark, files, tmp_path, capsys):
    path, ref = files(READ)
    v, i = tmp_path / "v.tsv", tmp_path / "i.tsv"
    cli.main(["diagnostics", path, ref, "--genomic-threshold", "1", "--genomic-depth-threshold", "1", "--variants-output", str(v), "--inconsistencies-output", str(i), "--discount-output", "-"], spark)
    assert v.read_text().splitlines() == ["chromosome\tposition\treference_base\tmismatch_base\tcount\tdepth", "chr1\t4\tA\tT\t1\t1"]
    assert i.read_text().splitlines() == ["read1_position\tread2_position\tdiscordance_type\tcount"]
    assert capsys.readouterr().out.splitlines() == ["mismatch_type\tread_num\tread_position\tdiscount_count", "A>T\t1\t4\t1"]


def test_rescale_command(spark, files, tmp_path):
    path, ref = files(READ)
    (tmp_path / "m.tsv").write_text("read_num\tposition\tref_base\tread_base\tscaling_factor\n1\t4\tA\tT\t0.9\n1\t4\tA\tT\t0.5\n")
    out = tmp_path / "out.sam"
    cli.main(["rescale", path, ref, str(tmp_path / "m.tsv"), "-o", str(out)], spark)
    record = out.read_text().splitlines()[-1].split("\t")
    assert record[10] == "IIII5III" and record[11] == "NM:i:1" and record[3] == "1"
    (tmp_path / "none.tsv").write_text("")
    cli.main(["rescale", path, ref, str(tmp_path / "none.tsv"), "-o", str(out)], spark)
    assert out.read_text().splitlines()[-1] == READ.strip()


def test_pair_disagreement(spark, files):
    path, ref = files(PAIR, 32, "ACGT" * 8)
    out = diagnostics.diagnose(sam.read_alignments(spark, path), fasta.read_bins(spark, ref), DiagnosticsConfig(min_count=1, min_depth=1))
    assert rows(out["inconsistencies"]) == [(7, 3, "R1:T_R2:A", 1)]
    assert rows(out["variants"]) == []
    assert {(r["g_pos"], r["depth"]) for r in out["depth"].collect()} == {(g, 2 if 4 <= g < 8 else 1) for g in range(12)}


def test_cut_and_stretch(spark, files):
    path, ref = files(PAIR, 32, "ACGT" * 8)
    reads, reference = sam.read_alignments(spark, path), fasta.read_bins(spark, ref)
    total = lambda mode: mismatch.mismatch_counts(reads, reference, MismatchConfig(position_mode="read", overlap_mode=mode)).agg(F.sum("count")).first()[0]
    assert (total("cut"), total("stretch")) == (12, 16)


@pytest.mark.parametrize(("p", "n", "m", "insert", "num", "want"), [(10, 100, 0, False, 1, 10), (60, 100, 150, False, 1, 110), (40, 100, 150, False, 1, 40), (30, 90, 100, True, 2, 150)])
def test_mode_position(spark, p, n, m, insert, num, want):
    column = exprs.diagnostic_position(F.col("p"), F.col("n"), F.lit(False), F.col("num"), m, insert)
    assert one(spark, column, p=p, n=n, num=num) == want


def test_positions(spark):
    read = lambda p, rev=False: one(spark, exprs.read_position(F.col("p"), F.lit(10), F.lit(10), F.lit(rev)), p=p)
    assert [read(2), read(7), read(2, True)] == [3, 8, 8]
    place = lambda p, n, m, order, stretch=False: one(spark, exprs.insert_position(F.col("p"), F.lit(n), F.lit(m), F.lit(None).cast("long"), F.lit(order), stretch), p=p)
    assert [place(0, 10, 10, 1), place(9, 10, 10, 1), place(8, 10, 12, 2)] == [1, 10, 23]
    assert [place(p, 8, 8, 1, True) for p in range(8)] == [1, 1, 2, 4, 5, 7, 8, 8]


@pytest.mark.parametrize(("text", "want"), [("10M", 10), ("5M2D3M", 10), ("5M3I2M", 7), ("", 0), ("10?", None), ("12", None)])
def test_spans(spark, text, want):
    assert one(spark, cigar.text_span(F.col("c")), c=text) == want


def test_segments(spark):
    parts = lambda c, pos: [(s["read"], s["genome"], s["len"]) for s in one(spark, cigar.segments(cigar.operations(F.col("c")), F.lit(pos)), c=c) if s["op"] in cigar.ALIGNED]
    assert parts("3S10M2D5M1I4M2S", 100) == [(3, 100, 10), (13, 112, 5), (19, 117, 4)]
    assert parts("5H3S4M", 7) == [(3, 7, 4)]
    assert one(spark, cigar.span(cigar.operations(F.col("c"))), c="10M2D5M3I4N") == 21


def test_md_tag_rejects_other_characters(spark):
    with pytest.raises(Exception, match="unexpected character"):
        one(spark, cigar.md_tag(F.col("md"))[0], md="5*3")


@pytest.mark.parametrize(("ref", "read", "rev", "num", "meth", "want"), [("C", "T", False, 1, False, "C>T"), ("C", "T", False, 1, True, "C>C"), ("G", "A", False, 2, True, "G>G"), ("G", "A", True, 1, True, "C>C"), ("G", "A", True, 1, False, "C>T")])
def test_base_change(spark, ref, read, rev, num, meth, want):
    assert one(spark, exprs.base_change(F.lit(ref), F.lit(read), F.lit(rev), F.lit(num), meth)) == want


def test_mate(spark):
    values = {"flag": 0x63, "tid": 0, "mtid": 0, "pos": 0, "mpos": 4, "mc": "8M", "end": 8}
    mate = exprs.mate_end(cigar.text_span(F.col("mc")))
    assert one(spark, mate, **values) == 12
    assert one(spark, exprs.fragment_length(F.col("end"), mate), **values) == 12
    assert tuple(one(spark, F.struct(*exprs.overlap(F.col("pos"), F.col("end"), F.col("mpos"), mate)), **values)) == (4, 8)
    for change in ({"mc": None}, {"mtid": 1}, {"flag": 0}, {"flag": 0x6B}, {"mc": "8?"}):
        assert one(spark, mate, **(values | change)) is None


@pytest.mark.parametrize(("flag", "filter_", "want"), [(0, ReadFilter(), False), (4, ReadFilter(), True), (1, ReadFilter(required_flags=3), True), (3, ReadFilter(required_flags=3), False), (256, ReadFilter(), False), (256, ReadFilter(primary_only=True), True), (1, ReadFilter(filter_flags=1), True), (1, ReadFilter(excl_flags=3), False), (3, ReadFilter(excl_flags=3), True)])
def test_skipped(spark, flag, filter_, want):
    assert one(spark, exprs.skipped(filter_), flag=flag, mapq=60) is want


def test_clips(spark, files):
    path, ref = files("r\t0\tchr1\t3\t60\t2S6M2S\t*\t0\t0\tAACCCCGGGG\tIIIIIIIIII\n", 10, "AATTTTTTAA")
    reads = bases.on_reference(bases.prepared(sam.read_alignments(spark, path)), fasta.read_bins(spark, ref))
    found = bases.clipped(reads, ["rec_idx"]).groupBy("side").agg(F.avg((F.col("read_base") == F.col("ref_base")).cast("double")))
    assert dict(map(tuple, found.collect())) == {"left": 1.0, "right": 0.0}


def test_bins_cut_reads(spark, files):
    path, ref = files("r\t0\tchr1\t2\t60\t2M3N4M\t*\t0\t0\tCGTACG\tIIIIII\n", 32, "ACGTACGTACGTACGTACGTACGTACGTACGT")
    reads, table = sam.read_alignments(spark, path), sam.read_contigs(spark, path)
    whole = mismatch.mismatch_counts(reads, fasta.read_bins(spark, ref), MismatchConfig(position_mode="read"), contigs=table)
    for width in (1, 2, 3, 5):
        cut = mismatch.mismatch_counts(reads, fasta.read_bins(spark, ref, width), MismatchConfig(position_mode="read"), contigs=table, width=width)
        assert sorted(rows(cut)) == sorted(rows(whole))


def test_bed(spark, tmp_path):
    path = tmp_path / "x.bed"
    path.write_text("# c\ntrack x\nchr1\t10\t100\tname\nchr1\t20\t30\n\nchr1\t90\t120\nchr1\t130\t140\nchr1\t150\t150\nchr2\t5\n")
    assert rows(tables.read_bed(spark, str(path)), "start") == [("chr1", 10, 120), ("chr1", 130, 140)]
    path.write_text("chr1\t10\t20\nchr1\t5\t8\n")
    with pytest.raises(Exception, match="not sorted"):
        tables.read_bed(spark, str(path)).collect()
    path.write_text("chr1\tx\t20\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        tables.read_bed(spark, str(path)).collect()
    assert tables.maybe_bed(spark, None) is None
    with pytest.raises(ValueError, match="bed_mode"):
        check_bed_mode("both")


def test_bed_in_queries(spark, files):
    path, ref = files(READ)
    reads, reference, contigs = sam.read_alignments(spark, path), fasta.read_bins(spark, ref), sam.read_contigs(spark, path)
    bed = spark.createDataFrame([("chr1", 2, 4)], "contig string, start long, end long")
    count = lambda b, mode: mismatch.mismatch_counts(reads, reference, MismatchConfig(position_mode="read", bed_mode=mode), b, contigs).agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    assert count(bed, "mask") == 6 and count(bed, "filter") == 0
    assert intervals.masked_count(bed, contigs).first()["masked"] == 2
    # a read that ends where an interval starts touches it, if the interval is in the read's chunk
    beside = spark.createDataFrame([("chr1", 8, 9)], "contig string, start long, end long")
    long = spark.createDataFrame([(0, "chr1", 20)], "tid int, contig string, length long")
    assert mismatch.mismatch_counts(reads, reference, MismatchConfig(bed_mode="filter"), beside, long).count() == 0


def test_tables(spark, tmp_path):
    path = tmp_path / "t.tsv"
    path.write_text("A>C\t1\t2\t100\nA>T\t1\t4\t2\nA>T\t1\t4\t3\nA>T\t1\tz\t3\nA>T\t1\t4\n")
    assert rows(tables.read_discounts(spark, str(path))) == [("A>T", 1, 4, 5)]
    path.write_text("read_num\tposition\tref\tread\tfactor\n1\t4\tAx\tT\t0.25\n1\t4\tA\tT\t0.5\n1\t70000\tA\tT\t1\n300\t4\tA\tT\t1\n1\t4\tA\n")
    assert rows(tables.read_matrix(spark, str(path))) == [(1, 4, "A", "T", 0.5)]


def test_normalized(spark):
    counts = spark.createDataFrame([("A>A", 1, 1, 5, 5), ("A>C", 1, 1, 5, 3), ("A>T", 1, 2, 5, 2), ("C>T", 1, 1, 5, 0)], "base_change string, read_num int, reference_order int, base_position long, count long")
    assert {r["base_change"]: r["normalized_frequency"] for r in mismatch.normalized(counts).collect()} == {"A>A": 0.5, "A>C": 0.3, "A>T": 0.2, "C>T": 0.0}


def test_legacy_tables(spark, tmp_path):
    wide = legacy.wide_positions(spark.createDataFrame([("A>C", 1, 2, 4), ("C>T", 2, 1, 3)], "mismatch_type string, read_num int, read_position long, count long"))
    sinks.write_wide_positions(wide, str(tmp_path / "w.csv"))
    assert (tmp_path / "w.csv").read_text() == "Read,Position,A>C,C>T\n1,2,4,0\n2,1,0,3\n"
    inc = legacy.wide_inconsistencies(spark.createDataFrame([(1, 2, "R1:A_R2:C", 3)], "read1_position long, read2_position long, discordance_type string, count long"))
    sinks.write_wide_inconsistencies(inc, str(tmp_path / "i.csv"))
    assert (tmp_path / "i.csv").read_text().splitlines()[1:] == ["# Read Pair Inconsistencies", "Read1_Pos,Read2_Pos,R1:A_R2:C", "1,2,3"]
    assert one(spark, exprs.canonical(F.lit("G>A"))) == "C>T" and one(spark, exprs.canonical(F.lit("A>G"))) == "A>G"


def test_invalid_types_are_dropped(spark):
    sites = spark.createDataFrame([(0, "c", 1, "INVALID", 9, 9), (0, "c", 2, "A>T", 9, 9)], "chunk long, contig string, g_pos long, mismatch_type string, count long, depth long")
    assert rows(diagnostics.variants(sites)) == [("c", 2, "A", "T", 9, 9)]


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one x\nACgt\nAC\n>two\nTTTT\n>one\nGGGGGGG\nC\n>empty\n")
    assert dict(map(tuple, fasta.read_sequences(spark, str(tmp_path / "a.fa")).collect())) == {"one": "GGGGGGGC", "two": "TTTT"}
    bins = fasta.read_bins(spark, str(tmp_path / "a.fa"), 3)
    assert rows(bins.where("contig = 'one'").select("bin", "bin_start", "length", "seq"), "bin") == [(0, 0, 8, "GGG"), (1, 3, 8, "GGG"), (2, 6, 8, "GC")]
    same = bases.reference_bins(fasta.read_sequences(spark, str(tmp_path / "a.fa")), 3)
    assert sorted(rows(same.select("contig", "bin", "bin_start", "length", "seq"))) == sorted(rows(bins.select("contig", "bin", "bin_start", "length", "seq")))


def test_longest_read(spark, files):
    path, _ = files("".join(f"r{i}\t4\t*\t0\t0\t*\t*\t0\t0\t{'A' * n}\t{'I' * n}\n" for i, n in enumerate((10, 15, 10, 20, 10, 90))))
    reads = sam.read_alignments(spark, path)
    assert bases.longest_read(reads, 5) == 20 and bases.longest_read(reads.limit(0), 5) == 0


@pytest.mark.parametrize("split", [700, 20_000, 1 << 30])
def test_bam_round_trip(spark, tmp_path, split):
    text = HEADER.format(100_000) + "@SQ\tSN:chr2\tLN:100\n"
    contigs = [("chr1", 100_000), ("chr2", 100)]
    records = "".join(f"r{i}\t{(99, 147, 0, 4)[i % 4]}\t{'*' if i % 4 == 3 else 'chr1'}\t{0 if i % 4 == 3 else i + 1}\t{i % 61}\t{'*' if i % 4 == 3 else '2S30M1I67M'}\t{'=' if i % 4 < 2 else 'chr2' if i % 4 == 2 else '*'}\t{i % 90 + 1 if i % 4 < 3 else 0}\t{i % 300 - 150}\t{'ACGTN' * 20}\t{'*' if i % 7 == 0 else 'I' * 100}\tMC:Z:8M\tNM:S:{i}\tXI:i:-{i + 1}\tXF:f:0.12345678\tXB:B:c,1,-2\tXA:B:f,0.1,2.5\n" for i in range(6000))
    (tmp_path / "a.sam").write_text(text + records)
    reads = sam.read_alignments(spark, str(tmp_path / "a.sam"))
    path = str(tmp_path / "a.bam")
    bam.write(reads.orderBy("rec_idx").toLocalIterator(), text, contigs, path)
    back = bam.BamReader({"path": path, "split_bytes": str(split)})
    parts = back.partitions()
    assert (len(parts) > 1) == (split < 1 << 30)
    got = [r for p in parts for r in back.rows(p)]
    assert len(got) == 6000 and all(a[0] < b[0] for a, b in zip(got, got[1:], strict=False))
    assert sum(b.num_rows for p in parts for b in back.read(p)) == 6000
    want = [tuple(r)[1:] for r in reads.orderBy("rec_idx").collect()]
    assert [tuple(r[1:]) for r in got] == want
    if split == 20_000:
        frame = bam.read_alignments(spark, path, "chr1:10-20")
        assert {r["pos"] for r in frame.collect()} == {i for i in range(10, 20) if i % 4 != 3}
        assert rows(bam.read_contigs(spark, path)) == [(0, *contigs[0]), (1, *contigs[1])]
        # written by tasks, in order of place; an index leads to the same records of a region
        ordered = str(tmp_path / "b.bam")
        bam.write_alignments(bam.read_alignments(spark, path), text, contigs, ordered)
        again = [r for p in bam.BamReader({"path": ordered}).partitions() for r in bam.BamReader({"path": ordered}).rows(p)]
        assert sorted(r[1:] for r in again) == sorted(want) and [r[5] for r in again if r[3] >= 0] == sorted(r[5] for r in again if r[3] >= 0)
        for region in ("chr1:0-1", "chr1:100-200", "chr1:5990-100000", "chr2:0-100", "chr3:0-9"):
            plain = sorted(r[1:] for p in bam.BamReader({"path": ordered, "region": region}).partitions() for r in bam.BamReader({"path": ordered, "region": region}).rows(p))
            bam.write_index(ordered)
            reader = bam.BamReader({"path": ordered, "region": region})
            assert all(p.chunk for p in reader.partitions())
            assert sorted(r[1:] for p in reader.partitions() for r in reader.rows(p)) == plain
            (tmp_path / "b.bam.bai").unlink()


def test_sam_round_trip(spark, tmp_path):
    text = HEADER.format(50) + PAIR + "u\t4\t*\t0\t0\t*\t*\t0\t0\t*\t*\n"
    (tmp_path / "a.sam").write_text(text)
    sinks.write_sam(sam.read_alignments(spark, str(tmp_path / "a.sam")), sam.read_header(spark, str(tmp_path / "a.sam")), str(tmp_path / "b.sam"))
    back = [x.split("\t") for x in (tmp_path / "b.sam").read_text().splitlines()]
    for x, y in zip([x.split("\t") for x in text.splitlines()], back, strict=True):
        assert x == y


@pytest.mark.parametrize("mode", ["", "mask", "filter"])
def test_streamed_counts(spark, files, tmp_path, mode):
    from strandframe.schema import ALIGNMENTS
    from strandframe.streaming import running_counts

    path, ref = files(PAIR, 32, "ACGT" * 8)
    reads, reference, config = sam.read_alignments(spark, path), fasta.read_bins(spark, ref), MismatchConfig(position_mode="read", bed_mode=mode or "mask")
    bed = spark.createDataFrame([("chr1", 2, 4)], "contig string, start long, end long") if mode else None
    contigs = sam.read_contigs(spark, path)
    reference.write.parquet(str(tmp_path / "reference"))
    contigs.write.parquet(str(tmp_path / "contigs"))
    reference, contigs = (spark.read.parquet(str(tmp_path / x)) for x in ("reference", "contigs"))
    for i in range(2):
        reads.where(F.col("rec_idx") % 2 == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "stream"))
    stream = spark.readStream.schema(ALIGNMENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "stream"))
    q = running_counts(stream, reference, config, 8, bed=bed, contigs=contigs).writeStream.outputMode("complete").format("memory").queryName(f"counts{mode}").start()
    try:
        q.processAllAvailable()
        assert sorted(rows(spark.table(f"counts{mode}"))) == sorted(rows(mismatch.mismatch_counts(reads, reference, config, bed=bed, contigs=contigs, longest=8)))
    finally:
        q.stop()


def test_plot_table(spark, files, tmp_path):
    path, ref = files(READ)
    cli.main(["mismatch", path, ref, "-o", str(tmp_path / "o.tsv")], spark)
    table, insert = tables.read_plot_table(spark, str(tmp_path / "o.tsv"))
    assert insert
    prepared = plotprep.prepared(table, insert_mode=True)
    assert rows(plotprep.mismatches(prepared).select("base_change", "read_num", "position", "normalized_count")) == [("A>T", 1, 5, 1.0)]
    assert plotprep.zero_filled(prepared).count() == 12
    assert rows(plotprep.selected_sums(plotprep.combined(prepared), ("A>T",))) == [(1, 5, 1.0, 1.0)]


def test_rescale_caps_and_keeps(spark, files):
    path, ref = files(READ.replace("IIIIIIII", "~~~~~~~~") + "u\t4\t*\t0\t0\t*\t*\t0\t0\tAC\tII\n")
    matrix = spark.createDataFrame([(1, 4, "A", "T", 1.0)], "read_num int, position int, ref_base string, read_base string, scaling_factor float")
    out = rescale.in_order(rescale.rescale(sam.read_alignments(spark, path), fasta.read_bins(spark, ref), matrix)).collect()
    assert out[0]["qual"] == [93] * 4 + [40] + [93] * 3 and out[1]["qual"] == [40, 40] and out[1]["tid"] == -1
    empty = matrix.limit(0)
    assert [r["qual"] for r in rescale.rescale(sam.read_alignments(spark, path), fasta.read_bins(spark, ref), empty).orderBy("rec_idx").collect()] == [[93] * 8, [40, 40]]


def test_unused_fragment_lengths_warn():
    with pytest.warns(UserWarning, match="select nothing"):
        MismatchConfig(min_fragment_length=5)


def test_demo_table(spark):
    table = plotprep.demo_table(spark)
    assert sorted(rows(table)) == sorted(rows(plotprep.demo_table(spark))) and table.where("count <= 0").count() == 0
    top = {r["base_change"]: r["at"] for r in table.groupBy("base_change").agg(F.max_by("fragment_position", "count").alias("at")).collect()}
    assert top["C>T"] < 8 and top["G>A"] > 52 and table.count() == 12 * 2 * 2 * 60
