"""The queries over intervals and discounts take each row of part and supplier, and leave some of each contig uncovered."""

from strandframe.plans import fixtures as fx
from strandframe.plans import registry

SF = "/root/testdata/sf0.01"


def test_no_id_subsets(spark):
    rows = lambda t: spark.read.parquet(f"{SF}/{t}.parquet").count()
    assert fx.bed(spark, SF).count() == rows("part") > 40
    assert fx.discounts(spark, SF).count() == rows("supplier") > 60
    masked = [r["masked"] for r in registry.queries()["bed_masked_bases"](spark, SF).collect()]
    assert len(masked) == 5 and all(0 < n < fx.LENGTH // 2 for n in masked)


def test_oracles_have_no_filter_on_ids():
    for sql in registry.oracle_sql().values():
        assert "p_partkey <" not in sql and "s_suppkey <" not in sql
