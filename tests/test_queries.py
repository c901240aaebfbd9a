"""Every registered query against its SQL oracle, in another engine."""

import pytest

from strandframe.plans import registry

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def norm(rows):
    return sorted(tuple(repr(round(x, 9)) if isinstance(x, float) else repr(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_oracle(spark, con, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = norm(df.select(*(f"`{c}`" for c in columns)).collect())
    found = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == norm([tuple(r[i] for i in at) for r in found.fetchall()])
