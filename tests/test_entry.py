import os

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def test_registered():
    names = set(entry.queries())
    assert {"p3_found", "catalog_lifecycle", "snapshot_upsert"} <= names
    assert set(entry.oracle_sql()) <= names


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the test tables")
@pytest.mark.parametrize("name", ["catalog_lifecycle", "snapshot_upsert", "relevance_topk"])
def test_against_sql(spark, name):
    import glob
    from collections import Counter

    import duckdb

    df = entry.queries()[name](spark, SMALL)
    cols = sorted(df.columns)
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS FROM '{f}'")
    got = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in got.description]
    want = Counter(repr(tuple(dict(zip(names, r))[c] for c in cols)) for r in got.fetchall())
    assert Counter(repr(tuple(r[c] for c in cols)) for r in df.collect()) == want
