import duckdb
import pytest

import __spark_entry__
from quillspan.plans import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(v):
    if hasattr(v, "as_tuple"):
        v = float(v)
    return round(v, 7) + 0.0 if isinstance(v, float) else int(v) if isinstance(v, bool) else v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, DIR)
    columns = sorted(df.columns)
    rel = duck.sql(registry.oracle_sql()[name])
    assert sorted(rel.columns) == columns
    order = [rel.columns.index(c) for c in columns]
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    theirs = sorted((tuple(plain(r[i]) for i in order) for r in rel.fetchall()), key=repr)
    assert mine == theirs


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 5
    assert set(registry.oracle_sql()) <= set(registry.queries())
