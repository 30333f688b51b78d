"""Every registered query against its SQL on the smallest tables, and no query without rows where rows are due."""

import math

import duckdb
import pytest

from flowlens.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value


def rows_of(rows, names):
    return sorted((tuple(plain(r[c]) for c in names) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(name, spark, sf_dir, db):
    df = registry.queries()[name](spark, sf_dir)
    found = df.collect()
    assert found
    sql = registry.oracle_sql().get(name)
    if sql is None:
        return
    rel = db.execute(sql)
    columns = [c[0] for c in rel.description]
    assert sorted(columns) == sorted(df.columns)
    names = sorted(columns)
    expected = [dict(zip(columns, r, strict=True)) for r in rel.fetchall()]
    assert rows_of(found, names) == rows_of(expected, names)


def test_entry(spark):
    import __spark_entry__ as entry

    assert len(entry.entry(spark).collect()) == 7
    assert set(entry.oracle_sql()) <= set(entry.queries())
