"""Every registered contract query against its SQL on the smallest tables."""

import math

import pytest

from sparkloom import queries

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    return ("nan" if math.isnan(v) else round(v, 6) + 0.0) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, duck, name):
    df = queries.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    rel = duck.sql(queries.oracle_sql()[name])
    assert sorted(rel.columns) == columns
    order = [list(rel.columns).index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in order) for r in rel.fetchall()), key=repr)


def test_samples(spark):
    found = queries.queries()
    n = spark.read.parquet(f"{FOLDER}/orders.parquet").count()
    assert found["sample_seeded"](spark, FOLDER).count() == int(n * 0.1)
    assert found["random_split"](spark, FOLDER).count() == n
