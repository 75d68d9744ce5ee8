"""Every query with SQL gives the rows that DuckDB gives."""

import math

import duckdb
import pytest

from passerine import catalog, streaming

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(rows, columns):
    clean = lambda x: None if x is None or isinstance(x, float) and math.isnan(x) else round(x, 4) if isinstance(x, float) else x
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(clean(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", catalog.oracle_sql())
def test_same_as_sql(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    want = duck.sql(catalog.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert plain(df.collect(), df.columns) == plain(want.fetchall(), want.columns)


def test_stream(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    source = spark.readStream.schema(events.schema).parquet(f"{DATA}/events.parquet*")
    run = streaming.windowed_counts(source).writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path)).start()
    run.processAllAvailable()
    run.stop()
    assert spark.table("counts").agg({"n": "sum"}).first()[0] == events.count()
