import duckdb
import pytest

from attesta.plans import registry
from attesta.streaming.basics import stream_basics

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def test_every_query_has_sql():
    assert registry.queries().keys() == registry.oracle_sql().keys()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_sql(spark, duck, name):
    got = registry.queries()[name](spark, DIR)
    cols = sorted(got.columns)
    want = duck.sql(registry.oracle_sql()[name])
    assert sorted(want.columns) == cols
    plain = lambda rows: sorted((tuple(None if v != v else v for v in r) for r in rows), key=repr)
    assert plain(map(tuple, got.select(*cols).collect())) == plain(want.project(", ".join(f'"{c}"' for c in cols)).fetchall())


def test_streaming_basics(spark, tmp_path):
    spark.range(10).selectExpr("id", "nullif(id % 3, 0) AS k").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, k long").parquet(str(tmp_path / "in"))
    q = stream_basics(stream).writeStream.outputMode("complete").format("memory").queryName("basics").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.column, r.rows, r.non_null) for r in spark.table("basics").collect()} == {("id", 10, 10), ("k", 10, 6)}
