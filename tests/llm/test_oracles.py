import duckdb
import pytest

from attesta.llm import queries as q
from attesta.llm.mixing import mix_sources, source_targets, take_mix
from attesta.llm.quality import quality_rules

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query_matches_sql(spark, name):
    c = duckdb.connect()
    for table in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DIR}/{table}.parquet'")
    got = q.queries()[name](spark, DIR)
    cols = sorted(got.columns)
    want = c.sql(q.oracle_sql()[name]).project(", ".join(cols)).fetchall()
    assert sorted(map(tuple, got.select(*cols).collect()), key=repr) == sorted(want, key=repr)


def test_odd_rows_match_sql(spark, odd, tmp_path):
    plain = odd.where("doc_id is not null").dropDuplicates(["doc_id", "text"]).select("doc_id", "text", "source")
    plain.coalesce(1).write.parquet(str(tmp_path / "d"))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    mixed = mix_sources(plain).select("doc_id", "size", "source_size", "target", "taken")
    rules = quality_rules(plain).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_stop_words")
    for got, name in ((mixed, "op8_mixing"), (rules, "op3_quality")):
        cols = sorted(got.columns)
        want = c.sql(q.oracle_sql()[name]).project(", ".join(cols)).fetchall()
        assert sorted(map(tuple, got.select(*cols).collect()), key=repr) == sorted(want, key=repr)


def test_mixing_rules(spark, odd, nothing):
    assert mix_sources(nothing).count() == 0
    rows = mix_sources(odd).collect()
    assert len(rows) == odd.count()
    for source in {(r.s_null, r.s_val) for r in rows}:
        own = [r for r in rows if (r.s_null, r.s_val) == source]
        assert sum(r.taken for r in own) == round(own[0].target) and all(r.taken <= 3 * r.size for r in own)
    # one source gives nearly all: the others stop at three times their size
    skewed = spark.createDataFrame([(False, "a", 1000), (False, "b", 10), (True, "", 10)], "s_null boolean, s_val string, source_size long")
    assert {r.s_val: r.target for r in source_targets(skewed, (1, 2, 3), 3).collect()} == {"a": 960.0, "b": 30.0, "": 30.0}


def test_taken_rows(spark, docs):
    taken = {r.doc_id: r.taken for r in mix_sources(docs).collect()}
    got = {}
    for r in take_mix(docs).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(r.text.split())
        assert r.n_chars == len(r.text)
    assert got == {k: v for k, v in taken.items() if v}


def test_taken_odd_rows(odd, nothing):
    out = take_mix(odd)
    assert out.dtypes == odd.dtypes and out.count() > 0
    assert take_mix(nothing).count() == 0


def test_repeated_rows_at_the_cut(spark):
    """Rows without ids and rows that repeat each other are taken to the exact budget."""
    rows = [(None, "one two three", "a")] * 40 + [(None, f"w{k} x y z", "a") for k in range(20)] + [(k, "p q " * 30, "b") for k in range(20)] + [(7, "t u", None)] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    budget = {r.source: r.words for r in mix_sources(docs).selectExpr("if(s_null, null, s_val) source", "taken").groupBy("source").agg({"taken": "sum"}).withColumnRenamed("sum(taken)", "words").collect()}
    got = {}
    for r in take_mix(docs).collect():
        got[r.source] = got.get(r.source, 0) + len(r.text.split())
    assert got == {k: v for k, v in budget.items() if v}
