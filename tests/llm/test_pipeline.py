import corpus_pipeline as cp
from attesta.llm.common import documents, written
from attesta.llm.mixing import mix_sources

from .test_ngram_join import brute as groups
from .test_secrets import brute as secrets_in
from .test_tokens import TOKENIZER

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = documents(spark, DIR)
    columns, kept = docs.dtypes, [docs]
    for name, stage in cp.STAGES:
        docs = written(stage(spark, docs, DIR), name)
        kept.append(docs)
        if name != cp.STAGES[-1][0]:
            assert docs.dtypes == columns
    start, clean, single, redacted, mixed, packed = kept
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    text = lambda df: {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    gone = ids(start) - ids(clean)
    assert gone and not [i for i in gone if labels.get(i) == 0]
    components = groups(text(clean).items())
    assert ids(single) == {i for i, (_, c) in components.items() if i == c}
    before, after = text(single), text(redacted)
    assert before.keys() == after.keys()
    for i, t in before.items():
        assert (after[i] != t) == bool(secrets_in(t)) and not secrets_in(after[i])
    taken = {r.doc_id: r.taken for r in mix_sources(redacted).collect()}
    words = {}
    for r in mixed.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
    assert words == {i: n for i, n in taken.items() if n}
    total = sum(len(TOKENIZER.encode(r.text, add_special_tokens=False).ids) + 1 for r in mixed.collect())
    assert packed.selectExpr("sum(length)").first()[0] == total


def test_run(spark):
    assert cp.run(spark, DIR).count() > 0 and cp.ORACLE_SQL is None and 4 <= len(cp.STAGES) <= 5


def test_odd_rows_go_through_all_stages(spark, odd, nothing):
    """Nulls, empty and long texts, ties, repeated rows and clashing names; and an empty table."""
    for docs in (odd, nothing):
        start, columns = docs, docs.dtypes
        for k, (name, stage) in enumerate(cp.STAGES):
            docs = written(stage(spark, docs, DIR), name)
            if k + 1 < len(cp.STAGES):
                assert docs.dtypes == columns
            if name == "toxicity":
                assert docs.count() == start.count()
    assert docs.count() == 0
