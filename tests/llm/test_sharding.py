import zlib

import pytest

from attesta.llm.sharding import SHARDS, op5_sharding, shard_documents


def check(rows, texts):
    """Sizes, checksums and gapless slots; bytes of the shards."""
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.size, r.text_crc32) for r in rows) == sorted(
        (i is not None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts
    )
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    return [sum(r.size for r in rows if r.shard == s) for s in range(SHARDS)]


@pytest.mark.parametrize("ids", ["none", "one", "own"])
def test_copies_spread_whatever_their_ids(spark, ids):
    """3,200 rows of one text: all shards get as many, also if the ids are null or all the same."""
    texts = [({"none": None, "one": 7, "own": k}[ids], "a text of copies") for k in range(3200)]
    rows = shard_documents(spark.createDataFrame(texts, "doc_id long, text string").repartition(3), rows_per_range=500).collect()
    sizes = check(rows, texts)
    assert max(sizes) <= 1.01 * sum(sizes) / SHARDS and min(sizes) >= 0.99 * sum(sizes) / SHARDS


def test_hot_groups_beside_others(spark):
    texts = [(None, "x" * 50)] * 1000 + [(3, "y" * 90)] * 700 + [(k, f"own text {k} " * (k % 9 + 1)) for k in range(3000)]
    sizes = check(shard_documents(spark.createDataFrame(texts, "doc_id long, text string").repartition(4), rows_per_range=400).collect(), texts)
    assert max(sizes) <= 1.01 * sum(sizes) / SHARDS


def test_small_groups_stay_together(spark):
    texts = [(k, f"text number {k % 2000} " * 3) for k in range(6000)]
    rows = shard_documents(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    check(rows, texts)
    where = {}
    for r in rows:
        where.setdefault(r.text_crc32, set()).add(r.shard)
    assert all(len(s) == 1 for s in where.values())


def test_odd_rows(odd, nothing):
    assert shard_documents(nothing).count() == 0
    check(shard_documents(odd).collect(), [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()])


def test_reruns_agree(spark):
    got = [sorted(map(tuple, op5_sharding(spark, "/root/testdata/sf0.001").collect())) for _ in range(2)]
    assert got[0] == got[1]
