import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from attesta.llm import importance as im


def brute(rows, target, buckets, longest, least, percent, seed):
    def features(text):
        words = re.findall(r"[0-9a-z\x80-\U0010FFFF]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(words) - n + 1)]

    found = [(i, *features(t)) for i, t in rows]
    s, t = Counter(b for *_, f in found for b in f), Counter(b for x in target for b in features(x)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    out = []
    for i, n, f in found:
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    enough = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[4], x[0] is None, x[0] or 0, x[2]))
    drawn = {id(x): k + 1 for k, x in enumerate(enough[: percent * len(enough) // 100])}
    return [(i, f, w, sc, drawn.get(id(x))) for x in out for i, n, f, w, sc in [x]]


def rows_of(df):
    return sorted(map(tuple, df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


@pytest.mark.parametrize("longest", [1, 3])
def test_like_brute_force(spark, odd, longest):
    some = [(i, t) for i, t in odd.select("doc_id", "text").collect()] + [(100 + k, " ".join(f"w{(k * j) % 17} Ä{k}" for j in range(k % 30))) for k in range(80)]
    docs = spark.createDataFrame(some, "doc_id long, text string")
    target = ["w1 w2 w3 long text", None, "", "w4 ä7"]
    got = im.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), percent=35, least_words=5, buckets=97, longest=longest)
    assert rows_of(got) == sorted(brute(some, target, 97, longest, 5, 35, "2024"), key=repr)


def test_slices_of_a_long_text(monkeypatch):
    """Words and runs that reach over the ends of slices count once."""
    text = ("Aa bB-cc é " * 500).encode()
    whole = im._features(text, im._Buckets(101), 3)
    monkeypatch.setattr(im, "SLICE", 7)
    cut = im._features(text, im._Buckets(101), 3)
    assert whole[2:] == cut[2:] == (2000, 2000 + 1999 + 1998)
    assert np.array_equal(whole[0], cut[0]) and np.array_equal(whole[1], cut[1])


def test_matrix_is_sparse_rows(spark):
    m = im.count_matrix(spark.createDataFrame([(1, "a a b"), (2, None), (3, "b")], "doc_id long, text string").coalesce(1), buckets=1000).first()
    a, b = zlib.crc32(b"a") % 1000, zlib.crc32(b"b") % 1000
    assert (m.ids, m.words, m.pointers) == ([1, 2, 3], [3, 0, 1], [0, 2, 2, 3])
    assert np.frombuffer(m.indices, "<u4").tolist() == [*sorted([a, b]), b] and sorted(np.frombuffer(m.counts, "<i8").tolist()) == [1, 1, 2]


def test_ties_and_empty(spark, odd, nothing):
    target = spark.createDataFrame([("long text",)], "text string")
    assert im.resample(nothing, target).count() == 0
    assert im.resample(odd, target.where("1 = 0"), least_words=1, percent=100).where("rank is not null").count() == odd.where("regexp_like(text, '[0-9a-zA-Z]')").count()
    hot = spark.createDataFrame([(7, "same words of one id " * 9)] * 300 + [(k, "own words here " * 9) for k in range(100)], "doc_id long, text string")
    drawn = im.resample(hot, target, percent=50).where("rank is not null")
    assert sorted(r.rank for r in drawn.collect()) == list(range(1, 201))


def test_whole_table_like_sql(spark):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.01/{t}.parquet'")
    cols = "doc_id, n_features, weight, score, rank"
    assert rows_of(im.op11_importance(spark, "/root/testdata/sf0.01")) == sorted(c.sql(im.ORACLE).project(cols).fetchall(), key=repr)
