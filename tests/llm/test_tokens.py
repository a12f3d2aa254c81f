import math
import random
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from attesta.llm import packing, sharding, token_counts

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t'sldtrevm<|endoftext|>aéß12.,")), max_size=60))
def test_ids_as_the_tokenizer_gives(text):
    assert packing.ids_of("byte_bpe_50k")(text) == np.array(TOKENIZER.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_best_fit():
    r = random.Random(1)
    for top in (100, 60, 30):
        sizes = [r.randint(1, top) for _ in range(500)]
        bins = packing.best_fit(sizes, 100)
        assert sorted(i for b in bins for i in b) == list(range(500))
        assert all(sum(sizes[i] for i in b) <= 100 for b in bins)
        assert len(bins) <= 1.25 * math.ceil(sum(sizes) / 100) + 1
    assert packing.best_fit([], 10) == []


def check_packing(rows, texts):
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append(r)
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    for i, t in texts.items():
        ids = np.array([*TOKENIZER.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces))) and len(pieces) == -(-len(ids) // packing.CAPACITY)
        at = 0
        for r in pieces:
            assert (r.start, r.ids_crc32) == (at, zlib.crc32(ids[at : at + r.length].tobytes()))
            assert r.length == packing.CAPACITY or r.piece == 0
            at += r.length
        assert at == len(ids)
    return len(by_sequence)


def test_packing(docs, texts):
    rows = packing.pack_documents(docs).collect()
    n = check_packing(rows, texts)
    assert n <= math.ceil(sum(r.length for r in rows) / packing.CAPACITY) * 1.02 + 1


def test_packing_tree(docs, texts):
    """Many tasks, and levels of several."""
    rows = packing.pack_documents(docs, fan_in=3, pieces=20, hosts=4).collect()
    n = check_packing(rows, texts)
    assert n <= math.ceil(sum(r.length for r in rows) / packing.CAPACITY) * 1.05 + 1


def test_packing_of_clustered_lengths(spark):
    """Long and short documents that lie in different files meet."""
    rows = [(i, "a " * (1098 if i < 200 else 898)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(8, "doc_id")
    got = packing.pack_documents(df, pieces=100).collect()
    lengths = {r.length for r in got}
    assert lengths == {1100, 900} and check_packing(got, dict(rows)) <= 220  # apart they take 300


def test_packing_odd_rows(odd, nothing):
    rows = packing.pack_documents(odd).collect()
    assert sum(r.doc_id == 5 for r in rows) == 6 and sum(r.doc_id in (2, 3) for r in rows) == 2
    assert sum(r.doc_id is None for r in rows) == 1
    assert packing.pack_documents(nothing).count() == 0


def plain_count(model, word):
    """Viterbi without sharing."""
    token = token_counts.MARK + word
    best = [(0.0, 0)]
    for end in range(1, len(token) + 1):
        found = (-math.inf, 0)
        for begin in reversed(range(end)):
            s = model.scores.get(token[begin:end])
            if s is not None and best[begin][0] + s >= found[0]:
                found = (best[begin][0] + s, best[begin][1] + 1)
        if found[0] == -math.inf:
            n = len(token[end - 1].encode())
            found = (best[end - 1][0] + n * model.byte_score, best[end - 1][1] + n + (n << token_counts.BYTES_FROM))
        best.append(found)
    return best[-1][1]


def test_counts_against_plain_viterbi(docs, texts):
    model = token_counts.model_of(token_counts.VOCABULARY)
    for r in token_counts.count_tokens(docs).collect():
        words = texts[r.doc_id].split()
        total = sum(plain_count(model, w) for w in words)
        assert (r.n_pretokens, r.n_tokens, r.n_byte_tokens) == (len(words), total & ((1 << 40) - 1), total >> 40)


def test_shared_prefixes_are_computed_once():
    model = token_counts.Unigram({"▁": -1.0, "a": -1.0, "ab": -1.5, "b": -2.0})
    calls = []
    node = model.node
    model.node = lambda path, token, end: calls.append(token[:end]) or node(path, token, end)
    model.count(["abab", "abba", "aba", "abab"])
    assert len(calls) == len(set(calls))
    assert model.counts == {w: plain_count(model, w) for w in ("abab", "abba", "aba")}


def test_counts_of_odd_rows(odd, nothing):
    rows = token_counts.count_tokens(odd).collect()
    assert len(rows) == odd.count() and {r.n_tokens for r in rows if r.doc_id in (2, 3, 4)} == {0}
    rare = odd.sparkSession.createDataFrame([(1, "a\ue000b")], "doc_id long, text string")
    assert token_counts.count_tokens(rare).first().n_byte_tokens == 3
    assert token_counts.count_tokens(nothing).count() == 0


def test_shards(docs, texts):
    rows = sharding.shard_documents(docs).collect()
    for r in rows:
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(data) + 1, zlib.crc32(data))
    shards = {}
    for r in rows:
        shards.setdefault(r.shard, []).append(r)
    assert sorted(shards) == list(range(16))
    sizes = [sum(r.size for r in s) for s in shards.values()]
    assert max(sizes) - min(sizes) <= max(r.size for r in rows)
    assert all(sorted(r.slot for r in s) == list(range(len(s))) for s in shards.values())


def test_large_groups_are_split(spark):
    r = random.Random(2)
    rows = [(i, "the same text " * 5 if i % 3 == 0 else " ".join(f"{r.random()}" for _ in range(r.randint(1, 9)))) for i in range(4000)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), rows_per_range=40).groupBy("shard").agg({"size": "sum", "slot": "max", "*": "count"}).collect()
    sizes = [x["sum(size)"] for x in got]
    assert len(sizes) == 16 and max(sizes) <= 1.02 * min(sizes)
    assert all(x["max(slot)"] + 1 == x["count(1)"] for x in got)


def test_small_groups_stay_together(spark):
    rows = [(i, f"text of group {i // 3}") for i in range(6000)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    home = {}
    assert all(home.setdefault(r.doc_id // 3, r.shard) == r.shard for r in got)


def test_shards_of_odd_rows(odd, nothing):
    assert sharding.shard_documents(odd).count() == odd.count()
    assert sharding.shard_documents(nothing).count() == 0
