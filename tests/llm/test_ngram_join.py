import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from attesta.llm import ngram_join as nj
from attesta.llm.components import components


def shingles(text):
    w = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    """doc_id -> (shingles, smallest id reachable) by all pairs."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = defaultdict(list)
    for i in sorted(sets):
        for j, n in Counter(j for s in sets[i] for j in where[s]).items():
            if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                root[b] = a
        for s in sets[i]:
            where[s].append(i)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def joined(df, **options):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in nj.ngram_join(df, **options).collect()}


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_against_all_pairs(docs, texts):
    assert joined(docs) == brute(texts.items())


@pytest.mark.parametrize(("rounds", "short"), [(1, 16), (3, 16), (1, 1), (1, 10**9)])
def test_chains_of_edits(spark, monkeypatch, rounds, short):
    """Near copies with few and many edits around the threshold, copies of them, and a passage that all share."""
    monkeypatch.setattr(nj, "SHORT", short)
    r = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    passage = [f"p{i}" for i in range(30)]
    rows = []
    for base in range(6):
        text = r.choices(words, k=120)
        for _ in range(25):
            copy = list(text)
            for _ in range(r.choice([0, 1, 1, 2, 3, 4, 5, 8, 12])):
                copy[r.randrange(120)] = r.choice(words)
            if r.random() < 0.3:
                copy = passage + copy
            rows.append((len(rows), " ".join(copy)))
    rows += [(len(rows) + k, rows[k][1].upper()) for k in range(0, 40, 3)]
    rows += [(900 + k, " ".join(passage + r.choices(words, k=40))) for k in range(40)]
    assert joined(frame(spark, rows), rounds=rounds) == brute(rows)


def test_short_texts_and_ties(spark):
    rows = [(9, "A b"), (3, "a  B"), (4, "a b c"), (5, None), (6, ""), (7, " \n"), (8, "a b c d e"), (2, "a b c d e f")]
    assert joined(frame(spark, rows)) == {9: (1, 3), 3: (1, 3), 4: (1, 4), 5: (0, 5), 6: (0, 6), 7: (0, 7), 8: (1, 8), 2: (2, 2)}


def test_odd_rows(odd, nothing):
    got = nj.ngram_join(odd).collect()
    assert len(got) == odd.count()
    assert {r.component_id for r in got if r.doc_id in (1, 5)} == {1}
    assert {r.n_shingles for r in got if r.doc_id in (2, 3, 4)} == {0}
    assert nj.ngram_join(nothing).count() == 0
    kept = nj.keep_one_each(odd)
    assert kept.dtypes == odd.dtypes
    assert sorted((r.doc_id for r in kept.collect() if r.doc_id is not None)) == [1, 2, 3, 4, 7, 8, 9, 10]
    assert nj.keep_one_each(nothing).count() == 0


def test_unbounded_ways(spark, docs, texts, monkeypatch):
    """With nothing broadcast and all lists long, the result is the same."""
    monkeypatch.setattr(nj, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(nj, "SHORT", 1)
    assert joined(docs) == brute(texts.items())


def test_differences_share_prefixes():
    """Any two linked sets that aren't both linked with the hub have a shared key in both prefixes."""
    r = np.random.default_rng(1)
    base = r.integers(0, 2**64, 90, dtype=np.uint64)
    seen = 0
    for _ in range(3000):
        odd = np.unique(np.concatenate([base[r.random(90) < 0.85], r.integers(0, 2**64, r.integers(0, 12), dtype=np.uint64)]))
        x, y = (np.unique(np.concatenate([odd[r.random(len(odd)) < 0.97], r.integers(0, 2**64, r.integers(0, 9), dtype=np.uint64)])) for _ in "xy")
        (m, a, i, p), (n, b, k, q) = (nj.difference(np.sort(base), s, nj.NONE_COMMON) for s in (x, y))
        assert a == nj.similar(x, np.sort(base))
        if nj.similar(x, y) and not (a and b):
            seen += 1
            # the short prefix of the smaller difference, the long one of the larger; either where they are as large
            assert m > n or set(p[:i].tolist()) & set(q.tolist())
            assert n > m or set(p.tolist()) & set(q[:k].tolist())
    assert seen > 100


@pytest.mark.parametrize("pages", [300, 900])
def test_pages_round_a_frame_give_no_pairs(spark, monkeypatch, pages):
    """80 words that all pages have and 15 of their own: no links, and no candidates that grow with the square of the pages."""
    frame_words = [f"frame{k}" for k in range(80)]
    rows = [(i, " ".join([*frame_words[:40], *(f"own{i}x{k}" for k in range(15)), *frame_words[40:]])) for i in range(pages)]
    found = []
    real = nj.apart_from_hubs
    monkeypatch.setattr(nj, "apart_from_hubs", lambda *a: found.append(nj.written(real(*a), "counted_pairs")) or found[-1])
    assert joined(frame(spark, rows)) == {i: (91, i) for i in range(pages)}
    assert all(f.count() <= pages for f in found)


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(50, 40), (40, 60), (60, 50), (7, 7), (90, 91), (91, 90)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(31), 0), 40: 40, 50: 40, 60: 40, 90: 90, 91: 90}


def test_one_of_each_by_row(spark):
    """Rows of one id, or without ids, go or stay by their own components."""
    words = [f"w{k}" for k in range(300)]
    a, b, c, d = (" ".join(words[k : k + 60]) for k in (0, 70, 140, 210))
    near = lambda t: t.replace(" ", "  ", 1) + " end"
    rows = [(1, a), (None, near(a)), (None, b), (None, None), (None, ""), (5, near(a)), (5, c), (None, d), (None, near(d)), (7, near(c) + " x")]
    kept = nj.keep_one_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = [tuple(r) for r in kept if r.text not in (d, near(d))]
    assert sorted(got, key=str) == sorted([(1, a), (None, b), (None, None), (None, ""), (5, c)], key=str)
    assert len(kept) == len(got) + 1


def test_against_all_pairs_of_more(spark):
    """All of sf0.01, by the query."""
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in nj.op1_ngram_join(spark, folder).collect()} == brute(rows)
