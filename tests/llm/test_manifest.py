import hashlib
import zlib

import pytest

from attesta.llm import manifest as mf


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enc(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def tree_of(digests):
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def steps(levels, p):
    for level in levels[:-1]:
        first = p - p % 8
        yield level[first:p], level[p + 1 : first + 8]
        p //= 8


def brute(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    lower = lambda t: t if t is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    langs = {}
    for r in rows:
        leaf = h(*map(enc, r))
        hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
        langs.setdefault((r[2] is not None, (r[2] or "").encode()), []).append((r[0] is not None, r[0] or 0, leaf, h(*map(enc, (*r[:4], lower(r[4])))) if hit else leaf))
    names = sorted(langs)
    trees = {n: tree_of([x[2] for x in sorted(langs[n])]) for n in names}
    top = tree_of([trees[n][-1][0] for n in names])
    root, out = top[-1][0], []
    for k, n in enumerate(names):
        for p, (some, i, leaf, node) in enumerate(sorted(langs[n])):
            path = [*steps(trees[n], p), *steps(top, k)]
            for left, right in path:
                node = h(*left, node, *right)
            out.append((i if some else None, leaf, trees[n][-1][0], root, h(*(x for a, b in path for x in (*a, *b))), node, node == root))
    return out


def check(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, tree string")
    got = mf.audit(df, **options).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(brute(rows), key=repr)


@pytest.mark.parametrize("n", [1, 2, 8, 9, 65, 700])
def test_like_brute_force(spark, n):
    """Trees of one to four levels in blocks of two, so that up to two passes build and prove."""
    check(spark, [(k * 7 % 1000, f"s{k % 3}", "en", k, f"Text {k}") for k in range(n)], depth=2, rows_per_range=100)


def test_many_languages_and_odd_rows(spark):
    """More trees than a node takes, nulls in every column, repeated rows and ids, and an empty language."""
    rows = [(k, None if k % 5 == 0 else "a", f"l{k % 11}" if k % 4 else None, None if k % 7 == 0 else k, [None, "", "É Ab", "x" * 5000][k % 4]) for k in range(200)]
    rows += [(3, "a", "", 1, "AbC")] * 40 + [(None, None, None, None, None)] * 10 + [(None, "a", "l1", 2, "Ab")]
    check(spark, rows, depth=2, rows_per_range=30)
    check(spark, rows[:30])


def test_empty_and_extra_columns(odd, nothing):
    assert mf.audit(nothing).count() == 0
    assert mf.audit(odd).count() == odd.count()


def test_stored_levels(spark):
    docs = spark.createDataFrame([(k, "a", "en", 1, "t") for k in range(100)], "doc_id long, source string, lang string, n_chars long, text string")
    m = mf.build_manifest(docs)
    assert [m.forest.level(k).count() for k in range(m.forest.levels)] == [100, 13, 2, 1]
    good = mf.proofs(m)
    assert good.where("not verified").count() == 0 and good.select("root").distinct().first().root == m.root
