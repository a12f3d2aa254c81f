import hashlib
import re
import struct
from statistics import mean

import numpy as np
import xxhash

from attesta.llm import fingerprints as fp


def shingles(t):
    w = re.findall(r"[^ \t-\r]+", t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_edited_texts_and_likeness(docs, texts):
    for per_range in (4_000, 7):
        rows = {r.doc_id: r for r in fp.fingerprints_with_next(docs, rows_per_range=per_range).collect()}
        ids, off = sorted(texts), []
        assert len(rows) == len(ids)
        for k, i in enumerate(ids):
            t, after, r = texts[i], texts[ids[(k + 1) % len(ids)]], rows[i]
            edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
            assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
            off += [r.near_edited - jaccard(t, edited), r.near_next - jaccard(t, after)]
        assert abs(mean(off)) < 0.01 and mean(map(abs, off)) < 0.04 and max(map(abs, off)) < 0.2


def test_equal_texts(docs, texts):
    got = {r.doc_id: r.fingerprint for r in fp.fingerprint(docs).collect()}
    by_text = {}
    for i, t in texts.items():
        assert by_text.setdefault(t, got[i]) == got[i]
    assert all(len(f) == 2 * fp.BINS for f in got.values())


def test_odd_rows(odd, nothing, spark):
    rows = fp.fingerprints_with_next(odd, rows_per_range=2).collect()
    assert len(rows) == odd.count() and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert {r.fingerprint for r in rows if r.doc_id in (2, 3, 4)} == {""}
    assert len({r.fingerprint for r in rows if r.doc_id in (1, 5)}) == 1
    assert fp.fingerprints_with_next(nothing).count() == 0
    one = fp.fingerprints_with_next(spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")).first()
    assert one.near_next == 1.0 and one.n_chars == 11
    spread = spark.createDataFrame([(-(2**62), "a b"), (2**62, "c d"), (None, "e f")], "doc_id long, text string")
    assert {r.doc_id: r.near_next for r in fp.fingerprints_with_next(spread).collect()} == {None: 0.0, -(2**62): 0.0, 2**62: 0.0}


def plain_fingerprint(text):
    """The bits of a fingerprint, from the definition: bins by the high bits of chained 64-bit hashes, empty ones borrowed."""
    def chained(*values, seed=42):
        for v in values:
            data = v if isinstance(v, bytes) else struct.pack("<i" if isinstance(v, np.int32) else "<q", int(v))
            seed = xxhash.xxh64_intdigest(data, seed=seed)
        return seed - 2**64 if seed >= 2**63 else seed

    words = [chained(w.encode()) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    shingles = [chained(*words[k : k + 5]) for k in range(len(words) - 4)] if len(words) >= 5 else [chained(*words)] if words else []
    of = lambda x: (x % 2**64) >> (64 - fp.BIN_BITS)
    least = {}
    for x in shingles:
        least[of(x)] = min(x, least.get(of(x), x))
    if not least:
        return ""
    at = lambda i: least[i] if i in least else min((chained(b, np.int32(i)), x) for b, x in least.items())[1]
    return "".join(f"{at(i) & 255:02x}" for i in range(fp.BINS))


def test_bits_like_brute_force(spark, odd):
    rows = [r for r in odd.select("doc_id", "text").collect()]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.fingerprint) for r in fp.fingerprint(odd).collect())
    assert got == sorted((r.doc_id is None, r.doc_id or 0, plain_fingerprint(r.text)) for r in rows)


def test_ranges_beyond_the_broadcast(spark, odd, monkeypatch):
    rows = lambda: sorted(map(repr, fp.fingerprints_with_next(odd, rows_per_range=2).collect()))
    want = rows()
    monkeypatch.setattr(fp, "BROADCAST_ROWS", 0)
    assert rows() == want
