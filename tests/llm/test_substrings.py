import hashlib
import random
from collections import Counter

import pytest

from attesta.llm import substrings as ss


def brute(texts, length=ss.LENGTH):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, y in zip(b, gone, strict=True) if not y)
        out.append((len(b), len(b) - len(kept), sum(y and (not k or not gone[k - 1]) for k, y in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return out


def removed(df, **options):
    return sorted(tuple(r)[1:] for r in ss.remove_repeats(df, **options).collect())


def passages():
    r = random.Random(11)
    letters = "abcdefgh é"
    make = lambda n: "".join(r.choices(letters, k=n))
    shared = [make(n) for n in (399, 400, 401, 650, 1300)]
    texts = [make(r.randint(0, 900)) + r.choice(shared)[r.randint(0, 40) :] + make(r.randint(0, 500)) + r.choice(shared) for _ in range(40)]
    near = list(make(2500))
    for _ in range(25):
        near[r.randrange(2500)] = "#"
        texts.append("".join(near))
    return [*texts, texts[0], texts[0], "z" * 399, "z" * 1000, "ab" * 700, None, "", shared[0], shared[1], shared[1]]


@pytest.mark.parametrize("side_by_side", [ss.SIDE_BY_SIDE, 7, 1])
def test_against_all_strings(spark, side_by_side, monkeypatch):
    monkeypatch.setattr(ss, "PART", 700)
    ss._powers.clear()
    texts = passages()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert removed(df, side_by_side=side_by_side) == sorted(brute(texts))
    ss._powers.clear()


@pytest.mark.parametrize("length", [359, 395, 430, 900])
def test_one_passage_of_many(spark, length, monkeypatch):
    """A passage that all texts share is split in time: rows grow with the texts, not with their strings."""
    r = random.Random(length)
    letters = "abcdefghij klmnop"
    passage = "".join(r.choices(letters, k=length))
    texts = ["".join(r.choices(letters, k=300)) + passage + "".join(r.choices(letters, k=300)) for _ in range(120)]
    made, plain = {}, ss.written

    def counting(df, name):
        out = plain(df, name)
        if name in ("halves", "hot", "left"):
            made[name] = made.get(name, 0) + out.count()
        if name == "left":
            groups = out.where("n <= 20").groupBy("key").count().agg({"count": "max"}).first()[0]
            assert groups is None or groups <= 20
        return out

    monkeypatch.setattr(ss, "written", counting)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert removed(df, side_by_side=20) == sorted(brute(texts))
    # strings of 120 texts around one trigger: 24,000
    assert made["hot"] >= 120 and made["halves"] <= 120 * 40


def test_documents(docs, texts, monkeypatch):
    want = sorted(brute(texts.values()))
    assert removed(docs) == want
    monkeypatch.setattr(ss, "BROADCAST_ROWS", -1)
    assert removed(docs) == want


def test_odd_rows(odd, nothing):
    assert removed(odd) == sorted(brute([r.text for r in odd.select("text").collect()]))
    assert ss.remove_repeats(nothing).count() == 0
