import hashlib
import math
import random
import re

import pytest

from attesta.llm import privacy as pv

#: The contract's patterns.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(x if k % 2 == 0 else 2 * x - 9 * (x > 4) for k, x in enumerate(map(int, reversed(digits)))) % 10 == 0


def holds(kind, v):
    d = re.sub("[^0-9]", "", v)
    if kind == "ip":
        return all(int(x) <= 255 for x in v.split("."))
    return True if kind == "email" else 13 <= len(d) <= 19 and luhn(d) if kind == "card" else 9 <= len(d) <= 15


def base(text):
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text or "") if holds(k, m[0])]


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def check_base(spark, texts):
    rows = pv.personal_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = {r.doc_id: [tuple(s) for s in r.base] for r in rows}
    for i, t in enumerate(texts):
        assert got[i] == base(t), t and t[:200]


ODD = [
    "mail a.b+c@x.example.com, a@b.c_d@e.f and a@b. a@b..c 12@34.56.78@9.x é😀 z@y.w",
    "ip 1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 001.02.3.0255 0000000000000000000000001.1.1.1 999999999999999999999.1.1.1 1.2.3",
    "card 4111 1111 1111 1111 4111-1111-1111-1112 4111  1111 1111 1111, 41111111111111114111111111111111 378282246310005",
    "phone +49 (0)30 1234567, +1-202-555-0143 +12 +123456789012345678 +1 2 3 4 5 6 7 8 9 ( + +1.....9",
    "+49 4111 1111 1111 1111 me@1.2.3.4 user@10.0.0.1.example.org",
    None,
    "",
    " \n\t",
]


def test_base_spans_of_odd_texts(spark):
    check_base(spark, ODD)


def test_base_spans_of_random_texts(spark):
    r = random.Random(5)
    check_base(spark, ["".join(r.choice("1 2.3-4+@a_%()5é") for _ in range(r.randrange(120))) for _ in range(1500)])


def test_many_and_long_matches(spark):
    """Hundreds of spans in one text, and runs over which a plain pattern is slow or deep."""
    texts = ["é a@b.c 10.0.0.1 " * 700, "x" * 200_000 + " a@b.cd", "1" * 100_000 + " 1.2.3.4", "a@a" + ".b" * 50_000, "1 " * 60_000 + "+1" + "(" * 50_000]
    rows = pv.personal_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = {r.doc_id: [tuple(s) for s in r.base] for r in rows}
    assert got[0] == base(texts[0]) and len(got[0]) == 1400
    assert [got[k] for k in (1, 2, 3, 4)] == [[("email", 200_001, 200_007)], [("ip", 100_001, 100_008)], [("email", 0, 100_003)], []]


def words_of(text):
    return [w.lower() for w in re.findall(r"\w+", text)]


def brute_terms(texts, support, generalise):
    """Disclosure of each term, from the definition, for texts whose only personal data are emails."""
    distinct, near, count = sorted({t or "" for t in texts}), {}, {}
    for t in distinct:
        for w in set(words_of(re.sub(PLAIN["email"], " ", t))) | set(words_of(t)):
            count.setdefault(w, set()).add(t)
        for m in re.finditer(PLAIN["email"], t):
            gaps = re.split(PLAIN["email"].replace("(", "(?:"), t)
            k = len(re.findall(PLAIN["email"].replace("(", "(?:"), t[: m.start()]))
            around = [*words_of(gaps[k])[-pv.WINDOW :], *words_of(gaps[k + 1])[: pv.WINDOW]]
            for w in around:
                near.setdefault((m[0].lower(), w), []).append((t, tuple(around)))
    n, out = len(distinct), {}
    for (e, w), seen in near.items():
        both, own = len({t for t, _ in seen}), len({t for t in distinct if e in t.lower()})
        if len({a for _, a in seen}) < support or own >= n:
            continue
        share = 1 - math.log(min(1, both / len(count[w]))) / math.log(own / n)
        if share >= generalise:
            out[w] = max(out.get(w, 0), share)
    return out


@pytest.fixture(scope="module")
def planted():
    """Notes in which the name Zorblax stands by one address, in different contexts; and many others."""
    r = random.Random(9)
    plain = [f"w{k}" for k in range(60)]
    some = lambda k: " ".join(r.choice(plain) for _ in range(k))
    texts = [some(40) for _ in range(150)]
    texts += [f"{some(9)} Zorblax zed@corp.example wrote {some(12)}" for _ in range(6)]
    texts += [f"{some(9)} other{k}@corp.example wrote {some(12)}" for k in range(10)]
    texts += ["here is one long and well known passage by Quuxname kay@corp.example that is copied whole into some texts of ours so it is one context"] * 5
    texts += [some(5) + " here is one long and well known passage by Quuxname kay@corp.example that is copied whole into some texts of ours so it is one context" for _ in range(4)]
    return [*texts, "Zorblax alone, without the address", None, ""]


def test_terms_like_brute_force(spark, planted):
    docs = spark.createDataFrame(list(enumerate(planted)), "doc_id long, text string").repartition(3)
    want = brute_terms(planted, pv.SUPPORT, 0.9)
    assert set(want) == {"zorblax"}
    for r in pv.personal_spans(docs).collect():
        text = planted[r.doc_id] or ""
        assert [(s.start, s.end) for s in r.terms] == [m.span() for m in re.finditer(r"\w+", text) if m[0].lower() in want]
    low = brute_terms(planted, 2, 0.3)
    assert len(low) > 1
    for r in pv.personal_spans(docs, support=2, generalise=0.3).collect():
        text = planted[r.doc_id] or ""
        covered = lambda m: any(a < m.end() and m.start() < b for _, a, b in base(text))  # noqa: B023, E731
        assert [(s.start, s.end) for s in r.terms] == [m.span() for m in re.finditer(r"\w+", text) if m[0].lower() in low and not covered(m)]


def test_joins_beyond_the_broadcast(spark, planted, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(planted)), "doc_id long, text string")
    rows = lambda: sorted(map(repr, pv.personal_spans(docs).select("doc_id", "base", "terms").collect()))
    want = rows()
    monkeypatch.setattr(pv, "small", lambda df: df)
    assert rows() == want


def test_sanitised_texts(spark, planted):
    docs = spark.createDataFrame([(k, t, "kept") for k, t in enumerate(planted)] + [(900, "call +4222222222222 now", "x")], "doc_id long, text string, `a.b` string")
    out = {r.doc_id: r for r in pv.sanitise(docs).collect()}
    assert len(out) == docs.count() and pv.sanitise(docs).columns == docs.columns
    assert "zed@corp" not in out[150].text and "Zorblax" not in out[150].text and "[email] wrote" in out[150].text
    assert [k for k, *_ in base("call +4222222222222 now")] == ["card", "phone"] and out[900].text == "call [phone] now"
    assert out[0].text == planted[0] and out[len(planted) - 2].text is None and out[0]["a.b"] == "kept"


def test_odd_rows(spark, odd, nothing):
    assert pv.personal_spans(nothing).count() == 0 and pv.sanitise(nothing).count() == 0
    assert pv.personal_spans(odd).count() == odd.count()
    out = pv.sanitise(odd)
    assert out.dtypes == odd.dtypes and sorted(map(repr, out.collect())) == sorted(map(repr, odd.collect()))


def test_query(spark, texts):
    rows = pv.op12_personal_data(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(joined(want).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for x, *_ in want) for k in pv.KINDS)
        assert r.spans.startswith(joined(want))
