import numpy as np
import pytest

from attesta.llm import toxicity as tox

DIR = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    """Fitted on even ids, judged on odd ones: what it rejects is toxic, and most toxic texts with known words are found."""
    docs, labels = spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")
    model = tox.fit_toxicity(docs, labels.where("doc_id % 2 = 0"))
    held = docs.join(labels.where("doc_id % 2 = 1"), "doc_id").select("doc_id", "text", "lang", "toxic")
    rows = tox.score_toxicity(held, model).select("row.*", "p_toxic", "severity", "grade").collect()
    said = [r for r in rows if r.p_toxic >= tox.REJECT_FROM]
    assert sum(r.toxic for r in said) >= 0.95 * len(said)
    assert len(said) >= 0.6 * sum(r.toxic for r in rows if r.lang == "en")
    assert all(0 <= r.severity <= tox.GRADES - 1 and 0 <= r.grade < tox.GRADES for r in rows)


def test_ordinal_model():
    """Scores from a known model are put in order, and so are the thresholds."""
    r = np.random.default_rng(5)
    n = 3000
    x = r.normal(size=(n, 2))
    latent = x @ [2.0, -1.0] + r.logistic(size=n)
    grades = (latent > 0).astype(int) + (latent > 2)
    rows, cols = np.repeat(np.arange(n), 2), np.tile([0, 1], n)
    w, theta = tox.fit_ordinal(x.ravel(), rows, cols, grades, 2)
    assert np.allclose(w, [2, -1], atol=0.3) and np.allclose(theta, [0, 2], atol=0.3)


def test_no_labels(spark, odd, nothing):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = tox.fit_toxicity(odd, labels)
    assert model[0] == {}
    assert tox.fit_toxicity(odd, spark.createDataFrame([(1, 1, 0), (None, 1, 1), (5, None, None)], labels.schema))[0] == {}
    assert tox.score_toxicity(odd, model).count() == odd.count()
    kept = tox.drop_toxic(odd, labels)
    assert kept.dtypes == odd.dtypes and kept.count() == odd.count()
    assert tox.drop_toxic(nothing, labels).count() == 0


def test_clean_texts_stay(spark):
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(80)], "doc_id long, quality int, toxic int")
    rows = [(i, f"plain words number {i} " + ("you awful thing " * (1 + i % 3) if i % 4 == 0 else "and so on")) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in tox.drop_toxic(docs, labels).collect()} == {i for i in range(120) if i % 4}


def test_one_word_is_enough(spark):
    """Toxic held-out texts with one distinct insult word are rejected in every language, once or repeated; clean ones stay."""
    r = np.random.default_rng(3)
    insults = [f"insult{k}" for k in range(10)]
    filler = {lang: [f"{lang}{k}" for k in range(60)] for lang in ("en", "de", "fr", "es")}
    rows, labels, single = [], [], {}
    for i in range(2400):
        lang = list(filler)[i % 4]
        words, toxic = list(r.choice(filler[lang], 40)), int(i % 9 == 0)
        if toxic:
            # as in the tables: few toxic texts have one insult word, most have several
            kinds = 1 if r.random() < 0.03 or i >= 2000 else int(r.integers(2, 7))
            chosen = list(r.choice(insults, kinds, replace=False))
            words += chosen * (1 if i % 2 else 8)
            if kinds == 1:
                single[i] = lang
        elif r.random() < 0.05:
            # a word that goes with toxic texts, but is in clean ones too
            words.append("doubtful")
        if toxic and r.random() < 0.3:
            words.append("doubtful")
        rows.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    given = spark.createDataFrame(labels[:2000], "doc_id long, quality int, toxic int")
    model = tox.fit_toxicity(docs, given)
    said = {x.doc_id for x in tox.score_toxicity(docs, model).where(f"p_toxic >= {tox.REJECT_FROM}").select("row.doc_id").collect()}
    held = {i for i in single if i >= 2000}
    assert {single[i] for i in held} == set(filler) and held <= said
    assert not [i for i, _, toxic in labels if i in said and not toxic]


def test_sample_bound_counts_documents(spark):
    """A labelled id that many rows have: no more documents than the bound are fitted, and repeated ones count once."""
    from attesta.llm import toxicity

    fitted = []
    real = toxicity.fit_words
    rows = [(7, f"own words w{k} x{k % 5}") for k in range(2000)] + [(8, "the same bad text")] * 500 + [(k, f"plain text {k % 7}") for k in range(20, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(7, 0), (8, 1), *((k, k % 2) for k in range(20, 60))], "doc_id long, toxic int")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(toxicity, "LEAST_CHI2", 0.0)
        m.setattr(toxicity, "LEAST_DOCS", 1)
        m.setattr(toxicity, "fit_words", lambda hits, toxic, n: fitted.append(len(toxic)) or real(hits, toxic, n))
        toxicity.fit_toxicity(docs, labels, sample_rows=100)
        assert max(fitted) == 100
        fitted.clear()
        toxicity.fit_toxicity(docs.where("doc_id <> 7"), labels, sample_rows=100)
        assert max(fitted) == 41


def test_many_documents_of_one_id(spark):
    """An id with most of the documents doesn't crowd out the toxic ones, whichever way hashes fall."""
    for own in range(3):
        rows = [(own, f"clean words number {k}") for k in range(3000)] + [(k, f"such {'awful' if k % 2 else 'pleasant'} text {k}") for k in range(20, 60)]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        labels = spark.createDataFrame([(own, 0), *((k, k % 2) for k in range(20, 60))], "doc_id long, toxic int")
        model = tox.fit_toxicity(docs, labels, sample_rows=100)
        assert set(model[0]) >= {"awful"}
        assert {r.doc_id for r in tox.drop_toxic(docs, labels).select("doc_id").collect()} == {own, *range(20, 60, 2)}


def test_severity_like_brute_force(spark, odd):
    """The expected grade from the weights of words at their levels and the thresholds, in plain Python."""
    from collections import Counter

    model = {"one": (0.4, 0.9, 1.1), "text": (0.7, 1.5, 3.0), "word": (-0.3, -0.4, -0.5)}, [0.5, 2.0]
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    got = sorted((r.row.doc_id is None, r.row.doc_id or 0, round(r.severity, 9), r.grade, round(r.p_toxic, 9)) for r in tox.score_toxicity(odd, model).collect())
    want = []
    for i, t in rows:
        found = Counter(tox.words_of(t or ""))
        score = sum(w[sum(found[x] >= k for k in tox.LEVELS) - 1] for x, w in model[0].items() if found[x])
        above = [1 / (1 + np.exp(c - score)) for c in model[1]]
        want.append((i is None, i or 0, round(sum(above), 9), sum(a >= 0.5 for a in above), round(above[0], 9)))
    assert got == sorted(want)
