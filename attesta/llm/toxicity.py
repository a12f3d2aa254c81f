"""Toxicity grades by cumulative-link ordinal regression on sparse words and how often they are repeated.

P(grade >= j) = sigmoid(w . x - theta_j) with one weight vector w for all ordered thresholds theta_1 < theta_2 < ...;
the expected severity is the sum of these. The labels only say toxic or not, so a toxic row's severity is taken from how
many words it has of those that go with toxic rows, repeated ones counted up to three times: 0 is not toxic, 1 is toxic
with few of them, 2 with several. Words are chosen, and the model fitted, on a bounded sample of labelled rows; every
document is scored in whole. A word's features are as large as it is surely a sign of toxic rows; with features of one
size the ridge and the grades by counts draw all weights together, and no single word reaches theta_1. It is lowered
further as far as models of one half of the rows tell toxic from clean ones in the other half.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, documents, freed, ship

#: Bound of what is fitted on: labelled rows (the lowest hashes of the id).
SAMPLE_ROWS = 20_000
#: A word of the model is in at least so many sampled documents, and its chi-squared with toxic or not is at least this
#: (1 degree of freedom; 24 is passed by one word in a million that has nothing to do with it).
LEAST_DOCS = 5
LEAST_CHI2 = 24.0
GRADES = 3
#: A word has a weight for being there, and further ones from so many occurrences on.
LEVELS = (1, 2, 5)
#: A toxic row with at least so many words of the model is of grade 2; each counts once for each of its levels.
SEVERE_WORDS = 4
RIDGE = 0.001
STEPS = 600
#: A document is rejected as toxic from this chance of grade 1 or more.
REJECT_FROM = 0.5
#: A word counts as sure a sign as its log odds less so many standard errors: one chance in 40 that it is less.
SURE_BY = 1.96
LEAST_SURE = 0.1
#: In lowering theta_1, a clean held-out row rejected weighs as much as so many toxic ones found.
FALSE_WEIGHT = 9

_WORD = re.compile(r"\w+")
_WORDS = pa.list_(pa.struct([("word", pa.string()), ("level", pa.int32())]))
#: For each word the sum of its weights by level; thresholds.
MODEL = tuple[dict[str, tuple[float, ...]], list[float]]


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def level_of(times: int) -> int:
    """The number of levels that so many occurrences reach."""
    return sum(times >= n for n in LEVELS)


def fit_ordinal(x: np.ndarray, rows: np.ndarray, cols: np.ndarray, grades: np.ndarray, n_words: int, k: int = GRADES, ridge: float = RIDGE, steps: int = STEPS):
    """(w, theta): accelerated gradient ascent on the penalized likelihood; the non-zero features are x[i] at (rows[i], cols[i]).

    Thresholds are theta_1 plus sums of exponentials, so that they stay in order.
    """
    n = len(grades)
    share = np.array([(np.sum(grades >= j) + 0.5) / (n + 1) for j in range(1, k)])
    cuts = -np.log(share / (1 - share))
    gaps = np.log(np.maximum(np.diff(cuts), 0.05))
    p = np.concatenate([np.zeros(n_words), cuts[:1], gaps])
    first, second = np.zeros_like(p), np.zeros_like(p)

    def cdf(v):
        return 1 / (1 + np.exp(-np.clip(v, -30, 30)))

    for t in range(1, steps + 1):
        w, theta = p[:n_words], np.concatenate([p[n_words : n_words + 1], p[n_words] + np.cumsum(np.exp(p[n_words + 1 :]))])
        score = np.bincount(rows, weights=x * w[cols], minlength=n)
        above = np.column_stack([np.ones(n), *(cdf(score - c) for c in theta), np.zeros(n)])
        steep = above * (1 - above)
        at = np.arange(n)
        own = np.maximum(above[at, grades] - above[at, grades + 1], 1e-12)
        by_score = (steep[at, grades] - steep[at, grades + 1]) / own
        by_theta = np.zeros(k - 1)
        for j in range(1, k):
            by_theta[j - 1] = np.sum((grades == j - 1) * steep[:, j] / own) - np.sum((grades == j) * steep[:, j] / own)
        g = np.concatenate([
            np.bincount(cols, weights=x * by_score[rows], minlength=n_words) / n - ridge * w / max(1, n_words) ** 0.5,
            [by_theta.sum() / n],
            np.exp(p[n_words + 1 :]) * np.cumsum(by_theta[::-1])[::-1][1:] / n,
        ])
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        p = p + 0.05 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    w, theta = p[:n_words], np.concatenate([p[n_words : n_words + 1], p[n_words] + np.cumsum(np.exp(p[n_words + 1 :]))])
    return w, theta


def _distinct(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in freed(batches):
        words = [[{"word": w, "level": level_of(n)} for w, n in Counter(words_of(t or "")).items()] for t in batch.column(2).to_pylist()]
        yield pa.record_batch([*batch.columns[:2], pa.array(words, _WORDS), *batch.columns[3:]], names=["row", "grade", "words", "id", "text_hash"])


def fit_words(hits: np.ndarray, toxic: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(weights by word and level, theta) from hits (place of the row, word, level) and the rows' labels."""
    bad = np.bincount(hits[:, 1], weights=toxic[hits[:, 0]], minlength=n_words)
    good = np.bincount(hits[:, 1], minlength=n_words) - bad
    # log odds of toxic with the word against without regard to words, drawn towards 0 by what chance can make of few rows
    odds = np.log((bad + 0.5) / (good + 0.5)) - np.log(toxic.sum() / (len(toxic) - toxic.sum()))
    sure = np.sign(odds) * np.maximum(np.abs(odds) - SURE_BY * np.sqrt(1 / (bad + 0.5) + 1 / (good + 0.5)), LEAST_SURE)
    rows, words, levels = (np.repeat(x, hits[:, 2]) for x in hits.T)
    at = np.arange(len(rows)) - np.repeat(np.cumsum(hits[:, 2]) - hits[:, 2], hits[:, 2])
    severity = np.bincount(rows, weights=(np.maximum(sure, 0) / max(sure.max(), 1e-9))[words], minlength=len(toxic))
    grade = toxic * (1 + (severity >= SEVERE_WORDS))
    w, theta = fit_ordinal(sure[words], rows, words * len(LEVELS) + at, grade, n_words * len(LEVELS))
    return w.reshape(n_words, len(LEVELS)).cumsum(axis=1) * sure[:, None], theta


def lowering(hits: np.ndarray, toxic: np.ndarray, n_words: int) -> float:
    """By how much to lower theta_1: to the middle between the last held-out row worth rejecting and the next one."""
    margin, seen = np.zeros(len(toxic)), np.zeros(len(toxic), dtype=bool)
    for half in range(2):
        own = np.arange(len(toxic)) % 2 == half
        if not 0 < toxic[own].sum() < own.sum():
            continue
        mine = hits[own[hits[:, 0]]]
        w, theta = fit_words(np.column_stack([mine[:, 0] // 2, mine[:, 1:]]), toxic[own], n_words)
        score = np.bincount(hits[:, 0], weights=w[hits[:, 1], hits[:, 2] - 1], minlength=len(toxic))
        margin[~own], seen[~own] = score[~own] - theta[0], True
    order = np.argsort(-margin[seen], kind="stable")
    margin, gain = margin[seen][order], np.cumsum(np.where(toxic[seen][order] > 0, 1, -FALSE_WEIGHT))
    # rows of one score can't be parted; those of the least one are never rejected
    ends = np.flatnonzero(np.diff(margin) < 0)
    if not len(ends) or gain[ends].max() <= 0:
        return 0.0
    best = ends[np.argmax(gain[ends])]
    return max(0.0, -(margin[best] + margin[best + 1]) / 2)


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    *,
    sample_rows: int = SAMPLE_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> MODEL:
    """Weights of words and the thresholds, from at most sample_rows labelled documents.

    A document is an id with a text: rows that repeat both count once, and if the ids that are drawn have more documents
    than sample_rows, these are drawn too, by a hash and with one weight for each id. Labels without a toxic value or id, and
    documents without labels, play no role; of labels that repeat an id one counts, the toxic one. Null and empty texts have
    no words; long ones are read whole; other columns of any name play no role. With no labelled row, empty tables or one class only, no word has a weight and
    no document is toxic.
    """
    ship(docs.sparkSession)
    kept = labels.select(F.col("doc_id").alias("_id"), "toxic").where("toxic is not null and _id is not null").groupBy("_id").agg(F.max("toxic").alias("toxic"))
    chosen = kept.select("_id", (F.col("toxic") != 0).cast("int").alias("grade")).orderBy(F.xxhash64(F.col("_id").cast("long")), "_id").limit(sample_rows)
    source = docs.select(column(id_col).cast("long").alias("_id"), column(text_col).alias("text")).dropna(subset=["_id"])
    # the sample is at most sample_rows ids and grades
    sample = source.join(F.broadcast(chosen), "_id").select(F.monotonically_increasing_id().alias("row"), "grade", "text", F.col("_id").alias("id"), F.xxhash64("text").alias("text_hash"))
    sample = sample.mapInArrow(_distinct, "row long, grade int, words array<struct<word:string,level:int>>, id long, text_hash long")
    sample = sample.groupBy("id", "text_hash").agg(F.min("row").alias("row"), F.first("grade").alias("grade"), F.first("words").alias("words")).persist()
    whole = sample
    try:
        if whole.count() > sample_rows:
            # an exponential variate over the weight, 1 for all documents of an id together: one with many crowds no other
            # out; there are at most sample_rows ids
            u = (F.shiftrightunsigned(F.xxhash64("id", "text_hash"), 11) + 0.5) / F.lit(2.0**53)
            weighed = whole.select("id", "text_hash").join(F.broadcast(whole.groupBy("id").agg(F.count("*").alias("n_docs"))), "id")
            keys = weighed.orderBy(-F.log(u) * F.col("n_docs"), "id", "text_hash").limit(sample_rows).select("id", "text_hash")
            sample = whole.join(F.broadcast(keys), ["id", "text_hash"])
        sizes = sample.groupBy("grade").count().collect()
        n, bad = sum(r["count"] for r in sizes), sum(r["count"] for r in sizes if r.grade)
        nothing: MODEL = ({}, [30.0] * (GRADES - 1))
        if not bad or bad == n:
            return nothing
        a, b = F.col("in_bad").cast("double"), F.col("docs").cast("double")
        # chi-squared of the 2 x 2 table of word and toxic
        chi2 = n * F.pow(a * n - b * bad, 2) / (b * (n - b) * bad * (n - bad))
        every = sample.select("row", "grade", F.explode("words").alias("w")).select("row", "grade", "w.*")
        model_words = (
            every.groupBy("word")
            .agg(F.count("*").alias("docs"), F.count_if(F.col("grade") > 0).alias("in_bad"))
            .where((F.col("docs") >= LEAST_DOCS) & (F.col("docs") < n))
            .select("word", chi2.alias("chi2"))
            .where(F.col("chi2") >= LEAST_CHI2)
            .collect()
        )
        if not model_words:
            return nothing
        index = sorted(r.word for r in model_words)
        table = F.broadcast(docs.sparkSession.createDataFrame(list(zip(index, range(len(index)), strict=True)), "word string, at int"))
        hits = every.join(table, "word").select("row", "at", "level").toArrow()
        grades = sample.select("row", "grade").orderBy("row").toArrow()
    finally:
        whole.unpersist()
    hits = np.column_stack([c.to_numpy() for c in hits.columns]).astype(np.int64)
    hits = hits[np.lexsort((hits[:, 1], hits[:, 0]))]
    hits[:, 0] = np.searchsorted(grades.column("row").to_numpy(), hits[:, 0])
    toxic = grades.column("grade").to_numpy().astype(np.int64)
    w, theta = fit_words(hits, toxic, len(index))
    theta[0] -= lowering(hits, toxic, len(index))
    return {x: tuple(map(float, v)) for x, v in zip(index, w, strict=True)}, [float(t) for t in theta]


def _scorer(model: MODEL, text_col: str):
    weights, theta = model

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = np.array(theta)
        for batch in freed(batches):
            found = (Counter(w for w in words_of(t.as_py() or "") if w in weights) for t in batch.column(0).field(text_col))
            scores = [sum(weights[w][level_of(n) - 1] for w, n in sorted(f.items())) for f in found]
            above = 1 / (1 + np.exp(-np.clip(np.array(scores, dtype=float)[:, None] - cuts[None, :], -30, 30)))
            yield pa.record_batch(
                [batch.column(0), pa.array(above.sum(axis=1)), pa.array((above >= 0.5).sum(axis=1).astype("int32")), pa.array(above[:, 0])],
                names=["row", "severity", "grade", "p_toxic"],
            )

    return run


def score_toxicity(docs: DataFrame, model: MODEL, *, text_col: str = "text") -> DataFrame:
    """(row, severity, grade, p_toxic), a row for each row of docs, which is kept as the struct row.

    severity is the expected grade, grade the number of thresholds passed, p_toxic the chance of grade 1 or more. Whole
    texts are read, of any length; null and empty ones have no words and get the grade of a text without known words. Each
    repeated row is scored, rows with equal texts alike; extra columns of any name stay in the struct; empty tables give
    no rows. The model has all words of the fitted sample that pass its thresholds.
    """
    ship(docs.sparkSession)
    source = docs.select(F.struct(*(column(c) for c in docs.columns)).alias("row"))
    schema = T.StructType([source.schema["row"], *(T.StructField(n, t) for n, t in (("severity", T.DoubleType()), ("grade", T.IntegerType()), ("p_toxic", T.DoubleType())))])
    return source.mapInArrow(_scorer(model, text_col), schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, *, reject_from: float = REJECT_FROM) -> DataFrame:
    """The rows of docs that are not toxic, in the same columns.

    Each row is judged by its whole text, so equal texts and repeated rows go or stay together; null and empty texts stay,
    and so do extra columns of any name. An empty table, or one that no label goes with, stays as it is.
    """
    return score_toxicity(docs, fit_toxicity(docs, labels)).where(F.col("p_toxic") < reject_from).select("row.*")


def op9_toxicity(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    scored = score_toxicity(docs, fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("row.doc_id", "severity", "grade", "p_toxic", (F.col("p_toxic") >= REJECT_FROM).alias("toxic"))
