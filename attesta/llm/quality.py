"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

A rule is (name, numerator, denominator, most, least) over the counts that measures() gives; a document is kept if every
ratio is within its bounds. All arithmetic of the verdict is on whole numbers, so any engine agrees on it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAP_CHARS, WORD, documents, text_of

SYMBOLS = "#*$%&|<>"
#: Frequent short words of the four languages, lower case; fixed values.
STOP_WORDS = ("a", "and", "as", "by", "for", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with",
              "das", "dem", "den", "der", "die", "ein", "eine", "ist", "mit", "nicht", "und", "von", "zu",
              "de", "des", "du", "en", "est", "et", "la", "le", "les", "par", "pas", "pour", "que", "un", "une",
              "con", "el", "es", "los", "no", "se", "y")

#: name, numerator, denominator, most, least: the ratio in thousandths must be from least to most (None: no bound).
RULES: tuple[tuple[str, str, str, int | None, int | None], ...] = (
    ("word_length", "word_chars", "n_words", 15_000, 2_000),
    ("symbols", "n_symbols", "n_words", 250, None),
    ("dup_lines", "n_dup_lines", "n_lines", 500, None),
    ("repeat_words", "n_repeat_words", "n_words", 400, None),
    ("stop_words", "n_stop_words", "n_words", None, 10),
    ("bullet_lines", "n_bullet_lines", "n_lines", 900, None),
    ("ellipsis_lines", "n_ellipsis_lines", "n_lines", 400, None),
)
LEAST_WORDS = 50
MOST_REPEATED = 50


def window_hashes(hashes: Column, n: Column) -> Column:
    """64-bit hashes of the 3-word windows of an array of n word hashes."""
    m = F.greatest(n - 2, F.lit(0))
    return F.transform(
        F.arrays_zip(F.slice(hashes, 1, m).alias("a"), F.slice(hashes, F.lit(2), m).alias("b"), F.slice(hashes, F.lit(3), m).alias("c")),
        lambda z: F.xxhash64(z["a"], z["b"], z["c"]),
    )


def measures(docs: DataFrame, text_col: str) -> DataFrame:
    """docs with a struct _q of all counts of the whole text (null: no words).

    Words in repeated windows: where all windows differ, the distinct hashes tell so; else the windows are sorted with
    their places, those with an equal neighbour are kept, and each adds the words that the one before doesn't cover.
    """
    words = F.regexp_extract_all(text_of(text_col), F.lit(f"({WORD})"), F.lit(1))
    base = docs.select("*", words.alias("_words"), F.filter(F.split(text_of(text_col), "\n"), lambda x: x.rlike(WORD)).alias("_lines"))
    hashed = base.select(
        "*", F.size("_words").alias("_n"), F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"), F.size("_lines").alias("_n_lines")
    )
    windowed = hashed.select("*", F.when(F.col("_n") >= 3, window_hashes(F.col("_hashes"), F.col("_n"))).otherwise(F.array().cast("array<long>")).alias("_windows"))
    placed = windowed.select(
        "*",
        F.when(
            F.size(F.array_distinct("_windows")) < F.size("_windows"),
            F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).alias("_sorted"),
    )
    # places of windows whose hash the sorted neighbour before or after shares, in order
    size = F.size("_sorted")
    nothing = F.struct(F.lit(None).cast("long").alias("h"), F.lit(None).cast("int").alias("i"))
    before = F.concat(F.array(nothing), F.slice("_sorted", F.lit(1), size - 1))
    after = F.concat(F.slice("_sorted", F.lit(2), size - 1), F.array(nothing))
    shared = F.sort_array(
        F.transform(
            F.filter(
                F.arrays_zip(F.col("_sorted").alias("at"), before.alias("low"), after.alias("high")),
                lambda z: F.coalesce(z["at"]["h"] == z["low"]["h"], F.lit(False)) | F.coalesce(z["at"]["h"] == z["high"]["h"], F.lit(False)),
            ),
            lambda z: z["at"]["i"],
        )
    )
    found = placed.select("*", F.when(F.col("_sorted").isNotNull(), shared).alias("_shared"))
    gaps = F.zip_with(F.slice("_shared", F.lit(2), F.size("_shared") - 1), F.slice("_shared", F.lit(1), F.size("_shared") - 1), lambda b, a: F.least(F.lit(3), b - a))
    covered = F.coalesce(F.aggregate(gaps, F.lit(3).cast("int"), lambda s, x: s + x), F.lit(0))
    text = text_of(text_col)
    counts = {
        "n_words": F.col("_n"),
        "word_chars": F.length(F.translate(text, GAP_CHARS, "")),
        "n_symbols": F.length(text) - F.length(F.translate(text, SYMBOLS, "")),
        "n_lines": F.col("_n_lines"),
        "n_dup_lines": F.col("_n_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": covered,
        "n_stop_words": F.size(F.filter("_words", lambda w: F.lower(w).isin(*STOP_WORDS))),
        "n_bullet_lines": F.size(F.filter("_lines", lambda x: F.ltrim(x).rlike(r"^[-*•]"))),
        "n_ellipsis_lines": F.size(F.filter("_lines", lambda x: F.rtrim(x).rlike(r"(\.\.\.|…)$"))),
    }
    return found.select(*docs.columns, F.struct(*(c.cast("long").alias(k) for k, c in counts.items())).alias("_q"))


def verdict(counts: dict[str, Column], rules=RULES) -> Column:
    """Whether every rule holds; a ratio over nothing is 0."""
    tests = [F.lit(True)]
    for _, top, bottom, most, least in rules:
        if most is not None:
            tests.append(counts[top] * 1000 <= counts[bottom] * most)
        if least is not None:
            tests.append(counts[top] * 1000 >= counts[bottom] * least)
    return reduce(lambda a, b: a & b, tests)


def quality_rules(docs: DataFrame, *, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, the counts, base_failed, kept), a row for each row of docs.

    base_failed: fewer than 50 words, or over half of them in repeated 3-word windows. kept: not base_failed, and every
    rule holds. Null and empty texts have no words and fail. Repeated rows are judged alike; a null id stays null; empty
    tables give no rows; other columns of docs play no role.
    """
    m = measures(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text").select("doc_id", "_q.*")
    counts = {c: F.col(c) for c in m.columns[1:]}
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return m.select("*", failed.alias("base_failed"), (~failed & verdict(counts, rules)).alias("kept"))


def op3_quality(spark, sf_dir):
    return quality_rules(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_stop_words"
    )


def oracle(rules=RULES) -> str:
    tests = []
    for _, top, bottom, most, least in rules:
        if most is not None:
            tests.append(f"{top} * 1000 <= {bottom} * {most}")
        if least is not None:
            tests.append(f"{top} * 1000 >= {bottom} * {least}")
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    gap = r"[\x20\x09-\x0D]+"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
w AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM d WHERE len(ws) >= 3),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS n FROM w),
p AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM g WHERE n > 1) GROUP BY doc_id),
c AS (SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '{gap}', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
  CAST(len(list_filter(ws, lambda x: lower(x) IN ({stops}))) AS BIGINT) AS n_stop_words,
  CAST(len(list_filter(ls, lambda x: regexp_matches(ltrim(x, ' '), '^[-*•]'))) AS BIGINT) AS n_bullet_lines,
  CAST(len(list_filter(ls, lambda x: regexp_matches(rtrim(x, ' '), '(\.\.\.|…)$'))) AS BIGINT) AS n_ellipsis_lines
  FROM d LEFT JOIN p ON d.doc_id IS NOT DISTINCT FROM p.doc_id),
f AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {" AND ".join(tests)} AS kept, n_lines, n_stop_words FROM f
"""
