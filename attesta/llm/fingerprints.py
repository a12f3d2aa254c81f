"""Document fingerprints: one-permutation MinHash with optimal densification, in built-in Spark functions only.

All five-word shingles are hashed once. The high bits of a hash choose one of 128 bins; a bin's value is its least hash.
An empty bin takes the value of the filled bin that a hash of both bin numbers ranks first, a uniform choice that two
documents with the same filled bins make alike. Of each value, the low eight bits are kept. Two fingerprints agree by
chance in one bin of 256, which the likeness corrects for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, documents, pieces_for, text_of, written

WORDS = 5
BIN_BITS = 7
BINS = 1 << BIN_BITS
VALUE_BITS = 8
COARSE = 16
LOWEST = -(2**63)
#: Rows of two numbers that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def with_code(df: DataFrame, text: str, code: str) -> DataFrame:
    """df with an array of one byte a bin; empty for a text without words.

    A text of fewer than five words has its whole sequence as one shingle. Each step is a projection of its own, and what
    a lambda reads besides its own element is a column of the step before, so nothing is evaluated for each element anew.
    """
    names = df.columns
    bin_of = lambda x: F.shiftrightunsigned(x, 64 - BIN_BITS)
    df = df.withColumn("_h", F.transform(F.regexp_extract_all(F.col(text), F.lit(f"({WORD})"), F.lit(1)), lambda w: F.xxhash64(w)))
    df = df.withColumn("_n", F.size("_h"))
    windows = F.arrays_zip(*(F.slice("_h", F.lit(i + 1), F.greatest(F.col("_n") - (WORDS - 1), F.lit(0))).alias(f"w{i}") for i in range(WORDS)))
    shingles = F.when(F.col("_n") >= WORDS, F.transform(windows, lambda z: F.xxhash64(*(z[f"w{i}"] for i in range(WORDS)))))
    shingles = shingles.when(F.col("_n") > 0, F.array(F.xxhash64("_h"))).otherwise(F.array().cast("array<long>"))
    df = df.select(*names, F.sort_array(shingles).alias("_s"))
    least = F.filter("_s", lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(F.col("_s"), i - 1))))
    df = df.select(*names, least.alias("_m"))
    df = df.select(*names, "_m", F.map_from_arrays(F.transform("_m", lambda x: bin_of(x).cast("int")), F.transform("_m", lambda x: x)).alias("_b"))
    borrowed = lambda i: F.array_min(F.transform("_m", lambda x: F.struct(F.xxhash64(bin_of(x), i).alias("rank"), x.alias("value"))))["value"]
    own = lambda i: F.try_element_at("_b", i)
    filled = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.coalesce(own(i), borrowed(i)))
    low = F.transform(filled, lambda v: (v.bitwiseAND((1 << VALUE_BITS) - 1) - 128).cast("byte"))
    return df.select(*names, F.when(F.size("_b") > 0, low).otherwise(F.array().cast("array<byte>")).alias(code))


def packed(code: Column) -> Column:
    """Two hexadecimal digits a bin."""
    return F.array_join(F.transform(code, lambda x: F.lower(F.lpad(F.hex(x.cast("int") + 128), 2, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two codes, from 0 to 1; texts without words are like each other only."""
    chance = 2.0**-VALUE_BITS
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    j = (same / F.lit(BINS) - chance) / (1 - chance)
    some = (F.size(a) > 0) & (F.size(b) > 0)
    return F.when(some, F.greatest(F.lit(0.0), j)).otherwise(F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(0.0))


def fingerprint(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint), a row for each row of docs, without a shuffle.

    Whole texts count; null is empty, and texts without words have an empty fingerprint. Equal texts have equal ones.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("_text"))
    return with_code(source, "_text", "_code").select("doc_id", packed(F.col("_code")).alias("fingerprint"))


def id_ranges(docs: DataFrame, order: Column, rows_per_range: int) -> Column:
    """An expression for the number of a row's range of ids: ranges ascend with the ids and hold about rows_per_range rows.

    256 quantiles (all that comes to the driver) are each cut into parts of equal width. A row's quantile is looked up
    in two steps of 16.
    """
    n = COARSE * COARSE
    found = docs.agg(F.count("*").alias("rows"), F.min(order).alias("low"), F.percentile_approx(order, [i / n for i in range(1, n)], 10_000).alias("at"), F.max(order).alias("high")).first()
    if not found.rows:
        return F.lit(0).cast("long")
    low = [found.low, *found.at]
    ends = [*low[1:], found.high]
    parts = pieces_for(pieces_for(found.rows, n), rows_per_range)
    widths = [max(1, -(-(e - b) // parts)) for b, e in zip(low, ends, strict=True)]
    longs = lambda xs: F.array(*(F.lit(x).cast("long") for x in xs))
    top = F.size(F.filter(longs(low[::COARSE]), lambda b: b <= order)) - 1
    fine = F.array(*(longs(low[i : i + COARSE]) for i in range(0, n, COARSE)))
    at = top * COARSE + F.size(F.filter(F.get(fine, top), lambda b: b <= order)) - 1
    doubles = lambda xs: F.array(*(F.lit(float(x)) for x in xs))
    within = F.least(F.lit(parts - 1), F.floor((order.cast("double") - F.get(doubles(low), at)) / F.get(doubles(widths), at)))
    return (at.cast("long") * parts + within).cast("long")


def fingerprints_with_next(docs: DataFrame, *, rows_per_range: int = 4_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and how alike they are; a row for each row of docs.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next text
    by ascending id, after the last the first. Texts move once, to ranges of ids; the first row of a range is also sent
    to the range before it, so that a window within a range sees every next row. Rows with equal ids are ordered by a
    hash of the text, then of the fingerprint; null ids come first. A table of one row is next to itself.
    """
    order = F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST))
    rows = docs.select(F.col(id_col).alias("doc_id"), order.alias("_at"), text_of(text_col).alias("_text"))
    ranges = id_ranges(docs.select(order.alias("_at")), F.col("_at"), rows_per_range)
    rows = rows.withColumn("_range", ranges)
    firsts = docs.select(order.alias("_at")).withColumn("_range", ranges).groupBy("_range").agg(F.min("_at").alias("_at"))
    # one row a range: all ranges are few beside the rows
    back = W.orderBy("_range")
    firsts = firsts.select("_at", "_range", F.coalesce(F.lag("_range").over(back), F.max("_range").over(W.partitionBy())).alias("_before"))
    firsts = written(firsts.select("_at", "_before"), "range_firsts")
    # one row a range; planned by its size before it runs, a small table never makes Spark shuffle the texts
    firsts = F.broadcast(firsts) if firsts.count() <= BROADCAST_ROWS else firsts
    copies = rows.join(firsts, "_at").withColumn("_tie", F.xxhash64("_text"))
    copies = copies.withColumn("_k", F.row_number().over(W.partitionBy("_before").orderBy("_tie"))).where("_k = 1")
    both = rows.withColumn("_copy", F.lit(False)).unionByName(
        copies.select("doc_id", "_at", "_text", F.col("_before").alias("_range"), F.lit(True).alias("_copy"))
    ).withColumn("_tie", F.xxhash64("_text"))
    both = with_code(both, "_text", "_code")
    inside = W.partitionBy("_range").orderBy("_copy", "_at", "_tie")
    seen = both.withColumn("_next", F.lead("_text").over(inside)).withColumn("_next_code", F.lead("_code").over(inside)).where("not _copy")
    n = F.length("_text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("_text"), F.lit(1), n - half), F.substring(F.col("_next"), F.lit(1), half))
    out = seen.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("_edited"), "_code", likeness(F.col("_code"), F.col("_next_code")).alias("near_next"))
    out = with_code(out.select("*", F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256")), "_edited", "_edited_code")
    return out.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        packed(F.col("_code")).alias("fingerprint"),
        packed(F.col("_edited_code")).alias("edited_fingerprint"),
        likeness(F.col("_code"), F.col("_edited_code")).alias("near_edited"),
        "near_next",
    )


def op6_fingerprints(spark, sf_dir):
    return fingerprints_with_next(documents(spark, sf_dir))
