"""Mix sources to target weights, with built-in Spark functions only.

Each row gets a hash-random key; within its source, rows are cut into key ranges ("cells"), each range is sorted, and
the running sum of sizes is the sum of the lower ranges plus the running sum inside its own. A source whose target is
several times its size is taken in whole epochs, then in key order up to the exact rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import GAP, WORD, column, documents, pieces_for, text_of, written

WEIGHTS = (1, 2, 3)
CAP = 3
SEED = "mix-1"
KEY_BITS = 60


def mix_sources(
    docs: DataFrame,
    *,
    weights: tuple[int, ...] = WEIGHTS,
    cap: int = CAP,
    seed: str = SEED,
    rows_per_cell: int = 5_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """(doc_id, size, source_size, target, taken, epochs, key, s_null, s_val), a row for each row of docs.

    Size is the number of words of the whole text (null: 0). Sources in code-point order, null last, have the weights in
    turn and share all words; a target stops at cap times the source's size, its excess goes to the others by weight.
    taken sums to the rounded target in each source: whole epochs, then rows by key, the last one in part.
    A null id is a value like others; repeated rows and ties are ordered by key, id, then size, so reruns agree. Empty
    tables give no rows; a source without words has target 0. Other columns of docs play no role.
    """
    sized = written(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).isNull().alias("s_null"),
            F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("s_val"),
            _size(text_col).alias("size"),
            _key(id_col, text_col, seed).alias("key"),
        ),
        "mix_sizes",
    )
    bits = (pieces_for(sized.count(), rows_per_cell) - 1).bit_length()
    sized = sized.withColumn("cell", F.shiftright("key", KEY_BITS - bits))
    source = ["s_null", "s_val"]
    in_source = W.partitionBy(*source).orderBy("cell")
    cells = (
        sized.groupBy(*source, "cell")
        .agg(F.sum("size").alias("cell_size"))
        .withColumn("below", F.sum("cell_size").over(in_source.rowsBetween(W.unboundedPreceding, 0)) - F.col("cell_size"))
    )
    aims = source_targets(sized.groupBy(*source).agg(F.sum("size").alias("source_size")), weights, cap)
    cells = cells.join(aims, source)
    in_cell = W.partitionBy(*source, "cell").orderBy("key", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "size").rowsBetween(W.unboundedPreceding, 0)
    before = F.col("below") + F.sum("size").over(in_cell) - F.col("size")
    rest = F.col("budget") - F.col("epochs") * F.col("source_size") - before
    return sized.join(cells, [*source, "cell"]).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("epochs") + F.greatest(F.lit(0), F.least("size", rest))).cast("long").alias("taken"),
        "epochs",
        "key",
        *source,
    )


def _size(text_col: str) -> Column:
    return F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long")


def _key(id_col: str, text_col: str, seed: str) -> Column:
    """From the id and the text, so that rows of one id, or of none, are spread too."""
    name = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(f":{seed}:"), F.md5(text_of(text_col)))
    return F.conv(F.substring(F.md5(name), 1, KEY_BITS // 4), 16, 10).cast("long")


def take_mix(docs: DataFrame, *, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of docs as often as the mix takes them, in the same columns; a row taken in part keeps its first words.

    What a row gives follows from the epochs of its source and from where the last epoch is cut, so texts are joined with
    one row a source and not moved, but for rows that repeat both the id and the text of the one at a cut; these are
    numbered. Null sources are one source; null and empty texts have no words and are never taken; long ones are cut in
    whole words; extra columns of any name stay; an empty table gives no rows. An n_chars column follows a text that is cut.
    """
    mix = mix_sources(docs, seed=seed, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    extra = F.col("taken") - F.col("size") * F.col("epochs")
    place = F.struct("key", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "size")
    tied = mix.where("size > 0").withColumn("extra", extra).withColumn("place", place).groupBy("s_null", "s_val", "place").agg(
        F.first("epochs").alias("epochs"), F.min("extra").alias("least"), F.sum("extra").alias("extra"), F.count("*").alias("rows"), F.first("size").alias("size")
    )
    # the first place that isn't taken in whole, what its rows have in all, and how many they are
    at_cut = F.min(F.when(F.col("least") < F.col("size"), F.struct("place", "extra", "rows")))
    cuts = tied.groupBy("s_null", "s_val").agg(F.first("epochs").alias("epochs"), at_cut.alias("cut"))
    cuts = written(cuts, "mix_cuts")
    rows = docs.select(
        F.struct(*(column(c) for c in docs.columns)).alias("row"),
        F.col(source_col).isNull().alias("s_null"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("s_val"),
        F.struct(_key(id_col, text_col, seed).alias("key"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), _size(text_col).alias("size")).alias("place"),
    )
    rows = rows.join(cuts, ["s_null", "s_val"])
    same = F.coalesce(F.col("place") == F.col("cut.place"), F.lit(False))
    part = F.when(F.col("cut").isNull() | (F.col("place") < F.col("cut.place")), F.col("place.size")).when(same, F.col("cut.extra")).otherwise(0)
    if cuts.where("cut.rows > 1").isEmpty():
        rows = rows.withColumn("part", part)
    else:
        nth = F.row_number().over(W.partitionBy("s_null", "s_val").orderBy(F.xxhash64(F.to_json("row")))) - 1
        size = F.col("place.size")
        again = rows.where(same).withColumn("part", F.greatest(F.lit(0), F.least(size, F.col("cut.extra") - nth * size)))
        rows = rows.where(~same).withColumn("part", part).unionByName(again)
    # no filter on sizes before, which Spark would move below the projection and so count words twice
    copies = F.filter(F.concat(F.array_repeat(F.col("place.size"), F.col("epochs").cast("int")), F.array("part")), lambda words: words > 0)
    rows = rows.select("row", "place", F.explode(copies).alias("words"))
    text = F.col("row").getField(text_col)
    first = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(f"({GAP.replace('+', '*')}{WORD})"), F.lit(1)), F.lit(1), F.col("words").cast("int")), "")
    rows = rows.withColumn("changed", F.when(F.col("words") < F.col("place.size"), first))
    out = {c: F.col("row").getField(c) for c in docs.columns}
    out[text_col] = F.coalesce("changed", text)
    if "n_chars" in out:
        out["n_chars"] = F.coalesce(F.length("changed").cast(docs.schema["n_chars"].dataType), out["n_chars"])
    return rows.select(*(v.alias(c) for c, v in out.items()))


def source_targets(sources: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """Adds target (double), budget and epochs (long) to (s_null, s_val, source_size), which has one row a source.

    Resharing until none is above its cap ends where the sources with the lowest cap per weight are capped and the
    others share what is left by weight; in that order, a source is capped if its cap is below its share of what the
    sources before it leave. The windows run over one row a source, never over documents.
    """
    by_name = W.orderBy("s_null", "s_val")
    by_ratio = W.orderBy(F.col("cap") / F.col("w"), "s_null", "s_val")
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    at = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    s = (
        sources.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), at + 1).cast("long"))
        .withColumn("cap", F.col("source_size") * cap)
        .withColumn("total", F.sum("source_size").over(every))
        .withColumn("total_w", F.sum("w").over(every))
        .withColumn("caps_before", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("w_before", F.coalesce(F.sum("w").over(before), F.lit(0)))
        .withColumn(
            "capped",
            F.col("cap").cast("double") * (F.col("total_w") - F.col("w_before")) < F.col("w").cast("double") * (F.col("total") - F.col("caps_before")),
        )
        .withColumn("left", F.col("total") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(every))
        .withColumn("left_w", F.sum(F.when(F.col("capped"), 0).otherwise(F.col("w"))).over(every))
    )
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("w").cast("double") * F.col("left") / F.col("left_w"))
    return (
        s.withColumn("target", target)
        .withColumn("budget", F.round("target").cast("long"))
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.try_divide("budget", "source_size"))).otherwise(0).cast("long"))
        .select("s_null", "s_val", "source_size", "target", "budget", "epochs")
    )


def op8_mixing(spark, sf_dir):
    return mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':mix-1:' || md5(coalesce(text, ''))), 1, 15) AS key
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS w
  FROM d GROUP BY source),
r AS (
  SELECT *, 3 * source_size AS cap, sum(source_size) OVER () AS total, sum(w) OVER () AS total_w,
         coalesce(sum(3 * source_size) OVER b, 0) AS caps_before, coalesce(sum(w) OVER b, 0) AS w_before
  FROM s WINDOW b AS (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, CAST(cap AS DOUBLE) * (total_w - w_before) < CAST(w AS DOUBLE) * (total - caps_before) AS capped FROM r),
l AS (SELECT *, total - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER () AS rest, sum(CASE WHEN capped THEN 0 ELSE w END) OVER () AS left_w FROM c),
t AS (SELECT source, source_size, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE CAST(w AS DOUBLE) * CAST(rest AS DOUBLE) / CAST(left_w AS DOUBLE) END AS target FROM l),
e AS (SELECT *, CAST(round(target) AS BIGINT) AS budget, CASE WHEN source_size > 0 THEN CAST(floor(CAST(round(target) AS DOUBLE) / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t)
SELECT d.doc_id, d.size, e.source_size, e.target,
       CAST(d.size * epochs + greatest(0, least(d.size, budget - epochs * source_size
         - (sum(d.size) OVER (PARTITION BY d.source ORDER BY key, coalesce(CAST(d.doc_id AS VARCHAR), ''), d.size ROWS UNBOUNDED PRECEDING) - d.size))) AS BIGINT) AS taken
FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source
"""
