"""Samples of an exact number of rows, the same on every run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import storage
from ..sources.names import quoted
from .frequencies import BROADCAST_ROWS

#: Hexadecimal digits of a row's hash by which rows are counted.
DIGITS = 4


def sample_rows(df: DataFrame, n: int, *, key: list[str] | None = None, by: list[str] | None = None, seed: str = "sample") -> DataFrame:
    """n rows of df, or of each group of the columns in by; all, where there are no more.

    A row's hash is that of the seed and the texts of its key columns (all columns, if not given; a null has no text), and
    the least hashes are drawn. Rows are counted by the first digits of their hash, which tells up to where all are taken;
    only rows that share the next digits are sorted. Rows of one hash are interchangeable.
    """
    key = df.columns if key is None else key
    groups = [f"_by{i}" for i in range(len(by or []))]
    text = F.concat_ws("|", F.lit(seed), *(F.coalesce(F.col(quoted(c)).cast("string"), F.lit("")) for c in key))
    rows = df.select(
        F.struct(*(F.col(quoted(c)) for c in df.columns)).alias("_row"), F.md5(text.cast("binary")).alias("_hash"), *(F.coalesce(F.to_json(F.struct(F.col(quoted(c)).alias("v"))), F.lit("")).alias(g) for c, g in zip(by or [], groups, strict=True))
    ).withColumn("_first", F.substring("_hash", 1, DIGITS))
    # at most 16 ** DIGITS rows a group
    before = W.partitionBy(*groups).orderBy("_first").rowsBetween(W.unboundedPreceding, -1)
    counts = rows.groupBy(*groups, "_first").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    cuts = storage.written(counts.where(F.col("_before") < n).select(*groups, "_first", "_n", "_before"), "sample_cuts")
    cuts = F.broadcast(cuts) if cuts.count() <= BROADCAST_ROWS else cuts
    kept = rows.join(cuts, [*groups, "_first"])
    whole = F.col("_before") + F.col("_n") <= n
    nth = F.row_number().over(W.partitionBy(*groups, "_first").orderBy("_hash"))
    part = kept.where(~whole).withColumn("_nth", nth).where(F.col("_before") + F.col("_nth") <= n)
    return kept.where(whole).select("_row.*").unionByName(part.select("_row.*"))
