"""Order-dependent operators over a whole column without a single-partition window.

Rows are dealt to ranges of the ordering value, cut at approximate quantiles; a window inside each range is completed
by one row for each range before it. The number of ranges grows with the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import storage
from ..sources.names import quoted

#: Values that a range holds about, and the most ranges that there are.
PER_RANGE = 500_000
MOST_RANGES = 4096
#: Rows of a range table that may be broadcast.
BROADCAST_ROWS = 500_000
#: Cuts that a row is compared with at once; more are looked up in two steps.
STEP = 64


def ranges_for(rows: int) -> int:
    return min(MOST_RANGES, -(-rows // PER_RANGE))


def range_of(df: DataFrame, value: Column, n: int) -> Column:
    """Number of the range of n that a value lies in; n quantiles are all that comes to the driver."""
    if n <= 1:
        return F.lit(0)
    found = df.select(F.percentile_approx(value, [i / n for i in range(1, n)], max(10_000, 4 * n))).first()[0]
    cuts = sorted(set(found or ()))
    below = lambda some: F.size(F.filter(F.array(*map(F.lit, some)), lambda c: c <= value)) if some else F.lit(0)
    if len(cuts) <= STEP:
        return below(cuts)
    groups = [cuts[i : i + STEP] for i in range(0, len(cuts), STEP)]
    nth = below([g[0] for g in groups])
    inside = F.get(F.array(*(F.array(*map(F.lit, g)) for g in groups)), nth - 1)
    return F.when(nth > 0, (nth - 1) * STEP + F.size(F.filter(inside, lambda c: c <= value))).otherwise(0)


def running_total(df: DataFrame, value: str, amount: str, name: str, n: int | None = None) -> DataFrame:
    """df, whose values are distinct, with the sum of the amounts of all lower values."""
    n = ranges_for(df.count()) if n is None else n
    ranged = df.withColumn("_range", range_of(df, F.col(value), n))
    inside = W.partitionBy("_range").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    within = F.coalesce(F.sum(amount).over(inside), F.lit(0))
    if n <= 1:
        return ranged.withColumn(name, within).drop("_range")
    sums = ranged.groupBy("_range").agg(F.sum(amount).alias("_sum"))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # one row a range
    sums = sums.select("_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    return ranged.join(F.broadcast(sums), "_range").withColumn(name, F.col("_base") + within).drop("_range", "_base")


def with_previous(df: DataFrame, value: str, name: str, n: int | None = None) -> DataFrame:
    """df, whose values are distinct, with the next lower value of each."""
    n = ranges_for(df.count()) if n is None else n
    ranged = df.withColumn("_range", range_of(df, F.col(value), n))
    inside = F.lag(value).over(W.partitionBy("_range").orderBy(value))
    if n <= 1:
        return ranged.withColumn(name, inside).drop("_range")
    tops = ranged.groupBy("_range").agg(F.max(value).alias("_top"))
    tops = tops.select("_range", F.lag("_top").over(W.orderBy("_range")).alias("_below"))  # one row a range
    return ranged.join(F.broadcast(tops), "_range").withColumn(name, F.coalesce(inside, "_below")).drop("_range", "_below")


def average_ranks(counts: DataFrame, value: str, name: str, n: int | None = None) -> DataFrame:
    """(value, count, rank) from (value, count) of distinct values: tied rows share the mean of their places, counted from 1."""
    return running_total(counts, value, "count", "_before", n).select(value, "count", (F.col("_before") + (F.col("count") + 1) / 2).alias(name))


def counted(df: DataFrame, value: str) -> DataFrame:
    """(value, count) of the distinct values of a column."""
    return df.groupBy(value).agg(F.count("*").alias("count"))


def percentiles(df: DataFrame, value: str, fractions: list[float], by: list[str], n: int | None = None) -> DataFrame:
    """(by..., p0, p1...): exact percentiles of a numeric column in each group, between neighbours in proportion; nulls don't count.

    A first pass counts the rows of each range of values in each group; a second one groups and sorts the values of those
    ranges alone that hold a place asked for. So a task gets the distinct values of a range, not those of a group.
    """
    keys = [F.col(quoted(b)) for b in by]
    rows = df.select(F.struct(F.lit(0).alias("_"), *(k.alias(f"k{i}") for i, k in enumerate(keys))).alias("_key"), F.col(quoted(value)).cast("double").alias("_v"))
    n = ranges_for(rows.count()) if n is None else n
    ranged = rows.withColumn("_range", F.when(F.col("_v").isNotNull(), range_of(rows, F.col("_v"), n)).otherwise(-1))
    sums = storage.written(ranged.groupBy("_key", "_range").agg(F.count("_v").alias("rows")), "range_counts")
    group, earlier = W.partitionBy("_key"), W.partitionBy("_key").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    based = sums.withColumn("total", F.sum("rows").over(group)).withColumn("base", F.coalesce(F.sum("rows").over(earlier), F.lit(0)))
    at = [(F.col("total") - 1) * F.lit(float(p)) for p in fractions]
    places = F.array_distinct(F.array(*(f(x).cast("long") for x in at for f in (F.floor, F.ceil))))
    here = lambda first, rows: F.filter(places, lambda x: (first <= x) & (x < first + rows))
    held = storage.written(based.where("rows > 0").where(F.size(here(F.col("base"), F.col("rows"))) > 0).select("_key", "_range", "base", "total"), "held_ranges")
    few = F.broadcast(held) if held.count() <= BROADCAST_ROWS else held
    counts = ranged.join(few.select("_key", "_range"), ["_key", "_range"]).groupBy("_key", "_range", "_v").agg(F.count("*").alias("rows"))
    inside = W.partitionBy("_key", "_range").orderBy("_v").rowsBetween(W.unboundedPreceding, -1)
    placed = counts.withColumn("before", F.coalesce(F.sum("rows").over(inside), F.lit(0))).join(few, ["_key", "_range"])
    found = placed.select("_key", "_v", F.explode(here(F.col("base") + F.col("before"), F.col("rows"))).alias("place"))
    values = found.groupBy("_key").agg(F.map_from_entries(F.collect_list(F.struct("place", "_v"))).alias("values"))
    out = sums.groupBy("_key").agg(F.sum("rows").alias("total")).join(values, "_key", "left")

    def between(x):
        low, high = (F.try_element_at("values", f(x).cast("long")) for f in (F.floor, F.ceil))
        return F.when(low == high, low).otherwise((F.ceil(x) - x) * low + (x - F.floor(x)) * high)

    return out.select(*(F.col(f"_key.k{i}").alias(b) for i, b in enumerate(by)), *(between(x).alias(f"p{i}") for i, x in enumerate(at)))
