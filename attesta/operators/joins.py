"""Joins by overlap, by the last row before, and by position, without comparing all rows with all."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import storage
from ..sources.names import quoted
from .frequencies import BROADCAST_ROWS, ranged

#: Rows of the left side that share a bin, about; a fuller bin is dealt out to several.
ROWS_PER_BIN = 20_000
#: The class of intervals without length.
POINT = -10_000
#: Bits that tell the ends of an interval apart; shorter intervals than such a share of the greatest end are binned alike.
PRECISION = 52


def _row(df: DataFrame) -> Column:
    return F.struct(*(F.col(quoted(c)) for c in df.columns))


def _place(df: DataFrame, name: str) -> Column:
    kind, c = df.schema[name].dataType, F.col(quoted(name))
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("double")
    if isinstance(kind, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), c).cast("double")
    return F.unix_micros(c).cast("double") if isinstance(kind, T.TimestampType) else c.cast("double")


def _intervals(df: DataFrame, ends: tuple[str, str]) -> DataFrame:
    """(row, low, high, class, salt) of rows whose interval holds something; its length is at most 2 ** class."""
    low, high = (_place(df, e) for e in ends)
    out = df.select(_row(df).alias("row"), low.alias("low"), high.alias("high"), F.monotonically_increasing_id().alias("salt"))
    out = out.where((F.col("low") <= F.col("high")) & ~F.isnan("low") & ~F.isnan("high") & (F.abs("low") < float("inf")) & (F.abs("high") < float("inf")))
    return out.withColumn("class", F.when(F.col("low") == F.col("high"), POINT).otherwise(F.ceil(F.log2(F.col("high") - F.col("low"))).cast("int")))


def _binned(rows: DataFrame, classes: list[int]) -> DataFrame:
    """rows with (k, bin, first, own) for each class k of the other side that is not below its own, and for its own."""
    wanted = F.array(*map(F.lit, classes)).cast("array<int>")
    ks = F.array_distinct(F.concat(F.array("class"), F.filter(wanted, lambda k: k > F.col("class"))))
    rows = rows.withColumn("k", F.explode(ks))
    at = lambda x: F.when(F.col("k") == POINT, F.lit(0)).otherwise(F.floor(x / F.pow(F.lit(2.0), F.col("k")))).cast("long")
    rows = rows.withColumn("first", at(F.col("low"))).withColumn("bin", F.explode(F.sequence("first", at(F.col("high")))))
    # points meet points by their value alone
    return rows.withColumn("value", F.when(F.col("k") == POINT, F.col("low") + 0.0).otherwise(0.0)).withColumn("own", F.col("k") == F.col("class"))


def overlap_join(left: DataFrame, right: DataFrame, left_ends: tuple[str, str], right_ends: tuple[str, str], *, rows_per_bin: int = ROWS_PER_BIN) -> DataFrame:
    """(left, right): all pairs of rows whose closed intervals overlap, as two structs.

    An interval lies in at most two bins of its length class, and of each longer class of the other side; a pair meets in
    the class of the longer one, and counts in its first common bin. Bins with many left rows are dealt out, and their
    right rows repeated. Intervals with a null, NaN or infinite end, or with the ends the wrong way round, hold nothing.
    Points are intervals whose ends are one column.
    """
    a, b = _intervals(left, left_ends), _intervals(right, right_ends)
    # one class for each power of two between the least and the greatest length
    of = lambda df: df.groupBy("class").agg(F.max(F.greatest(F.abs("low"), F.abs("high"))).alias("far")).collect()
    a_found, b_found = of(a), of(b)
    # lengths that are but roundings of the ends share one class, whose bins a long can still number
    finest = math.frexp(max((r["far"] for r in (*a_found, *b_found)), default=0.0))[1] - PRECISION
    a, b = (df.withColumn("class", F.when(F.col("class") == POINT, POINT).otherwise(F.greatest("class", F.lit(finest)))) for df in (a, b))
    a_classes, b_classes = (sorted({k if k == POINT else max(k, finest) for k, _ in found}) for found in (a_found, b_found))
    a, b = _binned(a, b_classes), _binned(b, a_classes)
    key = ["k", "bin", "value"]
    full = a.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > rows_per_bin).select(*key, F.ceil(F.col("n") / rows_per_bin).cast("int").alias("parts"))
    full = storage.written(full, "full_bins")
    if not full.isEmpty():
        hint = F.broadcast(full) if full.count() <= BROADCAST_ROWS else full
        a = a.join(hint, key, "left").withColumn("part", F.coalesce(F.pmod("salt", F.col("parts")), F.lit(0)).cast("int")).drop("parts")
        b = b.join(hint, key, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
        key = [*key, "part"]
    a = a.select(*key, F.col("row").alias("left"), F.col("low").alias("a_low"), F.col("high").alias("a_high"), F.col("first").alias("a_first"), F.col("own").alias("a_own"))
    b = b.select(*key, F.col("row").alias("right"), F.col("low").alias("b_low"), F.col("high").alias("b_high"), F.col("first").alias("b_first"), F.col("own").alias("b_own"))
    met = a.join(b, key).where((F.col("a_own") | F.col("b_own")) & (F.col("bin") == F.greatest("a_first", "b_first")))
    return met.where((F.col("a_low") <= F.col("b_high")) & (F.col("b_low") <= F.col("a_high"))).select("left", "right")


def asof_join(left: DataFrame, right: DataFrame, left_time: str, right_time: str, *, by: tuple[tuple[str, str], ...] = (), how: str = "left") -> DataFrame:
    """(left, right): each left row with the last right row of the same keys that is not later, as two structs.

    by has pairs of key columns. Both sides are sorted together by key and time in ranges; a range is given the last right
    row before it, so one key may reach over many. Of right rows of one key and time, the greatest by their other columns
    counts. A null key or time matches nothing; with how="left" such left rows stay, with a null on the right.
    """
    keys = [f"_k{i}" for i in range(len(by))]
    own = left.select(_row(left).alias("left"), F.col(quoted(left_time)).alias("_t"), *(F.col(quoted(a)).alias(k) for (a, _), k in zip(by, keys, strict=True)))
    other = right.select(_row(right).alias("right"), F.col(quoted(right_time)).alias("_t"), *(F.col(quoted(b)).alias(k) for (_, b), k in zip(by, keys, strict=True))).dropna(subset=["_t", *keys])
    other = other.groupBy(*keys, "_t").agg(F.max("right").alias("right"))
    able = F.col("_t").isNotNull()
    for k in keys:
        able = able & F.col(k).isNotNull()
    both = other.withColumn("_side", F.lit(0)).unionByName(own.where(able).withColumn("_side", F.lit(1)), allowMissingColumns=True)
    rows = ranged(both, [*keys, "_t", "_side"], "asof_rows")
    key = F.struct(F.lit(0).alias("_"), *keys)
    lasts = rows.groupBy("_range").agg(F.max_by(F.when(F.col("_side") == 0, F.struct(key.alias("key"), F.col("right").alias("right"))), F.when(F.col("_side") == 0, F.col("_mid"))).alias("last"))
    # one row a range
    carried = lasts.select("_range", F.last("last", ignorenulls=True).over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)).alias("_carried"))
    inside = W.partitionBy("_range", *keys).orderBy("_mid").rowsBetween(W.unboundedPreceding, 0)
    seen = rows.withColumn("_seen", F.last("right", ignorenulls=True).over(inside)).where("_side = 1")
    carried = F.broadcast(carried) if carried.count() <= BROADCAST_ROWS else carried
    before = F.when(F.col("_carried.key") == key, F.col("_carried.right"))
    out = seen.join(carried, "_range", "left").select("left", F.coalesce("_seen", before).alias("right"))
    if how == "inner":
        return out.where("right is not null")
    return out.unionByName(own.where(~F.coalesce(able, F.lit(False))).select("left"), allowMissingColumns=True)


def numbered_rows(df: DataFrame, name: str) -> DataFrame:
    """(row, place): rows by their place in the order of df, from 0; a place is that in its partition plus the rows before."""
    rows = storage.written(df.select(_row(df).alias("row"), F.monotonically_increasing_id().alias("_mid")), name)
    rows = rows.select("row", F.shiftright("_mid", 33).alias("_part"), F.col("_mid").bitwiseAND((1 << 33) - 1).alias("_at"))
    counts = rows.groupBy("_part").agg(F.count("*").alias("n"))
    # one row a partition
    bases = counts.select("_part", F.coalesce(F.sum("n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    return rows.join(F.broadcast(bases), "_part").select("row", (F.col("_base") + F.col("_at")).alias("place"))


def positional_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left, right): rows at the same place of both sides, as two structs; the longer side's rest has nulls beside it."""
    a, b = numbered_rows(left, "left_places"), numbered_rows(right, "right_places")
    return a.withColumnRenamed("row", "left").join(b.withColumnRenamed("row", "right"), "place", "full").select("left", "right")
