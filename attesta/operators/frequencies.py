"""How often each value of each column occurs: one grouping over all columns, sorted by ranges.

A value is held as one of a long, a double and a text, so that columns of all types stand in one table, in which the
values of a column are in order. Numbers, times and booleans keep their order, text its bytes; a decimal is ordered as a
double, then by its text; maps, arrays, structs and binary values by their text.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import storage
from ..sources.names import quoted

KEY = ("l", "d", "s")
#: Rows of a range table that may be broadcast.
BROADCAST_ROWS = 500_000
_EPOCH = datetime(1970, 1, 1)
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def cell(df: DataFrame, name: str) -> dict[str, Column]:
    """The columns l, d and s for the values of a column; all are null where it is null."""
    kind, c = df.schema[name].dataType, F.col(quoted(name))
    none = {"l": F.lit(None).cast("long"), "d": F.lit(None).cast("double"), "s": F.lit(None).cast("string")}
    if isinstance(kind, (*_WHOLE, T.BooleanType)) or isinstance(kind, T.DecimalType) and not kind.scale and kind.precision <= 18:
        return none | {"l": c.cast("long")}
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return none | {"d": c.cast("double")}
    if isinstance(kind, T.DecimalType):
        return none | {"d": c.cast("double"), "s": c.cast("string")}
    if isinstance(kind, T.DateType):
        return none | {"l": F.unix_date(c).cast("long")}
    if isinstance(kind, T.TimestampNTZType):
        return none | {"l": F.timestamp_diff("MICROSECOND", F.lit(_EPOCH).cast("timestamp_ntz"), c)}
    if isinstance(kind, T.TimestampType):
        return none | {"l": F.unix_micros(c)}
    if isinstance(kind, T.StringType):
        return none | {"s": c}
    if isinstance(kind, (T.MapType, T.ArrayType, T.StructType)):
        return none | {"s": F.to_json(c)}
    return none | {"s": F.hex(c) if isinstance(kind, T.BinaryType) else c.cast("string")}


def value_of(kind: T.DataType, row) -> object:
    """The Python value of a cell; null for none."""
    if row is None or row.l is None and row.d is None and row.s is None:
        return None
    if isinstance(kind, T.BooleanType):
        return bool(row.l)
    if isinstance(kind, T.DecimalType):
        return Decimal(row.l if row.l is not None else row.s)
    if isinstance(kind, T.DateType):
        return date(1970, 1, 1) + timedelta(days=row.l)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return _EPOCH + timedelta(microseconds=row.l)
    return next(x for x in (row.l, row.d, row.s) if x is not None)


def number() -> Column:
    """The cell as a double."""
    return F.coalesce("d", F.col("l").cast("double"))


def unpivoted(df: DataFrame, names: list[str]) -> DataFrame:
    """(col, l, d, s), a row for each value of each column, null ones too; col is the place of the name."""
    cells = (F.struct(F.lit(i).alias("col"), *(c.alias(k) for k, c in cell(df, n).items())) for i, n in enumerate(names))
    return df.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def ranged(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df, written in order, with the number of the range that a row lies in and its place there."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_mid", F.monotonically_increasing_id())
    return storage.written(rows.withColumn("_range", F.shiftright("_mid", 33)), name)


def with_sums_before(rows: DataFrame, amounts: list[str], group: str = "col") -> DataFrame:
    """rows of ranged(), whose order starts with the group, with before_{amount}: the sum of an amount over all earlier rows
    of the group. A window runs inside each range of a group; a row for each such range gives what came before it."""
    inside = W.partitionBy(group, "_range").orderBy("_mid").rowsBetween(W.unboundedPreceding, -1)
    sums = rows.groupBy(group, "_range").agg(*(F.sum(a).alias(f"_sum_{a}") for a in amounts))
    earlier = W.partitionBy(group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    bases = sums.select(group, "_range", *(F.coalesce(F.sum(f"_sum_{a}").over(earlier), F.lit(0)).alias(f"_base_{a}") for a in amounts))
    bases = F.broadcast(bases) if bases.count() <= BROADCAST_ROWS else bases
    inner = rows.select("*", *(F.coalesce(F.sum(a).over(inside), F.lit(0)).alias(f"_in_{a}") for a in amounts))
    out = inner.join(bases, [group, "_range"])
    return out.select(*rows.columns, *((F.col(f"_base_{a}") + F.col(f"_in_{a}")).alias(f"before_{a}") for a in amounts))


def value_counts(df: DataFrame, names: list[str]) -> DataFrame:
    """(col, l, d, s, n) of the distinct values of all columns, nulls among them, written in order: one pass over df."""
    counts = unpivoted(df, names).groupBy("col", *KEY).agg(F.count("*").alias("n"))
    return ranged(counts, ["col", *KEY], "value_counts")


def most_frequent(counts: DataFrame, k: int) -> DataFrame:
    """(col, l, d, s, n, place) of the k most frequent values of each column, the lower value first of ties."""
    some = counts.where(F.coalesce(F.col("l").isNotNull(), F.lit(False)) | F.col("d").isNotNull() | F.col("s").isNotNull())
    order = [F.desc("n"), *KEY]
    in_range = some.withColumn("place", F.row_number().over(W.partitionBy("col", "_range").orderBy(*order))).where(F.col("place") <= k)
    # k rows at most of each range of a column
    return in_range.withColumn("place", F.row_number().over(W.partitionBy("col").orderBy(*order))).where(F.col("place") <= k).select("col", *KEY, "n", "place")


def values_at(counts: DataFrame, places: dict[int, list[int]]) -> dict[tuple[int, int], float]:
    """Numbers by (column, place in order, from 0) among the finite values of columns; places are those asked for."""
    asked = [(c, sorted(set(p))) for c, p in places.items() if p]
    if not asked:
        return {}
    spark = counts.sparkSession
    x = number()
    finite = counts.where(~F.isnan(x) & (F.abs(x) < float("inf")))
    wanted = F.broadcast(spark.createDataFrame(asked, "col int, places array<long>"))
    # the ranges of a column that hold a place, and what comes before them
    sums = finite.groupBy("col", "_range").agg(F.sum("n").alias("rows"))
    earlier = W.partitionBy("col").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    based = sums.withColumn("base", F.coalesce(F.sum("rows").over(earlier), F.lit(0))).join(wanted, "col")
    held = based.select("col", "_range", "base", F.filter("places", lambda p: (F.col("base") <= p) & (p < F.col("base") + F.col("rows"))).alias("places")).where(F.size("places") > 0)
    inside = W.partitionBy("col", "_range").orderBy("_mid").rowsBetween(W.unboundedPreceding, -1)
    rows = finite.join(F.broadcast(held), ["col", "_range"]).withColumn("at", F.col("base") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    found = rows.select("col", x.alias("x"), F.explode(F.filter("places", lambda p: (F.col("at") <= p) & (p < F.col("at") + F.col("n")))).alias("place"))
    return {(r.col, r.place): r.x for r in found.collect()}
