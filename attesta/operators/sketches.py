"""Sketches of columns that are stored once and merged: distinct counts, quantiles and frequent values without a new scan.

A table of sketches has a row for each group and column. Sketches of new files, of days or of other groups are merged to
those of their union, so a dataset that grows is read once. Their size is bounded, whatever the rows.

With the default sizes a distinct count is off by 6.5 % at most (four standard errors of 1.6 %), the rank of a quantile by
1 % of the rows, and a frequent value's count by nothing where a column has at most 3,000 values, else by 1/1,000 of the
rows at most; the first two bounds hold but for one time in some thousands. Where all values are asked for, columns with
more are counted in their rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.names import quoted

#: Logarithm of the registers of a distinct count, size of a quantile sketch, and frequent values that are tracked.
REGISTERS, LEVELS, TRACKED = 12, 1024, 4096
DISTINCT_ERROR, RANK_ERROR, COUNT_ERROR = 4 * 1.04 / 2 ** (REGISTERS / 2), 0.01, 3.5 / TRACKED
#: Fewer values than this fill no table of tracked values, so their counts are exact.
EXACT_VALUES = TRACKED * 3 // 4
PARTS = ("rows", "non_null", "low", "high", "distinct", "quantiles", "frequent")


def _parts(df: DataFrame, name: str) -> Column:
    c = F.col(quoted(name))
    text = c.cast("string")
    numeric = isinstance(df.schema[name].dataType, T.NumericType)
    number = (F.when(~F.isnan(c.cast("double")), c.cast("double")) if numeric else F.lit(None)).cast("double")
    return F.struct(
        F.lit(name).alias("column"),
        F.count(F.lit(1)).alias("rows"),
        F.count(c).alias("non_null"),
        F.min(number).alias("low"),
        F.max(number).alias("high"),
        F.hll_sketch_agg(text, F.lit(REGISTERS)).alias("distinct"),
        F.kll_sketch_agg_double(number, F.lit(LEVELS)).alias("quantiles"),
        F.call_function("approx_top_k_accumulate", text, F.lit(TRACKED)).alias("frequent"),
    )


def sketches(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., column, parts): sketches of the columns in each group, from one pass over df.

    Values are counted by their text; NaN and values that are no numbers have no quantiles. Nulls are counted, but in no
    sketch. Partial sketches are made where the rows are, so a group that holds most rows is no hot key. No rows give one
    row a column without by, none with it. Columns may have any names but those that by has in common with the result.
    """
    keys = [F.col(quoted(b)) for b in by]
    one = df.groupBy(*keys).agg(F.array(*(_parts(df, c) for c in columns)).alias("_made"))
    one = one.select(*keys, F.explode("_made").alias("_one"))
    return one.select(*keys, "_one.column", *(f"_one.{p}" for p in PARTS))


def merged(tables: Sequence[DataFrame], by: Sequence[str] = ()) -> DataFrame:
    """The sketches of the union of what the tables are of, in groups of fewer columns or none."""
    keys = [F.col(quoted(b)) for b in by]
    return reduce(DataFrame.unionByName, [t.select(*keys, "column", *PARTS) for t in tables]).groupBy(*keys, "column").agg(
        F.sum("rows").alias("rows"),
        F.sum("non_null").alias("non_null"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.hll_union_agg("distinct").alias("distinct"),
        F.kll_merge_agg_double("quantiles", F.lit(LEVELS)).alias("quantiles"),
        F.call_function("approx_top_k_combine", F.col("frequent"), F.lit(TRACKED)).alias("frequent"),
    )


def estimates(table: DataFrame, fractions: Sequence[float] = (0.05, 0.5, 0.95), by: Sequence[str] = ()) -> DataFrame:
    """(by..., column, rows, non_null, low, high, n_distinct, quantiles): what the sketches say; quantiles are null where there are no numbers."""
    at = F.array(*(F.kll_sketch_get_quantile_double("quantiles", F.lit(float(p))) for p in fractions))
    return table.select(
        *(F.col(quoted(b)) for b in by),
        "column",
        "rows",
        "non_null",
        "low",
        "high",
        F.hll_sketch_estimate("distinct").alias("n_distinct"),
        F.when(F.col("low").isNotNull(), at).alias("quantiles"),
    )


def frequent_values(table: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    """(by..., column, value, count): the k most frequent values of each column, as text."""
    keys = [F.col(quoted(b)) for b in by]
    found = table.select(*keys, "column", F.explode(F.call_function("approx_top_k_estimate", F.col("frequent"), F.lit(k))).alias("_one"))
    return found.select(*keys, "column", F.col("_one.item").alias("value"), F.col("_one.count").alias("count"))


def all_values(df: DataFrame, columns: Sequence[str], table: DataFrame) -> DataFrame:
    """(column, value, count): every value of the columns of df, as text, and how many rows have it, exactly.

    table has the sketches of the columns, a row each. A column is taken from its sketch if that lost no value: its counts
    make up all rows that are not null, and the column surely has fewer values than are counted exactly. The others are
    counted in df by one shuffle of their distinct values, which may be any number.
    """
    kept = frequent_values(table, EXACT_VALUES).groupBy("column").agg(F.sum("count").alias("kept"))
    few = F.hll_sketch_estimate("distinct") * (1 + DISTINCT_ERROR) < EXACT_VALUES
    whole = F.coalesce("kept", F.lit(0)) == F.col("non_null")
    # a row for each column
    sure = {r[0] for r in table.join(kept, "column", "left").where(few & whole).select("column").collect()}
    out = frequent_values(table.where(F.col("column").isin(sorted(sure))), EXACT_VALUES)
    rest = [c for c in columns if c not in sure]
    if not rest:
        return out
    texts = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(quoted(c)).cast("string").alias("value")) for c in rest)))
    counts = df.select(texts.alias("_one")).select("_one.*").where("value is not null").groupBy("column", "value").agg(F.count("*").alias("count"))
    return out.unionByName(counts)
