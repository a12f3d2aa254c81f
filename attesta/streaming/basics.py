"""Column basics of an unbounded table, kept up to date by a streaming aggregation in complete mode."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.names import quoted


def stream_basics(df: DataFrame) -> DataFrame:
    """(position, column, rows, non_null, min_value, max_value), one row a column; state is one row a column too."""
    cells = F.array(*(F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.col(quoted(c)).cast("string").alias("value")) for i, c in enumerate(df.columns)))
    long = df.select(F.explode(cells).alias("cell")).select("cell.*")
    return long.groupBy("position", "column").agg(F.count("*").alias("rows"), F.count("value").alias("non_null"), F.min("value").alias("min_value"), F.max("value").alias("max_value"))
