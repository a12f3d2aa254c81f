"""Window frames that count groups of peers, with rows left out of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.names import quoted

EXCLUDE = ("no others", "current row", "group", "ties")


def groups_frame(df: DataFrame, partition: list[str], order: str, value: str, preceding: int, following: int, *, exclude: str = "no others") -> DataFrame:
    """df with frame_count, frame_sum, frame_min and frame_max of a value over GROUPS BETWEEN preceding AND following.

    Peers (rows of equal order in a partition) become one row with their count, sum, and ends with and without one row, so
    the frame over groups is a frame over rows of that table, from which the own row, its peers or both are taken away.
    Nulls of the value don't count; a null order is a group before all others. The table of groups is sorted by partition:
    a task holds the distinct order values of one.
    """
    if exclude not in EXCLUDE:
        raise ValueError(f"exclude is one of {', '.join(EXCLUDE)}")
    keys = [*(f"_p{i}" for i in range(len(partition))), "_o"]
    by = [*(F.col(quoted(p)).alias(k) for p, k in zip(partition, keys, strict=False)), F.col(quoted(order)).alias("_o")]
    rows = df.select(F.struct(*(F.col(quoted(c)) for c in df.columns)).alias("_row"), *by, F.col(quoted(value)).alias("_v"))
    counts = rows.groupBy(*keys, "_v").agg(F.count("_v").alias("n"))
    # a group's end without one of its rows: the same value if another row has it, else the next one
    inside = W.partitionBy(*keys).orderBy("_v")
    again = lambda f: F.when(F.col("n") > 1, F.col("_v")).otherwise(f("_v").over(inside))
    counts = counts.select("*", again(F.lead).alias("_up"), again(F.lag).alias("_down"))
    at_end = lambda pick, other: pick(F.when(F.col("_v").isNotNull(), F.struct(F.col("_v").alias("v"), F.col(other).alias("other"))))
    groups = counts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(F.col("_v") * F.col("n")).alias("total"), at_end(F.min, "_up").alias("low"), at_end(F.max, "_down").alias("high"))

    over = W.partitionBy(*keys[:-1]).orderBy("_o")
    spans = [(-preceding, following)] if exclude == "no others" else [(-preceding, -1), (1, following)]
    frames = [over.rowsBetween(first, last) for first, last in spans if first <= last]
    added = lambda c: reduce(lambda a, b: a + b, (F.coalesce(F.sum(c).over(w), F.lit(0)) for w in frames), F.lit(0))
    low, high = ([f(F.col(f"{c}.v")).over(w) for w in frames] for f, c in ((F.min, "low"), (F.max, "high")))
    held = T.ArrayType(rows.schema["_v"].dataType)
    framed = groups.select(
        *(F.col(k).alias(f"g{k}") for k in keys), added("n").alias("_n"), added("total").alias("_total"), F.array(*low).cast(held).alias("_low"), F.array(*high).cast(held).alias("_high"), F.col("n"), F.col("total"), F.col("low"), F.col("high")
    )
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"g{k}")) for k in keys))
    out = rows.join(framed, same)
    v, own = F.col("_v"), F.col("_v").isNotNull().cast("long")
    none = F.lit(None)
    count, total, least, most = {
        "no others": (F.lit(0), F.lit(0), none, none),
        "group": (F.lit(0), F.lit(0), none, none),
        "ties": (own, F.coalesce(v, F.lit(0)), v, v),
        "current row": (
            F.col("n") - own,
            F.coalesce("total", F.lit(0)) - F.coalesce(v, F.lit(0)),
            F.when(v == F.col("low.v"), F.col("low.other")).otherwise(F.col("low.v")),
            F.when(v == F.col("high.v"), F.col("high.other")).otherwise(F.col("high.v")),
        ),
    }[exclude]
    n = F.col("_n") + count
    ends = lambda f, held, mine: f(F.array_compact(F.concat(F.col(held), F.array(mine.cast(rows.schema["_v"].dataType)))))
    return out.select(
        "_row.*",
        n.cast("long").alias("frame_count"),
        F.when(n > 0, F.col("_total") + total).alias("frame_sum"),
        ends(F.array_min, "_low", least).alias("frame_min"),
        ends(F.array_max, "_high", most).alias("frame_max"),
    )
