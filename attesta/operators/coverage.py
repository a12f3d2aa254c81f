"""Time grain and gaps of a date column."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.names import quoted
from .ordered import with_previous

MONTH_FROM_SECONDS = 28 * 86_400
EXAMPLES = 5
EXAMPLE_SLOTS = 1_000_000
_UNITS = (("week", 604_800), ("day", 86_400), ("hour", 3_600), ("minute", 60), ("second", 1))


@dataclass
class Coverage:
    first: datetime
    last: datetime
    grain: str | None = None
    gaps: int | None = None
    examples: list[str] = field(default_factory=list)


def parsed_time(c: Column, kind: T.DataType) -> Column:
    """A date column as a zone-free timestamp; of text, what has year, month and day."""
    if isinstance(kind, T.StringType):
        shaped = c.rlike(r"^\s*\d{1,4}[-/]\d{1,2}[-/]\d{1,2}")
        return F.when(shaped, F.regexp_replace(c, "/", "-").try_cast("timestamp_ntz"))
    return c.cast("timestamp_ntz")


def micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp_ltz"))


def distinct_times(df: DataFrame, name: str) -> DataFrame:
    """Distinct instants of a column, as microseconds t."""
    c = parsed_time(F.col(quoted(name)), df.schema[name].dataType)
    return df.select(micros(c).alias("t")).where("t is not null").distinct()


def most_frequent_step(places: DataFrame, value: str) -> tuple[int, int] | None:
    """(step, how often) of neighbouring distinct values; the smaller of ties."""
    steps = with_previous(places, value, "_p").where("_p is not null").select((F.col(value) - F.col("_p")).alias("step"))
    r = steps.groupBy("step").count().orderBy(F.desc("count"), "step").first()
    return None if r is None else (r.step, r["count"])


def grid_gaps(places: DataFrame, value: str, step: int) -> tuple[int, list[int]]:
    """How many slots of the grid from the first to the last value are empty, and the first of them.

    Values off the grid are left out. Examples come from runs between neighbours; the grid is never built.
    """
    ends = places.agg(F.min(value).alias("a"), F.max(value).alias("b")).first()
    on = places.where((F.col(value) - ends.a) % step == 0)
    slots = (ends.b - ends.a) // step + 1
    gaps = slots - on.count()
    if not gaps or slots > EXAMPLE_SLOTS:
        return gaps, []
    holes = with_previous(on, value, "_p").where(F.col(value) - F.col("_p") > step).select(F.col("_p").alias("low"), F.col(value).alias("high"))
    examples = [low + step * k for low, high in holes.orderBy("low").limit(EXAMPLES).collect() for k in range(1, min(EXAMPLES, (high - low) // step - 1) + 1)]
    last = on.agg(F.max(value)).first()[0]
    examples += [last + step * k for k in range(1, min(EXAMPLES, (ends.b - last) // step) + 1)]
    return gaps, examples[:EXAMPLES]


def label_of(seconds: int) -> str:
    for name, size in _UNITS:
        if seconds % size == 0:
            n = seconds // size
            return name if n == 1 else f"{n}-{name}"
    return f"{seconds}-second"


def coverage(df: DataFrame, name: str) -> Coverage | None:
    """Coverage of a date column; None if it has no date."""
    return coverage_of(distinct_times(df, name))


def coverage_of(times: DataFrame) -> Coverage | None:
    """Coverage of distinct instants t in microseconds. Steps of four weeks and more count in calendar months."""
    times = times.persist()
    try:
        ends = times.agg(F.min("t").alias("a"), F.max("t").alias("b")).first()
        if ends.a is None:
            return None
        at = lambda us: datetime(1970, 1, 1) + timedelta(microseconds=us)
        out = Coverage(at(ends.a), at(ends.b))
        modal = most_frequent_step(times, "t")
        if modal is None:
            return out
        seconds = modal[0] / 1e6
        if seconds >= MONTH_FROM_SECONDS:
            stamp = F.timestamp_micros("t").cast("timestamp_ntz")
            months = times.select((F.year(stamp) * 12 + F.month(stamp) - 1).cast("long").alias("m")).distinct()
            step = most_frequent_step(months, "m")
            step = max(1, step[0] if step else 1)
            out.grain = {1: "month", 3: "quarter", 12: "year"}.get(step, f"{step}-month")
            out.gaps, missing = grid_gaps(months, "m", step)
            out.examples = [str(m // 12) if step % 12 == 0 else f"{m // 12:04d}-{m % 12 + 1:02d}" for m in missing]
        else:
            step = max(1, round(seconds))
            slots = times.select(F.bround((F.col("t") - ends.a) / 1e6).cast("long").alias("s")).distinct()
            out.grain = label_of(step)
            out.gaps, missing = grid_gaps(slots, "s", step)
            plain = step % 86_400 == 0
            for s in missing:
                when = at(ends.a + s * 1_000_000)
                out.examples.append(when.date().isoformat() if plain else when.isoformat(" "))
        return out
    finally:
        times.unpersist()
