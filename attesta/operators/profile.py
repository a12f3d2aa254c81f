"""Exact column profiles from one grouping of the values of all columns."""

from __future__ import annotations

import json
import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import storage
from ..functions.textsafe import cut, md_cell
from .coverage import Coverage, coverage_of, micros, parsed_time
from .frequencies import KEY, most_frequent, number, value_counts, value_of, values_at

TOP = 5
DATE_RATE = 0.95
QUANTILES = (0.05, 0.5, 0.95)
#: Date columns whose coverage is found at once.
PARALLEL = 4


@dataclass
class NumberStats:
    mean: float | None
    median: float | None
    std: float | None
    p5: float | None
    p95: float | None


@dataclass
class ColumnProfile:
    position: int
    original_name: str
    name: str
    type: str
    kind: str
    null_count: int
    null_rate: float
    distinct_count: int
    min_value: str | None
    max_value: str | None
    top_values: list[tuple[str, int]]
    numeric: NumberStats | None = None
    date_parse_rate: float | None = None
    coverage: Coverage | None = None


@dataclass
class ProfileReport:
    dataset_id: str
    name: str
    row_count: int
    columns: list[ColumnProfile]
    generated_at: str = field(default_factory=lambda: datetime.now(UTC).isoformat())
    date_rate_threshold: float = DATE_RATE

    @property
    def date_columns(self) -> list[str]:
        return [c.name for c in self.columns if is_date_candidate(c)]

    def to_json(self) -> str:
        return json.dumps(asdict(self) | {"date_columns": self.date_columns}, default=str)

    def to_markdown(self) -> str:
        number = lambda x: "—" if x is None else f"{x:.6g}"
        label = lambda c: md_cell(cut(c.original_name)) + ("" if c.name == c.original_name else f" (as `{c.name}`)")
        out = [
            f"# Profile: {md_cell(cut(self.name))}",
            "",
            f"- dataset_id: `{self.dataset_id}`",
            f"- rows: {self.row_count} | columns: {len(self.columns)}",
            f"- generated_at: {self.generated_at}",
            "",
            "## Columns",
            "",
            "| # | column | type | kind | nulls | distinct | min | max | top values |",
            "|---|---|---|---|---|---|---|---|---|",
        ]
        for c in self.columns:
            shown = lambda x: "—" if x is None else md_cell(x)
            tops = ", ".join(f"{md_cell(v)} ×{n}" for v, n in c.top_values) or "—"
            out.append(
                f"| {c.position} | {label(c)} | {c.type} | {c.kind} | {c.null_count} ({100 * c.null_rate:.1f}%) | {c.distinct_count} "
                f"| {shown(c.min_value)} | {shown(c.max_value)} | {tops} |"
            )
        numbers = [c for c in self.columns if c.numeric]
        if numbers:
            out += ["", "## Numeric", "", "| column | mean | median | std | p5 | p95 |", "|---|---|---|---|---|---|"]
            out += [f"| {label(c)} | " + " | ".join(number(x) for x in asdict(c.numeric).values()) + " |" for c in numbers]
        dates = [c for c in self.columns if c.coverage]
        if dates:
            out += ["", "## Time coverage", "", "| column | from | to | grain | gaps | examples |", "|---|---|---|---|---|---|"]
            for c in dates:
                v = c.coverage
                gaps = "—" if v.gaps is None else str(v.gaps)
                out.append(f"| {label(c)} | {v.first} | {v.last} | {v.grain or '—'} | {gaps} | {', '.join(v.examples) or '—'} |")
        return "\n".join(out)


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.NumericType):
        return "numeric"
    if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "temporal"
    return "boolean" if isinstance(t, T.BooleanType) else "text" if isinstance(t, T.StringType) else "other"


def is_date_candidate(c: ColumnProfile) -> bool:
    return c.kind == "temporal" or (c.date_parse_rate is not None and c.date_parse_rate >= DATE_RATE)


def summaries(counts: DataFrame, texts: list[int]) -> DataFrame:
    """A row for each column of value_counts(): rows, values, distinct ones, ends, the mean of finite numbers, and how many
    values of the columns in texts are dates."""
    some = F.col("l").isNotNull() | F.col("d").isNotNull() | F.col("s").isNotNull()
    key, x = F.struct(*KEY), number()
    finite = ~F.isnan(x) & (F.abs(x) < float("inf"))
    dates = F.when(F.col("col").isin(texts) & parsed_time(F.col("s"), T.StringType()).isNotNull(), F.col("n"))
    return counts.groupBy("col").agg(
        F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(some, F.col("n"))), F.lit(0)).alias("n"), F.count_if(some).alias("distinct"),
        F.min(F.when(some, key)).alias("low"), F.max(F.when(some, key)).alias("high"),
        F.coalesce(F.sum(F.when(finite, F.col("n"))), F.lit(0)).alias("finite"), F.sum(F.when(finite, x * F.col("n"))).alias("total"),
        F.max(F.when(finite, F.abs(x))).alias("largest"),
        F.coalesce(F.sum(dates), F.lit(0)).alias("dates"),
    )


def centred(counts: DataFrame, means: dict[int, float], largest: dict[int, float]) -> tuple[dict[int, float], dict[int, float]]:
    """(means, sums of squared distances from them) of finite numbers, whose largest sizes are given.

    A sum of doubles rounds as its partial sums grow, in the order of the tasks. So distances from the given means are
    added as whole numbers of a unit, 2^50 of which reach any of them, and small rests; their mean takes the error away.
    """
    if not means:
        return {}, {}
    unit = {i: math.ldexp(1.0, max(math.frexp(largest[i])[1] - 49, -1074)) if math.isfinite(m) and largest[i] < 2.0**1000 else None for i, m in means.items()}
    table = F.broadcast(counts.sparkSession.createDataFrame([(i, m, unit[i]) for i, m in means.items()], "col int, mean double, unit double"))
    x, away = number(), number() - F.col("mean")
    units = F.rint(away / F.col("unit"))
    rest = away - units * F.col("unit")
    near = counts.where(~F.isnan(x) & (F.abs(x) < float("inf"))).join(table, "col").groupBy("col")
    sums = near.agg(
        F.sum("n").alias("n"), F.sum(units.cast("decimal(17,0)") * F.col("n")).alias("units"), F.sum(rest * F.col("n")).alias("rest"),
        F.sum(F.col("n") * F.pow(away, F.lit(2))).alias("off"),
    ).collect()
    shift = {r.col: (Fraction(int(r.units)) * Fraction(unit[r.col]) + Fraction(r.rest)) / r.n if unit[r.col] else Fraction(0) for r in sums}
    near_means = {i: float(Fraction(m) + shift[i]) if unit[i] else m for i, m in means.items()}
    return near_means, {r.col: max(r.off - r.n * float(shift[r.col]) ** 2, 0.0) for r in sums}


def times_of(counts: DataFrame, i: int, kind: T.DataType) -> DataFrame:
    """Distinct instants of column i, as microseconds t."""
    own = counts.where(F.col("col") == i)
    if isinstance(kind, T.StringType):
        return own.select(micros(parsed_time(F.col("s"), kind)).alias("t")).where("t is not null").distinct()
    scale = 86_400_000_000 if isinstance(kind, T.DateType) else 1
    return own.where("l is not null").select((F.col("l") * scale).alias("t"))


def profile(df: DataFrame, dataset_id: str = "", name: str = "", original_names: list[str] | None = None) -> ProfileReport:
    """Profile of every column, from one table of value counts: df is read once, whatever the number of its columns.

    Only aggregates come to the driver.
    """
    kinds = [f.dataType for f in df.schema]
    texts = [i for i, k in enumerate(kinds) if kind_of(k) == "text"]
    counts = value_counts(df, df.columns)
    tops: dict[int, list[tuple[str, int]]] = {}
    text = lambda i, cell: None if (x := value_of(kinds[i], cell)) is None else cut("nan" if x != x else x)
    with ThreadPoolExecutor(2) as pool:
        asked = pool.submit(most_frequent(counts, TOP).orderBy("col", "place").collect)
        found = {r.col: r for r in summaries(counts, texts).collect()}
        for r in asked.result():
            tops.setdefault(r.col, []).append((text(r.col, r), r.n))
    finite = {i: found[i].finite for i, k in enumerate(kinds) if i in found and kind_of(k) == "numeric" and found[i].finite}
    at = {i: [q * (n - 1) for q in QUANTILES] for i, n in finite.items()}
    means = {i: found[i].total / n for i, n in finite.items()}
    with ThreadPoolExecutor(2) as pool:
        asked = pool.submit(centred, counts, means, {i: found[i].largest for i in means})
        placed = values_at(counts, {i: [f(a) for a in own for f in (math.floor, math.ceil)] for i, own in at.items()})
        means, off = asked.result()
    between = lambda i, a: placed[i, math.floor(a)] + (placed[i, math.ceil(a)] - placed[i, math.floor(a)]) * (a - math.floor(a))

    rows = max((r.rows for r in found.values()), default=0)
    columns = []
    for i, f in enumerate(df.schema):
        r, n = found.get(i), found[i].n if i in found else 0
        p = ColumnProfile(
            position=i,
            original_name=original_names[i] if original_names else f.name,
            name=f.name,
            type=f.dataType.simpleString(),
            kind=kind_of(f.dataType),
            null_count=rows - n,
            null_rate=(rows - n) / rows if rows else 0.0,
            distinct_count=r.distinct if r else 0,
            min_value=text(i, r.low) if r else None,
            max_value=text(i, r.high) if r else None,
            top_values=tops.get(i, []),
        )
        if p.kind == "numeric":
            low, middle, high = (between(i, a) for a in at[i]) if i in at else (None, None, None)
            std = math.sqrt(off[i] / (finite[i] - 1)) if finite.get(i, 0) > 1 else None
            p.numeric = NumberStats(means.get(i), middle, std, low, high)
        elif p.kind == "text" and n:
            p.date_parse_rate = r.dates / n
        columns.append(p)
    dated = [c for c in columns if is_date_candidate(c)]
    with ThreadPoolExecutor(PARALLEL) as pool:
        for c, v in zip(dated, pool.map(lambda c: coverage_of(times_of(counts, c.position, kinds[c.position])), dated), strict=True):
            c.coverage = v
    storage.discard(counts)
    return ProfileReport(dataset_id, name, rows, columns)
