"""Rank correlations, Kruskal-Wallis and chi-squared statistics of many pairs of columns at once.

The table is read once, to a narrow copy of the columns that are asked for. One pass over it counts how many rows each
pair has and how large groups are, one makes a table of the distinct values of all ranked columns with their ranks, and
one adds up the products of ranks of all pairs (their Gram matrix) and the rank sums of all groups. So the passes do not
grow with the pairs.

A pair is judged on the rows where both columns have a value, and groups that are too small don't take part, so a column
may have other ranks in each pair. Its conditions are those sets of rows that differ from all rows with a value: in a
table without nulls and small groups there are none. Counts and ranks of a value are held for each condition.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import storage
from ..functions.pvalues import chi2_tail, spearman_tail
from ..sources.names import quoted
from .frequencies import ranged, with_sums_before

MIN_ROWS = 20
MIN_GROUP = 5
#: Distinct values of ranked columns, in all, that are broadcast.
BROADCAST_ROWS = 200_000
#: Rows of group sizes and cells of contingency tables, in all, that may come to the driver.
MOST_CELLS = 1_000_000

Probe = tuple[str, str, str]


@dataclass(frozen=True)
class Outcome:
    """What a test found; no statistic if the data are insufficient. groups: of Kruskal-Wallis; dof: of chi-squared tails."""

    n: int
    statistic: float | None = None
    p_value: float | None = None
    effect: float | None = None
    dof: int | None = None


def number(df: DataFrame, name: str) -> Column:
    """A column as double; dates and timestamps by their place in time, NaN as null."""
    kind, c = df.schema[name].dataType, F.col(quoted(name))
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp_ltz")).cast("double")
    x = c.cast("double")
    return F.when(~F.isnan(x), x)


def _group(df: DataFrame, name: str) -> Column:
    c = F.col(quoted(name))
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        c = F.when(~F.isnan(c), c)
    return F.to_json(c) if isinstance(df.schema[name].dataType, (T.MapType, T.ArrayType, T.StructType)) else c.cast("string")


def _x(i: int) -> Column:
    return F.col(f"x_{i}")


def _g(i: int) -> Column:
    return F.col(f"g_{i}")


def _tally(cells: DataFrame, probes: list[Probe], n_ranked: int) -> tuple[list[int], list[dict[tuple[str | None, str | None], int]]]:
    """(values of each ranked column, for each probe its complete rows by group or cell).

    Numbers that lack no value have as many rows as each other; pairs of others are counted together, and so are groups.
    """
    size, whole = [], []
    if n_ranked:
        rows, *size = cells.agg(F.count("*"), *(F.count(_x(i)) for i in range(n_ranked))).first()
        whole = [n == rows for n in size]
    found: list[dict] = [{} for _ in probes]
    both, entries = [], []
    none = F.lit(None).cast("string")
    entry = lambda p, ok, x, y=none: F.when(ok, F.struct(F.lit(p).alias("p"), x.alias("x"), y.alias("y")))
    for p, (test, a, b) in enumerate(probes):
        if test == "spearman":
            if whole[a] or whole[b]:
                found[p] = {(None, None): size[b] if whole[a] else size[a]}
            else:
                both.append(F.count_if(_x(a).isNotNull() & _x(b).isNotNull()).alias(f"p_{p}"))
        elif test == "kruskal":
            entries.append(entry(p, _x(a).isNotNull() & _g(b).isNotNull(), _g(b)))
        else:
            entries.append(entry(p, _g(a).isNotNull() & _g(b).isNotNull(), _g(a), _g(b)))
    if both:
        for name, n in cells.agg(*both).first().asDict().items():
            found[int(name[2:])] = {(None, None): n}
    if entries:
        counts = cells.select(F.explode(F.array_compact(F.array(*entries))).alias("e")).groupBy("e.p", "e.x", "e.y").agg(F.count("*").alias("n"))
        rows = counts.limit(MOST_CELLS + 1).collect()
        if len(rows) > MOST_CELLS:
            raise ValueError(f"grouping columns have too many values: more than {MOST_CELLS} groups and cells in all")
        for r in rows:
            found[r.p][r.x, r.y] = r.n
    return size, found


def _ranks(cells: DataFrame, conditions: list[list[Column]]) -> DataFrame:
    """(col, v, w_0, ..., before_w_0, ...) of the distinct values of ranked columns: rows under each condition, and before."""
    most = max(map(len, conditions))
    flags = lambda own: F.array(*(f.cast("long") for f in own), *[F.lit(0).cast("long")] * (most - len(own)))
    each = F.array(*(F.struct(F.lit(i).alias("col"), _x(i).alias("v"), flags(own).alias("w")) for i, own in enumerate(conditions)))
    values = cells.select(F.explode(each).alias("e")).select("e.*").where("v is not null")
    sums = values.groupBy("col", "v").agg(*(F.sum(F.get("w", F.lit(k))).alias(f"w_{k}") for k in range(most)))
    return with_sums_before(ranged(sums, ["col", "v"], "pair_values"), [f"w_{k}" for k in range(most)])


def _with_ranks(cells: DataFrame, ranks: DataFrame, distinct: list[int], groups: list[str]) -> DataFrame:
    """(r_0, ..., g_0, ...): the arrays of centred ranks of each row's values, and its groups.

    Columns of few distinct values, in all, are looked up where the rows are. Of the others, one is joined by its value;
    the values of more are joined at once, and a row's are put together again by its number.
    """
    few, held = [], 0
    for i in sorted(range(len(distinct)), key=lambda i: distinct[i]):
        held += distinct[i]
        if held <= BROADCAST_ROWS:
            few.append(i)
    many = [i for i in range(len(distinct)) if i not in few]
    of = lambda i: ranks.where(F.col("col") == i).select(F.col("v").alias(f"x_{i}"), F.col("d").alias(f"r_{i}"))
    for i in few:
        cells = cells.join(F.broadcast(of(i)), f"x_{i}", "left")
    kept = [*(f"r_{i}" for i in few), *groups]
    if len(many) <= 1:
        for i in many:
            cells = cells.join(of(i), f"x_{i}", "left")
        return cells.select(*(f"r_{i}" for i in range(len(distinct))), *groups)
    each = F.array(*(F.struct(F.lit(i).alias("col"), _x(i).alias("v")) for i in many))
    values = cells.select("row", F.explode(each).alias("e")).select("row", "e.*").where("v is not null")
    parts = values.join(ranks.select("col", "v", "d"), ["col", "v"]).select("row", "col", "d")
    if kept:
        parts = parts.unionByName(cells.select("row", F.lit(-1).alias("col"), *kept), allowMissingColumns=True)
    by_row = [F.first(F.when(F.col("col") == i, F.col("d")), ignorenulls=True).alias(f"r_{i}") for i in many]
    return parts.groupBy("row").agg(*by_row, *(F.first(k, ignorenulls=True).alias(k) for k in kept)).drop("row")


def outcomes(df: DataFrame, probes: list[Probe], *, min_rows: int = MIN_ROWS, min_group: int = MIN_GROUP) -> list[Outcome]:
    """The outcome of each probe: ("spearman", number, number), ("kruskal", number, group) or ("chi_square", group, group).

    Rows where either column of a pair is null or NaN play no role in it. Grouping columns must have few values.
    """
    if not probes:
        return []
    ranked = list(dict.fromkeys(c for test, a, b in probes for c in ((a, b) if test == "spearman" else (a,) if test == "kruskal" else ())))
    grouping = list(dict.fromkeys(c for test, a, b in probes for c in ((b,) if test == "kruskal" else (a, b) if test == "chi_square" else ())))
    at = {n: i for i, n in enumerate(ranked)}
    place = lambda n, test, right: grouping.index(n) if test == "chi_square" or right and test == "kruskal" else at[n]
    asked = [(test, place(a, test, False), place(b, test, True)) for test, a, b in probes]
    groups = [f"g_{i}" for i in range(len(grouping))]
    columns = [*(number(df, n).alias(f"x_{i}") for i, n in enumerate(ranked)), *(_group(df, n).alias(f"g_{i}") for i, n in enumerate(grouping))]
    cells = df.select(*columns)
    if ranked:
        cells = storage.written(cells.withColumn("row", F.monotonically_increasing_id()), "pair_cells")
    size, of_probe = _tally(cells, asked, len(ranked))

    # for each ranked column its conditions, and how many rows each has; for each probe the condition that it is judged under
    conditions = [[F.lit(True)] for _ in ranked]
    totals = [[size[i]] for i in range(len(ranked))]
    under: dict[tuple[int, int], int] = {}
    retained: dict[int, dict[str, int]] = {}
    known: dict[tuple[int, str, int], int] = {}
    for p, (test, a, b) in enumerate(asked):
        found = of_probe[p]
        if test == "spearman":
            n = sum(found.values())
            for mine, other in ((a, b), (b, a)):
                key = mine, "x", other
                if n < size[mine] and key not in known:
                    known[key] = len(conditions[mine])
                    conditions[mine].append(_x(other).isNotNull())
                    totals[mine].append(n)
                under[p, mine] = known.get(key, 0)
        elif test == "kruskal":
            retained[p] = {x: n for (x, _), n in found.items() if n >= min_group}
            n = sum(retained[p].values())
            under[p, a] = 0
            if n < size[a]:
                under[p, a] = len(conditions[a])
                conditions[a].append(F.coalesce(_g(b).isin(list(retained[p])), F.lit(False)) if retained[p] else F.lit(False))
                totals[a].append(n)

    spread: dict[tuple[int, int], tuple[float, float]] = {}
    sums: dict[tuple[int, str | None], float] = {}
    if ranked:
        most = max(map(len, conditions))
        total = F.array(*(F.array(*(F.lit(float(t)) for t in [*own_totals, *[0] * (most - len(own_totals))])) for own_totals in totals))
        # a value's mean place among the n rows of a condition, less the middle (n + 1) / 2
        middle = lambda k: F.col(f"before_w_{k}") + (F.col(f"w_{k}") - F.get(F.get(total, F.col("col")), F.lit(k))) / 2
        ranks = _ranks(cells, conditions).select("col", "v", F.array(*(middle(k) for k in range(most))).alias("d"), *(f"w_{k}" for k in range(most)))
        ranks = storage.written(ranks, "pair_ranks")
        cube = lambda w: w * w * w - w
        each = [f for k in range(most) for f in (F.sum(F.col(f"w_{k}") * F.pow(F.get("d", F.lit(k)), F.lit(2))).alias(f"s_{k}"), F.sum(cube(F.col(f"w_{k}").cast("double"))).alias(f"t_{k}"))]
        distinct = [0] * len(ranked)
        for r in ranks.groupBy("col").agg(F.count("*").alias("distinct"), *each).collect():
            distinct[r.col] = r.distinct
            for k in range(most):
                spread[r.col, k] = r[f"s_{k}"], r[f"t_{k}"]
        rows = _with_ranks(cells, ranks, distinct, groups)
        entries = []
        for p, (test, a, b) in enumerate(asked):
            if test == "chi_square":
                continue
            mine = F.get(f"r_{a}", F.lit(under[p, a]))
            if test == "spearman":
                both = mine * F.get(f"r_{b}", F.lit(under[p, b]))
                entries.append(F.when(both.isNotNull(), F.struct(F.lit(p).alias("p"), F.lit(None).cast("string").alias("x"), both.alias("v"))))
            elif retained[p]:
                ok = mine.isNotNull() & _g(b).isin(list(retained[p]))
                entries.append(F.when(ok, F.struct(F.lit(p).alias("p"), _g(b).alias("x"), mine.alias("v"))))
        if entries:
            met = rows.select(F.explode(F.array_compact(F.array(*entries))).alias("e")).groupBy("e.p", "e.x").agg(F.sum("e.v").alias("v"))
            sums = {(r.p, r.x): r.v for r in met.collect()}
        storage.discard(ranks)
    storage.discard(cells)

    out = []
    for p, (test, a, b) in enumerate(asked):
        if test == "spearman":
            n = sum(of_probe[p].values())
            out.append(_spearman(n, sums.get((p, None), 0.0), spread.get((a, under[p, a]), (0.0, 0.0))[0], spread.get((b, under[p, b]), (0.0, 0.0))[0], min_rows))
        elif test == "kruskal":
            out.append(_kruskal({x: (n, sums.get((p, x), 0.0)) for x, n in retained[p].items()}, spread.get((a, under[p, a]), (0.0, 0.0))[1], min_rows))
        else:
            out.append(_chi_square(of_probe[p], min_rows))
    return out


def _finite(n: int, statistic: float, p_value: float, effect: float, dof: int | None = None) -> Outcome:
    """An outcome, insufficient if a number of it isn't finite."""
    return Outcome(n, statistic, p_value, effect, dof) if all(map(math.isfinite, (statistic, p_value, effect))) else Outcome(n)


def _spearman(n: int, ab: float, aa: float, bb: float, min_rows: int) -> Outcome:
    if n < min_rows or aa <= 0 or bb <= 0:
        return Outcome(n)
    rho = max(-1.0, min(1.0, ab / math.sqrt(aa) / math.sqrt(bb)))
    return _finite(n, rho, spearman_tail(rho, n), abs(rho))


def _kruskal(groups: dict[str, tuple[int, float]], ties: float, min_rows: int) -> Outcome:
    """From the size and the sum of centred ranks of each group: tie-corrected H and epsilon-squared."""
    n, k = sum(size for size, _ in groups.values()), len(groups)
    corrected = 1 - ties / (float(n) ** 3 - n) if n > 1 else 0.0
    if k < 2 or n < min_rows or corrected <= 0:
        return Outcome(n)
    h = 12 / (n * (n + 1)) * math.fsum(s * s / size for size, s in groups.values()) / corrected
    return _finite(n, h, chi2_tail(h, k - 1), max(0.0, (h - k + 1) / (n - k)) if n > k else math.inf, k - 1)


def _chi_square(cells: dict[tuple[str, str], int], min_rows: int) -> Outcome:
    """From the counts of cells: chi-squared, with Yates' correction of 2 x 2 tables, and Cramer's V; empty cells count."""
    n = sum(cells.values())
    rows, cols = Counter(), Counter()
    for (x, y), o in cells.items():
        rows[x] += o
        cols[y] += o
    least = min(len(rows), len(cols))
    if least < 2 or n < min_rows:
        return Outcome(n)
    if len(rows) == len(cols) == 2:
        gaps = ((abs(cells.get((x, y), 0) - r * c / n), r * c / n) for x, r in rows.items() for y, c in cols.items())
        chi2 = math.fsum((d - min(0.5, d)) ** 2 / e for d, e in gaps)
    else:
        # the sum over all cells is n * (sum of o * o / (row * column) - 1), in which empty ones have no part
        chi2 = max(0.0, n * (math.fsum(o * o / (rows[x] * cols[y]) for (x, y), o in cells.items()) - 1))
    dof = (len(rows) - 1) * (len(cols) - 1)
    return _finite(n, chi2, chi2_tail(chi2, dof), math.sqrt(chi2 / (n * (least - 1))), dof)
