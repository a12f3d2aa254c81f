"""Autonomous search for relations between columns, with control of false discoveries and a ledger of what was held back."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..execute import store
from ..functions.pvalues import benjamini_hochberg
from ..session import Session
from ..sources.names import quoted
from .frequencies import unpivoted
from .pairs import Outcome, number, outcomes

METRICS = {"spearman": "abs Spearman rho", "kruskal": "epsilon-squared", "chi_square": "Cramer's V"}


@dataclass(frozen=True)
class Config:
    fdr_alpha: float = 0.1
    max_findings: int = 5
    max_cardinality: int = 30
    min_observations: int = 20
    min_group: int = 5
    max_probes: int = 200
    floors: dict = field(default_factory=lambda: {"spearman": 0.3, "kruskal": 0.06, "chi_square": 0.1})


@dataclass
class Discovery:
    test: str
    columns: tuple[str, str]
    statistic: float
    p_value: float
    effect: float
    effect_label: str
    n: int
    headline: str
    artifact_id: str | None = None


@dataclass
class Ledger:
    """generated = probe_cap + insufficient + run, and run = not_significant + below_floor + finding_cap + surfaced."""

    generated: int = 0
    probe_cap: int = 0
    insufficient: int = 0
    run: int = 0
    not_significant: int = 0
    below_floor: int = 0
    finding_cap: int = 0
    surfaced: int = 0
    alpha: float = 0.1


@dataclass
class Judged:
    """A probe that was looked at: insufficient, not_significant, below_floor, finding_cap or surfaced."""

    test: str
    columns: tuple[str, str]
    outcome: Outcome
    fate: str


@dataclass
class Report:
    discoveries: list[Discovery]
    ledger: Ledger
    judged: list[Judged] = field(default_factory=list)


def classify(df: DataFrame, most: int) -> tuple[list[str], list[str]]:
    """(columns that are ranked, columns that group): numbers and times of two values or more, others of 2 to `most`.

    One aggregation tells of ranked columns whether they vary, and of the others about how many values they have; those
    that may have few enough are counted together in one more pass.
    """
    is_ranked = [isinstance(f.dataType, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)) for f in df.schema]
    asks = []
    for i, (f, r) in enumerate(zip(df.schema, is_ranked, strict=True)):
        x = number(df, f.name) if r else None
        asks.append((F.min(x) < F.max(x) if r else F.approx_count_distinct(_plain(df, f.name))).alias(f"d_{i}"))
    found = df.agg(*asks).first()
    ranked = [f.name for i, f in enumerate(df.schema) if is_ranked[i] and found[f"d_{i}"]]
    # far beyond the estimate's error
    maybe = [f.name for i, f in enumerate(df.schema) if not is_ranked[i] and found[f"d_{i}"] <= 2 * most + 10]
    if not maybe:
        return ranked, []
    values = unpivoted(df, maybe).where("l is not null or d is not null or s is not null").distinct()
    exact = {r.col: r["count"] for r in values.groupBy("col").count().collect()}
    return ranked, [n for i, n in enumerate(maybe) if 2 <= exact.get(i, 0) <= most]


def _plain(df: DataFrame, name: str) -> Column:
    c = F.col(quoted(name))
    return F.to_json(c) if isinstance(df.schema[name].dataType, T.MapType) else c


def probes(df: DataFrame, config: Config) -> list[tuple[str, str, str]]:
    ranked, grouping = classify(df, config.max_cardinality)
    return [
        *(("spearman", a, b) for a, b in combinations(ranked, 2)),
        *(("kruskal", a, b) for a, b in product(ranked, grouping)),
        *(("chi_square", a, b) for a, b in combinations(grouping, 2)),
    ]


def strength(effect: float) -> str:
    return "weak" if effect < 0.3 else "moderate" if effect < 0.5 else "strong"


def discover(df: DataFrame, config: Config | None = None, session: Session | None = None) -> Report:
    """Judges all probes together; what survives is ranked by effect and, with a session, gets an artifact each."""
    config = config or Config()
    generated = probes(df, config)
    chosen = generated[: config.max_probes]
    results = outcomes(df, chosen, min_rows=config.min_observations, min_group=config.min_group)
    run = [(p, o) for p, o in zip(chosen, results, strict=True) if o.statistic is not None]
    rejected = benjamini_hochberg([o.p_value for _, o in run], config.fdr_alpha)
    significant = [x for x, r in zip(run, rejected, strict=True) if r]
    large = [x for x in significant if x[1].effect >= config.floors[x[0][0]]]
    shown = sorted(large, key=lambda x: -x[1].effect)[: config.max_findings]
    found = []
    for (test, a, b), o in shown:
        line = f"{a} relates to {b}: {test}, {METRICS[test]}={o.effect:.3g}, p={o.p_value:.3g} (n={o.n})"
        found.append(Discovery(test, (a, b), o.statistic, o.p_value, o.effect, strength(o.effect), o.n, line))
    if session is not None:
        for d in found:
            row = session.spark.createDataFrame([(d.statistic, d.p_value, d.effect, d.n)], "statistic double, p_value double, effect_size double, n long")
            d.artifact_id = store(session, row.coalesce(1), "probe", f"{d.test}({', '.join(d.columns)})").artifact_id
    ledger = Ledger(
        generated=len(generated),
        probe_cap=len(generated) - len(chosen),
        insufficient=len(chosen) - len(run),
        run=len(run),
        not_significant=len(run) - len(significant),
        below_floor=len(significant) - len(large),
        finding_cap=len(large) - len(found),
        surfaced=len(found),
        alpha=config.fdr_alpha,
    )
    fates = dict.fromkeys(chosen, "insufficient")
    for name, some in (("not_significant", run), ("below_floor", significant), ("finding_cap", large), ("surfaced", shown)):
        fates |= {p: name for p, _ in some}
    judged = [Judged(p[0], p[1:], o, fates[p]) for p, o in zip(chosen, results, strict=True)]
    return Report(found, ledger, judged)
