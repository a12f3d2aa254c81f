"""Discovery on data with planted causes: every cause must surface, and nothing else."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession

from .. import storage
from ..ingest import ingest
from ..operators.discover import discover
from ..session import Session, new_id


@dataclass(frozen=True)
class Case:
    """A seeded table, and the pairs of its columns that are related by construction. Columns are drawn in order."""

    name: str
    seed: int
    build: Callable[[np.random.Generator], dict]
    planted: frozenset = frozenset()


def _driver(r):
    x = r.normal(size=300)
    return {"driver": x, "outcome": 3 * x + r.normal(0, 0.5, 300)} | {f"noise_{i}": r.normal(size=300) for i in range(3)}


def _segment(r):
    k = r.integers(0, 3, 360)
    names = np.array(["alpha", "bravo", "charlie"])
    return {"segment": names[k], "metric": 3.0 * k + r.normal(0, 1, 360), "region": np.array(["north", "south"])[r.integers(0, 2, 360)], "extra": r.normal(size=360)}


def _link(r):
    region = r.integers(0, 3, 500)
    plan, moved = region.copy(), r.random(500) < 0.15
    plan[moved] = r.integers(0, 3, 500)[moved]
    return {
        "region": np.array(["north", "south", "east"])[region],
        "plan_type": np.array(["basic", "plus", "pro"])[plan],
        "channel": np.array(["web", "store"])[r.integers(0, 2, 500)],
        "score": r.normal(size=500),
    }


def _trap(r):
    x, t = r.normal(size=4000), r.normal(size=4000)
    return {
        "real_driver": x,
        "real_outcome": 2.5 * x + r.normal(0, 0.6, 4000),
        "trap_x": t,
        "trap_y": 0.08 * t + r.normal(0, 1, 4000),
        "noise_a": r.normal(size=4000),
        "noise_b": r.normal(size=4000),
    }


def _noise(r):
    return {f"signal_{i}": r.normal(size=250) for i in range(5)}


CASES = (
    Case("numeric_driver", 101, _driver, frozenset({frozenset({"driver", "outcome"})})),
    Case("segment_shift", 202, _segment, frozenset({frozenset({"segment", "metric"})})),
    Case("categorical_link", 303, _link, frozenset({frozenset({"region", "plan_type"})})),
    Case("tiny_effect_trap", 404, _trap, frozenset({frozenset({"real_driver", "real_outcome"})})),
    Case("pure_noise", 505, _noise),
)


@dataclass
class Score:
    name: str
    planted: int
    recovered: int
    false: int
    below_floor: int

    @property
    def passed(self) -> bool:
        return self.recovered == self.planted and not self.false


def run_case(spark: SparkSession, case: Case) -> Score:
    folder = f"{storage.scratch(spark)}/evals"
    path = f"{folder}/{new_id(case.name)}.csv"
    storage.write_text(spark, path, pd.DataFrame(case.build(np.random.default_rng(case.seed))).to_csv(index=False))
    session = Session(spark, folder)
    try:
        report = discover(session.table(ingest(session, path).dataset_id))
    finally:
        storage.delete(spark, path)
        storage.delete(spark, session.folder)
    pairs = [frozenset(d.columns) for d in report.discoveries]
    return Score(case.name, len(case.planted), len(case.planted & set(pairs)), sum(p not in case.planted for p in pairs), report.ledger.below_floor)


def rates(scores: list[Score]) -> dict[str, float]:
    """Recovery is 1 where nothing is planted, false discoveries are 0 where nothing surfaced."""
    planted, recovered, false = (sum(getattr(s, k) for s in scores) for k in ("planted", "recovered", "false"))
    return {"recovery": recovered / planted if planted else 1.0, "false_discovery": false / (recovered + false) if recovered + false else 0.0}


def scorecard(scores: list[Score]) -> str:
    lines = [f"{s.name}: {'pass' if s.passed else 'FAIL'} ({s.recovered}/{s.planted} recovered, {s.false} false, {s.below_floor} below the floor)" for s in scores]
    return "\n".join([*lines, *(f"{k} rate: {100 * v:.0f}%" for k, v in rates(scores).items())])
