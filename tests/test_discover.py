import numpy as np
import pandas as pd
import pytest

from attesta.evals import CASES, rates, run_case, scorecard
from attesta.functions.pvalues import benjamini_hochberg, beta_regularized, chi2_tail, gamma_upper, spearman_tail
from attesta.operators import pairs
from attesta.operators.discover import Config, discover
from attesta.operators.ordered import running_total, with_previous
from attesta.operators.verify import add_finding, verify
from attesta.plans import discovery_sql
from attesta.session import Claim


def frame(spark, **cols):
    return spark.createDataFrame(pd.DataFrame(cols))


def test_tails_match_commons_math(spark):
    special = spark._jvm.org.apache.commons.math3.special
    for a, x in [(0.5, 0.1), (1, 1), (2.5, 7), (15, 3), (40, 90), (3, 200)]:
        assert gamma_upper(a, x) == pytest.approx(special.Gamma.regularizedGammaQ(float(a), float(x)), rel=1e-9)
    for a, b, x in [(0.5, 0.5, 0.2), (149, 0.5, 0.97), (10, 3, 0.4), (2, 9, 0.01)]:
        assert beta_regularized(a, b, x) == pytest.approx(special.Beta.regularizedBeta(float(x), float(a), float(b)), rel=1e-9)
    assert chi2_tail(6.0, 2) == pytest.approx(np.exp(-3.0))
    assert spearman_tail(1.0, 30) == 0.0 and 0 < spearman_tail(0.986523, 300) < 1e-230


def test_false_discovery_control():
    assert benjamini_hochberg([0.01, 0.04, 0.03, 0.9], 0.05) == [True, False, False, False]
    assert benjamini_hochberg([], 0.1) == []


def test_running_totals(spark):
    df = spark.createDataFrame([(float(i * i % 997), i % 7 + 1) for i in range(300)], "v double, n long").groupBy("v").agg({"n": "sum"}).toDF("v", "n")
    rows = sorted(df.collect())
    got = {r.v: r.before for r in running_total(df, "v", "n", "before").collect()}
    before = 0
    for v, n in rows:
        assert got[v] == before
        before += n
    prev = {r.v: r.p for r in with_previous(df.select("v"), "v", "p").collect()}
    assert [prev[v] for v, _ in rows] == [None, *(v for v, _ in rows[:-1])]


def plain_outcome(df, test, a, b, min_rows=20, min_group=5):
    """(n, statistic) of a probe over a pandas frame, from the definitions; no statistic if data are insufficient."""
    d = df[[a, b]].dropna()
    if test == "spearman":
        enough = len(d) >= min_rows and d[a].nunique() > 1 and d[b].nunique() > 1
        return len(d), d[a].rank().corr(d[b].rank()) if enough else None
    if test == "kruskal":
        d = d.groupby(b).filter(lambda g: len(g) >= min_group)
        n, groups = len(d), d[b].nunique()
        if groups < 2 or n < min_rows or d[a].nunique() < 2:
            return n, None
        r = d[a].rank()
        h = 12 / (n * (n + 1)) * (r.groupby(d[b]).sum() ** 2 / d.groupby(b).size()).sum() - 3 * (n + 1)
        t = d[a].value_counts()
        return n, h / (1 - (t**3 - t).sum() / (n**3 - n))
    o = pd.crosstab(d[a], d[b]).to_numpy(float)
    if min(o.shape, default=0) < 2 or len(d) < min_rows:
        return len(d), None
    e = o.sum(1, keepdims=True) @ o.sum(0, keepdims=True) / o.sum()
    gap = abs(o - e)
    return len(d), ((gap - (np.minimum(0.5, gap) if o.shape == (2, 2) else 0)) ** 2 / e).sum()


@pytest.fixture(scope="module")
def gappy():
    """Ties, nulls in different rows of each column, small and absent groups, a constant and an empty column."""
    r = np.random.default_rng(4)
    x = r.integers(0, 12, 400).astype(float)
    y = x + r.integers(0, 9, 400)
    z = np.round(r.normal(size=400), 1)
    y[r.random(400) < 0.2] = np.nan
    z[:30] = np.nan
    g = np.array(["a", "b", "c"], dtype=object)[r.integers(0, 3, 400)]
    g[:3], g[3:40] = "tiny", None
    h = np.where(r.random(400) < 0.3 + x / 30, "p", "q").astype(object)
    lone = np.array([None] * 395 + ["u"] * 5, dtype=object)
    return pd.DataFrame({"x": x, "y": y, "z": z, "k": 1.0, "void": np.nan, "g": g, "h": h, "lone": lone})


@pytest.mark.parametrize("most", [0, 120, 10**6])
def test_all_pairs_like_pandas(spark, gappy, monkeypatch, most):
    """All ways to look up ranks: joined by value and put together by row, some of them or all broadcast."""
    monkeypatch.setattr(pairs, "BROADCAST_ROWS", most)
    numbers, groups = ["x", "y", "z", "k", "void"], ["g", "h", "lone"]
    df = spark.createDataFrame(gappy.astype(object).where(gappy.notna(), None), "x double, y double, z double, k double, void double, g string, h string, lone string").repartition(3)
    probes = discovery_sql.probes_of(numbers, groups)
    for p, o in zip(probes, pairs.outcomes(df, probes), strict=True):
        n, want = plain_outcome(gappy, *p)
        assert (o.n, o.statistic) == (n, None if want is None else pytest.approx(want, abs=1e-9)), p
    assert pairs.outcomes(df.limit(0), probes) == [pairs.Outcome(0)] * len(probes)


def test_names_of_any_kind(spark):
    df = spark.range(60).selectExpr("id `a.b`", "id * id `c``d`", "if(id % 3 = 0, 'x', 'y') `e f`", "if(id > 30, 'u', 'v') g")
    found = discover(df).judged
    assert len(found) == 6 and found[0].outcome.statistic == pytest.approx(1) and found[0].columns == ("a.b", "c`d")


def test_scans_do_not_grow_with_pairs(spark, tmp_path):
    """Six numbers and three groups: 36 probes from one read of the table."""
    spark.range(500).selectExpr(*(f"(id * {k + 3}) % 101 n{k}" for k in range(6)), *(f"cast(id % {k + 2} as string) g{k}" for k in range(3))).write.parquet(str(tmp_path / "t"))
    reads = []
    real = pairs.storage.written
    df = spark.read.parquet(str(tmp_path / "t"))
    with pytest.MonkeyPatch.context() as m:
        m.setattr(pairs.storage, "written", lambda d, name: reads.append((name, str(tmp_path) in d._jdf.queryExecution().optimizedPlan().toString() or any(str(tmp_path) in f for f in d.inputFiles()))) or real(d, name))
        assert len(pairs.outcomes(df, discovery_sql.probes_of([f"n{k}" for k in range(6)], [f"g{k}" for k in range(3)]))) == 36
    assert [n for n, source in reads if source] == ["pair_cells"]


def test_too_many_groups_are_refused(spark, monkeypatch):
    monkeypatch.setattr(pairs, "MOST_CELLS", 50)
    with pytest.raises(ValueError, match="too many values"):
        pairs.outcomes(spark.range(100).selectExpr("double(id) x", "string(id) g"), [("kruskal", "x", "g")])


def test_surfaced_and_silent(spark, session):
    r = np.random.default_rng(42)
    x = r.normal(size=300)
    g = r.integers(0, 3, 300)
    df = frame(spark, x=x, y=2 * x + r.normal(0, 0.3, 300), grp=np.array(["g0", "g1", "g2"])[g], val=3.0 * g + r.normal(size=300))
    report = discover(df, session=session)
    tests = [d.test for d in report.discoveries]
    assert {"spearman", "kruskal"} <= set(tests)
    assert [d.effect for d in report.discoveries] == sorted((d.effect for d in report.discoveries), reverse=True)
    d = report.discoveries[0]
    f = add_finding(session, "related", [Claim("effect", d.artifact_id, "effect_size", d.effect)])
    assert verify(session, f).verified
    noise = discover(frame(spark, **{f"n{i}": np.random.default_rng(7 + i).normal(size=250) for i in range(4)}))
    assert noise.ledger.run == 6 and noise.ledger.surfaced == 0


def test_ledger(spark):
    r = np.random.default_rng(9)
    df = frame(spark, **{f"c{i}": r.normal(size=120) for i in range(6)})
    ledger = discover(df, Config(max_probes=10)).ledger
    assert (ledger.generated, ledger.probe_cap) == (15, 5)
    assert ledger.generated == ledger.probe_cap + ledger.insufficient + ledger.run
    assert ledger.run == ledger.not_significant + ledger.below_floor + ledger.finding_cap + ledger.surfaced
    tiny = discover(frame(spark, a=r.normal(size=10), b=r.normal(size=10), c=list("xyxyxyxyxy"), d=list("uuuuuvvvvv"))).ledger
    assert tiny.generated > 0 and tiny.run == 0
    assert discover(frame(spark, k=[1.0] * 200, x=r.normal(size=200))).ledger.generated == 0


def test_planted_causes(spark):
    scores = [run_case(spark, c) for c in CASES]
    assert all(s.passed for s in scores), scorecard(scores)
    assert rates(scores) == {"recovery": 1.0, "false_discovery": 0.0}
    assert next(s for s in scores if s.name == "tiny_effect_trap").below_floor >= 1
