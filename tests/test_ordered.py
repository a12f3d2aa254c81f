import random

import pytest

from attesta.operators import ordered


@pytest.mark.parametrize("n", [1, 5, 200])
def test_percentiles_like_the_aggregate(spark, n):
    """Groups with ties, one value, null keys, only nulls, negatives and infinities, over one range or many."""
    r = random.Random(4)
    rows = [(r.choice(["a", "b", None]), r.choice([None, 7.0, r.gauss(0, 50), float(r.randrange(-3, 3))])) for _ in range(2000)]
    rows += [("one", -2.5), ("none", None), ("two", 1.0), ("two", 2.0), *(("far", x) for x in (float("inf"), float("-inf"), 0.0))] + [("ties", 4.0)] * 500
    df = spark.createDataFrame(rows, "`k.x` string, `v.x` double").repartition(3)
    fractions = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = ordered.percentiles(df, "v.x", fractions, ["k.x"], n)
    assert got.columns == ["k.x", *(f"p{i}" for i in range(5))]
    want = df.selectExpr("`k.x` k", "`v.x` v").groupBy("k").agg(*(ordered.F.percentile("v", p) for p in fractions))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.collect())))
    assert ordered.percentiles(df.limit(0), "v.x", fractions, ["k.x"]).count() == 0


def test_quartiles_hold_no_group_in_one_task(spark):
    from attesta.plans import registry

    plan = registry.queries()["sql_percentiles"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan and "_range" in plan
