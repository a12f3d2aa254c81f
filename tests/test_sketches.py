import random

import pytest

from attesta.operators import sketches as sk


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(5)
    data = [(k % 7, None if k % 50 == 0 else r.gauss(0, 1), f"v{min(int(r.expovariate(0.05)), 200)}", float("nan") if k % 3 else 1.0, None) for k in range(20_000)]
    return spark.createDataFrame(data, "day int, `a.b` double, `c``d` string, n double, none string").repartition(6)


COLUMNS = ["a.b", "c`d", "n", "none"]


def test_merge_equals_whole_within_bounds(spark, rows, tmp_path):
    for part in ("day < 3", "day >= 3"):
        sk.sketches(rows.where(part), COLUMNS, by=["day"]).write.mode("append").parquet(str(tmp_path / "s"))
    stored = spark.read.parquet(str(tmp_path / "s"))
    assert stored.count() == 7 * len(COLUMNS)
    whole = {r.column: r for r in sk.estimates(sk.merged([sk.sketches(rows, COLUMNS)])).collect()}
    merged = {r.column: r for r in sk.estimates(sk.merged([stored])).collect()}
    values = rows.toPandas()
    for c in COLUMNS:
        w, m, v = whole[c], merged[c], values[c].dropna()
        assert (w.rows, w.n_distinct, w.low, w.high) == (m.rows, m.n_distinct, m.low, m.high) and m.rows == 20_000
        assert abs(m.n_distinct - v.nunique()) <= sk.DISTINCT_ERROR * v.nunique() + (c == "n")
    assert merged["none"].non_null == 0 and merged["none"].quantiles is None and merged["c`d"].quantiles is None
    assert merged["n"].non_null == 20_000 and merged["n"].quantiles == [1.0, 1.0, 1.0]
    numbers = values["a.b"].dropna()
    for p, q in zip((0.05, 0.5, 0.95), merged["a.b"].quantiles, strict=True):
        assert (numbers < q).mean() - sk.RANK_ERROR <= p <= (numbers <= q).mean() + sk.RANK_ERROR


def test_frequent_values(spark, rows):
    parts = [sk.sketches(rows.where("day < 3"), ["c`d"], by=["day"]), sk.sketches(rows.where("day >= 3"), ["c`d"], by=["day"])]
    got = {r.value: r["count"] for r in sk.frequent_values(sk.merged(parts), 1000).collect()}
    assert got == rows.toPandas()["c`d"].value_counts().to_dict()


def test_many_values_and_no_rows(spark):
    df = spark.range(60_000).selectExpr("if(id % 10 = 0, 'hot', concat('v', id)) v")
    best = sk.frequent_values(sk.sketches(df, ["v"]), 1).first()
    assert best.value == "hot" and abs(best["count"] - 6000) <= sk.COUNT_ERROR * 60_000
    none = sk.sketches(df.limit(0), ["v"])
    assert sk.estimates(none).select("rows", "n_distinct").collect() == [(0, 0)] and sk.frequent_values(none, 3).count() == 0
    assert sk.sketches(df.limit(0).selectExpr("v", "1 g"), ["v"], by=["g"]).count() == 0


def test_all_values_of_columns_with_many(spark):
    """More values than a sketch holds, all as frequent or not, beside columns that the sketch counts; null counts nowhere."""
    df = spark.range(40_000).selectExpr("id % 4999 `many.x`", "if(id % 3 = 0, null, concat('v', id)) once", "id % 5 few", "id % 3050 near", "cast(null as string) none")
    columns = ["many.x", "once", "few", "near", "none"]
    got = sorted(map(tuple, sk.all_values(df, columns, sk.merged([sk.sketches(df, columns, by=["few"])])).collect()))
    values = df.toPandas()
    assert got == sorted((c, str(v), n) for c in columns for v, n in values[c].dropna().value_counts().items())
    assert sk.all_values(df.limit(0), columns, sk.sketches(df.limit(0), columns)).count() == 0
