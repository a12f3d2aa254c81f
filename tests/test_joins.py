import random
from datetime import datetime, timedelta

import duckdb
import pytest

from attesta.operators import joins
from attesta.operators.frames import EXCLUDE, groups_frame


def pairs(df):
    return sorted(((r.left.i, r.right.i) for r in df.collect()))


@pytest.fixture(scope="module")
def spans():
    """Long and short intervals, points, equal ones, shared ends, and a bin that a third of all rows share."""
    r = random.Random(6)

    def some(n):
        out = []
        for i in range(n):
            low = r.choice([r.uniform(-100, 100), float(r.randrange(-20, 20)), 5.0])
            out.append((i, low, low + r.choice([0.0, 0.5, r.uniform(0, 3), r.uniform(0, 300), 2.0 ** r.randrange(-3, 6)])))
        return out + [(n + k, 5.0, 5.25) for k in range(n // 3)]

    return some(300), some(200)


@pytest.mark.parametrize("per_bin", [7, 10**6])
def test_overlaps_like_theta_join(spark, spans, per_bin):
    a, b = spans
    odd = [(9000, None, 5.0), (9001, float("nan"), 5.0), (9002, 6.0, 4.0), (9003, float("-inf"), float("inf"))]
    left, right = (spark.createDataFrame([*x, *odd], "i int, low double, high double").repartition(3) for x in (a, b))
    got = joins.overlap_join(left, right, ("low", "high"), ("low", "high"), rows_per_bin=per_bin)
    assert pairs(got) == sorted((x[0], y[0]) for x in a for y in b if x[1] <= y[2] and y[1] <= x[2])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString() and "Cross" not in plan


def test_points_in_spans_of_dates(spark):
    left = spark.sql("SELECT id i, date_add(date'2024-01-01', cast(id as int)) d FROM range(60)")
    right = spark.sql("SELECT id i, date_add(date'2024-01-01', cast(id * 7 as int)) f, date_add(date'2024-01-01', cast(id * 7 + id % 3 as int)) t FROM range(10)")
    assert pairs(joins.overlap_join(left, right, ("d", "d"), ("f", "t"))) == [(i, k) for i in range(60) for k in range(10) if 7 * k <= i <= 7 * k + k % 3]
    assert joins.overlap_join(left.limit(0), right, ("d", "d"), ("f", "t")).count() == 0


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_asof_like_a_loop(spark, partitions):
    """Ties, nulls, keys without a row before, and one key that most rows have, over several ranges."""
    r = random.Random(1)
    t = lambda k: datetime(2024, 1, 1) + timedelta(minutes=k)
    key = lambda: r.choice(["hot"] * 5 + ["a", "b", "c", None])
    left = [(i, key(), r.choice([None, *map(t, range(300))])) for i in range(700)]
    right = [(i, key(), r.choice([None, *map(t, range(20, 300))])) for i in range(150)] + [(1000, "hot", t(0)), (1001, "hot", t(0))]
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        a, b = spark.createDataFrame(left, "i int, k string, t timestamp_ntz"), spark.createDataFrame(right, "i int, k string, t timestamp_ntz")
        got = sorted((x.left.i, x.right and x.right.i) for x in joins.asof_join(a, b, "t", "t", by=(("k", "k"),)).collect())
        want = [(i, max(((u, j) for j, q, u in right if q == k and u and u <= s), default=(0, None))[1] if s and k else None) for i, k, s in left]
        assert got == sorted(want)
        free = sorted((x.left.i, x.right.i) for x in joins.asof_join(a, b, "t", "t", how="inner").collect())
        best = {i: max(((u, j) for j, _, u in right if u and u <= s), default=None) if s else None for i, _, s in left}
        assert [i for i, _ in free] == sorted(i for i, x in best.items() if x)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_positional(spark):
    a, b = spark.range(25).repartitionByRange(4, "id"), spark.range(100, 110).repartitionByRange(3, "id")
    rows = sorted(((r.left and r.left.id, r.right and r.right.id) for r in joins.positional_join(a, b).collect()))[:10]
    assert rows == [(k, 100 + k) for k in range(10)] and joins.positional_join(a, b).count() == 25


@pytest.mark.parametrize("exclude", EXCLUDE)
def test_groups_frames_like_sql(spark, exclude):
    r = random.Random(3)
    rows = [(i, r.choice("ab"), r.choice([None, 1, 2, 2, 3, 5, 8]), r.choice([None, *range(9)])) for i in range(120)]
    df = spark.createDataFrame(rows, "i long, p string, o long, v long")
    c = duckdb.connect()
    c.execute("CREATE TABLE t (i BIGINT, p VARCHAR, o BIGINT, v BIGINT)")
    c.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", rows)
    for before, after in ((1, 1), (0, 2), (2, 0), (0, 0)):
        w = f"OVER (PARTITION BY p ORDER BY o NULLS FIRST GROUPS BETWEEN {before} PRECEDING AND {after} FOLLOWING EXCLUDE {exclude.upper()})"
        want = c.sql(f"SELECT i, count(v) {w}, CAST(sum(v) {w} AS BIGINT), min(v) {w}, max(v) {w} FROM t").fetchall()
        got = groups_frame(df, ["p"], "o", "v", before, after, exclude=exclude).select("i", "frame_count", "frame_sum", "frame_min", "frame_max")
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr), (before, after)


def test_band_ends_round_like_sql(spark, tmp_path):
    """Balances at the ends of bands, where another order of additions gives the next double; some bands are empty by it."""
    from attesta.plans.join_queries import QUERIES

    lows = [(3, 4088.22), (1, 14.58), (4, 4080.07), (2, 8188.64)] + [(9 * k, round(0.01 + 0.37 * k, 2)) for k in range(1, 400)]
    ends = [4095.22, 15.58, 4095.07, 8191.64] + [low for _, low in lows]
    spark.createDataFrame(lows, "s_suppkey long, s_acctbal double").write.parquet(str(tmp_path / "supplier.parquet"))
    spark.createDataFrame(list(enumerate(ends)), "c_custkey long, c_acctbal double").write.parquet(str(tmp_path / "customer.parquet"))
    query, sql = QUERIES["join_interval_points"]
    c = duckdb.connect()
    for t in ("supplier", "customer"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = sorted(map(tuple, query(spark, str(tmp_path)).select("c_custkey", "s_suppkey").collect()))
    assert got == sorted(c.sql(sql).fetchall())
    assert not {(0, 3), (1, 1), (2, 4), (3, 2)} & set(got)


def test_shortest_spans_beside_far_points(spark):
    """Lengths of a few units in the last place, next to points whose place in bins of that length no long could hold."""
    left = spark.createDataFrame([(0, 0.01), (1, 9e17), (2, 1e300), (3, -1e300), (4, 5.0)], "i int, x double")
    right = spark.createDataFrame([(0, 0.01, 0.010000000000000009), (1, 9e17, 9e17), (2, -2e300, 2e300), (3, 5.0, 5.000000000000001)], "i int, low double, high double")
    got = joins.overlap_join(left, right, ("x", "x"), ("low", "high"))
    assert pairs(got) == [(0, 0), (0, 2), (1, 1), (1, 2), (2, 2), (3, 2), (4, 2), (4, 3)]
