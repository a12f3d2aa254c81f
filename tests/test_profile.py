import math
import random
from datetime import date, datetime, timedelta
from fractions import Fraction

import pytest

from attesta.operators.coverage import coverage
from attesta.operators.profile import profile


def test_numbers_and_top_values(spark):
    df = spark.createDataFrame([(1, "a", 10.5), (2, "b", 20.25), (3, "a", 10.5), (4, "c", 99.0), (5, "b", 0.5), (6, "a", None)], "id long, category string, amount double")
    p = profile(df)
    i, c, a = p.columns
    assert (i.numeric.mean, i.numeric.median, round(i.numeric.std, 6), i.numeric.p5, i.numeric.p95) == (3.5, 3.5, 1.870829, 1.25, 5.75)
    assert c.top_values == [("a", 3), ("b", 2), ("c", 1)] and c.distinct_count == 3
    assert a.null_count == 1 and a.null_rate == pytest.approx(1 / 6)
    assert "| 0 | id |" in p.to_markdown() and '"row_count": 6' in p.to_json()


def test_odd_numbers(spark):
    c = profile(spark.createDataFrame([(1.5,), (float("nan"),), (float("inf"),), (2.5,)], "v double")).columns[0]
    assert (c.numeric.mean, c.numeric.p5, c.numeric.p95, c.min_value, c.max_value) == (2.0, pytest.approx(1.55), pytest.approx(2.45), "1.5", "nan")
    one = profile(spark.createDataFrame([(3.5,)], "v double")).columns[0]
    assert one.numeric.std is None and one.numeric.p5 == one.numeric.p95 == 3.5


def test_mean_of_many_large_numbers(spark):
    """The mean is the exact one's nearest or next double, whatever the order in which tasks add."""
    r = random.Random(5)
    near, wide = [round(1e6 + r.random(), 9) for _ in range(20_000)], sorted(round(r.uniform(900, 105_000), 2) for _ in range(20_000))
    p = profile(spark.createDataFrame(list(zip(near, wide, strict=True)), "near double, wide double").repartition(3))
    for values, n in zip((near, wide), (c.numeric for c in p.columns), strict=True):
        exact = sum(map(Fraction, values)) / len(values)
        assert abs(Fraction(n.mean) - exact) <= math.ulp(n.mean)
        assert n.std == pytest.approx(math.sqrt(sum((Fraction(x) - exact) ** 2 for x in values) / (len(values) - 1)), rel=1e-12)


def test_means_of_extreme_numbers(spark):
    """Numbers near either end of the doubles, and equal ones, have the means that plain sums give."""
    p = profile(spark.createDataFrame([(1e308, 5e-324, 0.0, 0.1, 7), (-1e308, 5e-324, 0.0, 0.1, 2**62), (3e307, 5e-324, -0.0, 0.1, None)], "a double, b double, c double, d double, e long"))
    assert [c.numeric.mean for c in p.columns] == [pytest.approx(1e307), 5e-324, 0.0, 0.1, 2.0**61 + 4]
    assert [c.numeric.std for c in p.columns[1:4]] == [0.0, 0.0, 0.0]


def test_empty_and_all_null(spark):
    e = profile(spark.createDataFrame([], "id long, s string"))
    assert e.row_count == 0 and e.columns[0].min_value is None and e.columns[0].null_rate == 0.0
    n = profile(spark.createDataFrame([(1, None), (2, None)], "id long, s string")).columns[1]
    assert n.null_rate == 1.0 and n.distinct_count == 0 and n.date_parse_rate is None


def test_other_types(spark):
    df = spark.sql("SELECT map('a', 1) AS m, array(1, 2) AS a, true AS b, X'00' AS x")
    assert [c.kind for c in profile(df).columns] == ["other", "other", "boolean", "other"]


def test_long_text_is_cut(spark):
    c = profile(spark.createDataFrame([("x" * 500,)], "`weird|name` string"))
    assert len(c.columns[0].top_values[0][0]) == 200 and "weird\\|name" in c.to_markdown()


def test_date_candidates(spark):
    days = [date(2024, 1, 1) + timedelta(d) for d in range(40)]
    rows = [(d.isoformat() if k not in (7, 23) else "bad", d.isoformat() if k % 2 else "bad", d.isoformat() if k not in (1, 2, 3) else "?") for k, d in enumerate(days)]
    p = profile(spark.createDataFrame(rows, "day string, noise string, almost string"))
    assert [c.date_parse_rate for c in p.columns] == [0.95, 0.5, 0.925]
    assert p.date_columns == ["day"]
    v = p.columns[0].coverage
    assert (v.grain, v.gaps, v.examples) == ("day", 2, ["2024-01-08", "2024-01-24"])


def at(spark, values, kind="date"):
    return coverage(spark.createDataFrame([(v,) for v in values], f"d {kind}"), "d")


@pytest.mark.parametrize(
    ("days", "grain", "gaps"),
    [
        ([date(2024, m, 1) for m in (1, 2, 3, 5, 6)], "month", ["2024-04"]),
        ([date(2023, 1, 1), date(2023, 4, 1), date(2023, 10, 1), date(2024, 1, 1)], "quarter", ["2023-07"]),
        ([date(y, 6, 1) for y in (2019, 2020, 2021, 2023, 2024)], "year", ["2022"]),
        ([date(2024, 1, d) for d in range(1, 31) if d not in (10, 20)], "day", ["2024-01-10", "2024-01-20"]),
    ],
)
def test_grains(spark, days, grain, gaps):
    c = at(spark, days)
    assert (c.grain, c.gaps, c.examples) == (grain, len(gaps), gaps)


def test_half_hours_and_single(spark):
    t = [datetime(2024, 3, 1) + timedelta(minutes=30 * k) for k in range(48) if k not in (10, 31)]
    c = at(spark, t, "timestamp_ntz")
    assert (c.grain, c.gaps, c.examples) == ("30-minute", 2, ["2024-03-01 05:00:00", "2024-03-01 15:30:00"])
    one = at(spark, [date(2024, 1, 1)] * 2)
    assert one.grain is None and one.gaps is None
    assert at(spark, [None]) is None
