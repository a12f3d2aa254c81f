import hashlib

import pytest

from attesta.operators import sampling


def md5(*parts):
    return hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()


@pytest.mark.parametrize("digits", [1, 4])
def test_least_hashes_are_drawn(spark, monkeypatch, digits):
    monkeypatch.setattr(sampling, "DIGITS", digits)
    df = spark.range(1000).selectExpr("id", "id % 3 `g.h`", "if(id % 2 = 0, null, 'x') t").repartition(5)
    for n in (0, 1, 37, 999, 1000, 5000):
        got = sorted(r.id for r in sampling.sample_rows(df, n, key=["id"]).collect())
        assert got == sorted(sorted(range(1000), key=lambda i: md5("sample", i))[:n])
    each = sampling.sample_rows(df, 20, key=["id"], by=["g.h", "t"], seed="s")
    assert each.columns == df.columns
    want = [i for g in range(3) for o in range(2) for i in sorted((i for i in range(1000) if i % 3 == g and i % 2 == o), key=lambda i: md5("s", i))[:20]]
    assert sorted(r.id for r in each.collect()) == sorted(want)


def test_repeated_rows(spark):
    df = spark.sql("SELECT 7 AS k FROM range(500)")
    assert sampling.sample_rows(df, 123).count() == 123 and sampling.sample_rows(df.limit(0), 5).count() == 0
