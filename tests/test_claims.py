import math
import random

import pytest
from pyspark.sql import functions as F

from attesta.functions.numbers import double_text, is_close, is_plain_double_text, parsed_number, rounded_half_even
from attesta.operators import claims as cl


def column(spark, values, kind, f):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").coalesce(1).select(f(F.col("v"))).collect()]


@pytest.fixture(scope="module")
def doubles():
    r = random.Random(3)
    some = [0.0, -0.0, 1.0, 1e7, 123456789.125, 1e-4, 1e-5, 1.5e-5, 0.0001234, 9.999e15, 1e16, 1.5e16, 1e22, 1.7976931348623157e308, -2.5, 0.1, 100.0, 1e15, 12345678.9, 0.001, 5e-324, math.nan, math.inf, -math.inf]
    return some + [r.choice([-1, 1]) * round(r.random() * 10 ** r.randrange(0, 12), r.randrange(0, 6)) for _ in range(400)]


def test_texts_of_doubles(spark, doubles):
    assert column(spark, doubles, "double", double_text)[:20] == [repr(x) for x in doubles[:20]]
    assert column(spark, doubles[24:], "double", double_text) == [repr(x) for x in doubles[24:]]
    texts = [repr(x) for x in doubles if x != 5e-324] + ["1.50", "01.5", "1e7", "+1.5", " 1.5", "1_0.0", "1", "0.10000000000000001", "x", "", "1E5"]
    want = [True] * (len(doubles) - 1) + [False] * 11
    assert column(spark, texts, "string", is_plain_double_text) == want


def test_numbers_in_text(spark):
    texts = ["1", " 1.5 ", "1_000.2_5", "-.5e3", "5.", "1e400", "inf", "nan", "5d", "1__0", "_1", "", "0x10", "1,5", "+7E-2", None]

    def plain(t):
        try:
            x = float(t)
        except (ValueError, TypeError):
            return None
        return x if math.isfinite(x) else None

    assert column(spark, texts, "string", parsed_number) == [plain(t) for t in texts]


def test_rounding_like_python(spark):
    r = random.Random(8)
    values = [2.675, 1.005, 1.115, 0.125, 0.375, 2.5, 3.5, -2.5, 0.5, 1e300, 5e15 + 0.5, 0.045, 1.45, -1.15, 4.35, 9.995, 1e-9, 0.0] + [round(r.random() * 1000, 3) + 0.0005 for _ in range(500)] + [r.randrange(10**6) / 8 for _ in range(300)]
    for d in (0, 1, 2, 3, 7):
        assert column(spark, values, "double", lambda v, d=None: rounded_half_even(v, F.lit(d))) if False else column(spark, values, "double", at(d)) == [round(x, d) for x in values]


def at(d):
    return lambda v: rounded_half_even(v, F.lit(d))


def test_closeness_like_python(spark):
    pairs = [(1.0, 1.0 + 1e-10, 1e-9, 0.0), (1.0, 1.1, 1e-9, 0.2), (math.inf, math.inf, 0.0, 0.0), (1.0, math.inf, 1.0, math.inf), (math.nan, math.nan, 1.0, 1.0), (0.0, 1e-13, 1e-9, 1e-12), (0.0, 1e-11, 1e-9, 1e-12), (1e300, 1.0000001e300, 1e-6, 0.0)]
    rows = spark.createDataFrame(pairs, "a double, b double, r double, t double").coalesce(1).select(is_close(*map(F.col, "abrt"))).collect()
    assert [r[0] for r in rows] == [math.isclose(a, b, rel_tol=r, abs_tol=t) for a, b, r, t in pairs]


def test_numbers_of_prose_like_a_loop(spark):
    """Each number against each value of its finding, as one would write it in a loop."""
    import re

    r = random.Random(2)
    findings, claims = [], []
    for f in range(60):
        values = [r.choice([round(r.uniform(-50, 50), r.randrange(4)), r.randrange(10**9) / 7, 12345678901.0, 2.675, 0.5]) for _ in range(r.randrange(6))]
        shown = [f"{round(v, d):,.{d}f}" for v in values for d in [r.randrange(4)] if r.random() < 0.8] + [str(r.randrange(30))] * r.randrange(2) + (["12345678902", "2.68", "$45%", "2024-01"] if f % 5 == 0 else [])
        findings.append((str(f), " and ".join(shown) if f else None))
        claims += [(str(f), v) for v in values]
    got = sorted(map(tuple, cl.unbacked_numbers(spark.createDataFrame(findings, "finding_id string, prose string"), spark.createDataFrame(claims, "finding_id string, value double")).collect()))
    want = []
    for f, prose in findings:
        for k, t in enumerate(re.findall(cl.NUMBER, prose or "")):
            plain = t.replace("$", "").replace(",", "").rstrip("%")
            d = len(plain.partition(".")[2])
            if not any(math.isclose(round(v, d), float(plain), abs_tol=1e-9) for g, v in claims if g == f):
                want.append((f, k, t))
    assert got == sorted(want)


def test_many_claims_of_one_artifact(spark, monkeypatch):
    """Several sets of filter columns, more than a pass serves, clashing and odd names, and a key that most rows have."""
    monkeypatch.setattr(cl, "SETS", 2)
    data = spark.range(300).selectExpr("id", "id % 2 `set`", "'same' `texts`", "id / 4 `a.b`", "date_add(date'2024-01-01', cast(id as int)) `d``y`", "if(id % 3 = 0, null, id) v", "array(id) arr")
    rows = [
        ("id", {"id": "7"}, 7.0, ""), ("a.b", {"id": "7"}, 1.75, ""), ("id", {"a.b": "1.75"}, 7.0, ""), ("id", {"a.b": "1.750"}, 7.0, "expected exactly 1 matching row, got 0"),
        ("id", {"d`y": "2024-01-08"}, 7.0, ""), ("v", {"id": "6"}, 6.0, "cell value None is not numeric"), ("id", {"v": "7", "set": "1"}, 7.0, ""), ("id", {"v": "7", "set": "0"}, 7.0, "expected exactly 1 matching row, got 0"),
        ("id", {"texts": "same"}, 7.0, "expected exactly 1 matching row, got 300"), ("id", {}, 7.0, "expected exactly 1 matching row, got 300"), ("arr", {"id": "7"}, 7.0, "cell value [7] is not numeric"),
        ("d`y", {"id": "7"}, 7.0, "cell value 2024-01-08 is not numeric"), ("id", {"id": None}, 7.0, "expected exactly 1 matching row, got 0"), ("V", {"ID": "7"}, 7.0, "unknown column(s): ID, V"),
    ]
    table = spark.createDataFrame([(f"f{k % 3}", k, "art", c, w, v, 1e-9, 1e-12) for k, (c, w, v, _) in enumerate(rows)], cl.CLAIM)
    for most in (0, 10**6):
        monkeypatch.setattr(cl, "BROADCAST_ROWS", most)
        got = {r.claim: r.reason for r in cl.check_claims(table, {"art": data}).collect()}
        assert [got[k] for k in range(len(rows))] == [reason for *_, reason in rows]
    found = {r.finding_id: r for r in cl.verdicts(spark.createDataFrame([("f0", "7"), ("f9", "none"), ("f8", "1")], "finding_id string, prose string"), table, {"art": data}).collect()}
    assert (found["f0"].verified, found["f0"].n_claims, found["f0"].n_unbacked) == (False, 5, 0)
    assert found["f9"].verified and (found["f8"].verified, found["f8"].n_unbacked) == (False, 1)


def test_few_keys_of_one_set_beside_many_of_another(spark, monkeypatch):
    """A key that a third of all rows and claims have: its set has few keys, so no row or claim of it is shuffled by it."""
    monkeypatch.setattr(cl, "BROADCAST_ROWS", 5)
    data = spark.range(300).selectExpr("id k", "if(id % 3 = 0, 'A', concat('b', id)) flag", "id * 2.0 v")
    where = "CASE WHEN id % 3 = 0 THEN map('flag', 'A') WHEN id = 1 THEN map('flag', 'b1') WHEN id = 2 THEN map('flag', cast(null AS string)) ELSE map('k', cast(id AS string)) END"
    claims = spark.range(330).selectExpr("cast(id AS string) finding_id", "0 claim", "'r' artifact_id", "'v' column", f"{where} where", "id * 2.0D value", "1e-9D rel_tol", "0D abs_tol")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = cl.check_claims(claims, {"r": data})
        plan = got._jdf.queryExecution().executedPlan().toString()
        rows = {int(r.finding_id): (r.ok, r.reason) for r in got.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    none = "expected exactly 1 matching row, got "
    want = {i: (False, f"{none}100") if i % 3 == 0 else (False, f"{none}0") if i == 2 or i >= 300 else (True, "") for i in range(330)}
    assert rows == want
    assert plan.count("BroadcastHashJoin") >= 2


def test_verdicts_make_claims_once(spark, tmp_path):
    """Claims are used many times over, and may be costly to make: what is left to run reads them from a stored copy."""
    data = spark.range(20).selectExpr("id k", "id * 2.0D v")
    made = data.selectExpr("cast(k AS string) finding_id", "0 claim", "'r' artifact_id", "'v' column", "map('k', cast(k AS string)) where", "v value", "1e-9D rel_tol", "0D abs_tol")
    made.write.parquet(str(tmp_path / "claims"))
    got = cl.verdicts(data.selectExpr("cast(k AS string) finding_id", "concat('v is ', k * 2 + k % 2) prose"), spark.read.parquet(str(tmp_path / "claims")), {"r": data})
    assert not [f for f in got.inputFiles() if str(tmp_path) in f]
    assert {int(r.finding_id): r.verified for r in got.collect()} == {k: k % 2 == 0 for k in range(20)}
