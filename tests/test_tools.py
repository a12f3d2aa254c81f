import pytest

from attesta.functions.textsafe import cell_text, cut_bytes, sanitize
from attesta.operators.verify import verify_many
from attesta.pysandbox import UnsafePython, check_python
from attesta.session import Claim, Finding, Session, UnknownArtifact
from attesta.sqlgate import UnsafeSql, check_sql
from attesta.tools import Tools

ORDERS = "region,month,revenue\neast,jan,120\neast,feb,100\neast,mar,155\nwest,jan,90\nwest,feb,100\nwest,mar,40\n"


@pytest.fixture
def tools(session, tmp_path):
    (tmp_path / "orders.csv").write_text(ORDERS)
    t = Tools(session)
    t.id = t.ingest_dataset(str(tmp_path / "orders.csv"))["dataset_id"]
    return t


def test_worked_example(tools):
    r = tools.run_sql(f'SELECT region, sum(revenue) AS total FROM "{tools.id}" GROUP BY 1 ORDER BY 1')
    assert r["status"] == "ok" and "| east | 375 |\n| west | 230 |" in r["preview"]
    claim = {"description": "west", "artifact_id": r["artifact_id"], "column": "total", "where": {"region": "west"}, "value": 230}
    good = tools.record_finding("West made 230", [claim])
    assert tools.verify_finding(good["finding_id"])["status"] == "verified"
    bad = tools.verify_finding(tools.record_finding("West collapsed in 2024", [claim])["finding_id"])
    assert (bad["status"], bad["unbacked_numbers"]) == ("refuted", ["2024"])
    state = tools.investigation_state()
    assert [f["status"] for f in state["findings"]] == ["verified", "refuted"]
    again = Tools(Session(tools.session.spark, tools.session.base, tools.session.session_id))
    assert again.investigation_state() == state
    assert again.get_artifact(r["artifact_id"])["row_count"] == 2
    with pytest.raises(UnknownArtifact):
        tools.get_artifact("art_x")
    assert "month" in tools.profile_dataset(tools.id)
    assert tools.discover(tools.id)["ledger"]["surfaced"] == 0
    assert "receipts" in tools.investigation_methodology()


def test_claims(tools):
    r = tools.run_sql(f"SELECT region, count(*) AS n, avg(revenue) AS m, CAST(1.5 AS DECIMAL(3,1)) AS d, '42' AS t, CAST(NULL AS INT) AS e, true AS b, double('inf') AS i FROM {tools.id} GROUP BY region")
    failed = tools.run_sql("SELECT 1/0 AS x")
    assert failed["status"] == "error" and "DIVIDE_BY_ZERO" in failed["error"]
    claim = lambda column, value, where=None, artifact=r["artifact_id"]: Claim("", artifact, column, value, where or {})
    west = {"region": "west"}
    cases = [
        (claim("n", 3, west), ""),
        (claim("d", 1.5, west), ""),
        (claim("t", 42, west), ""),
        (claim("m", 230 / 3, west), ""),
        (claim("n", 3, {"m": repr(230 / 3)}), ""),
        (claim("n", 3, {"m": repr(230 / 3), **west}), ""),
        (claim("n", 4, west), "claimed 4.0 but artifact cell is 3.0"),
        (claim("n", 3), "expected exactly 1 matching row, got 2"),
        (claim("n", 3, {"region": "north"}), "expected exactly 1 matching row, got 0"),
        (claim("n", 3, {"e": "None"}), "expected exactly 1 matching row, got 0"),
        (claim("x", 3, {"y": "1", **west}), "unknown column(s): x, y"),
        (claim("n", 3, west, "art_none"), "no artifact 'art_none'"),
        (claim("region", 3, west), "cell value 'west' is not numeric"),
        (claim("e", 3, west), "cell value None is not numeric"),
        (claim("b", 1, west), "cell value True is not numeric"),
        (claim("i", 1, west), "cell value inf is not numeric"),
        (claim("x", 1, None, failed["artifact_id"]), "artifact has no tabular result"),
    ]
    # one finding each, and one with all: the same verdicts in the same few jobs
    findings = [Finding(f"f{k}", "see claims", "", [c]) for k, (c, _) in enumerate(cases)] + [Finding("all", "3 of $1,200.5 and 99%, 9.58 and -76.7", "", [c for c, _ in cases] + [claim("n", 9.583333)])]
    *each, every = verify_many(tools.session, findings)
    assert [v.checks[0].reason for v in each] == [c.reason for c in every.checks[:-1]] == [reason for _, reason in cases]
    assert [v.verified for v in each] == [not reason for _, reason in cases] and not every.verified
    assert every.unbacked == ["$1,200.5", "99%", "-76.7"] and each[0].checks[0].actual == 3.0
    assert verify_many(tools.session, [Finding("none", "nothing to prove")])[0].verified


@pytest.mark.parametrize("sql", ["SELECT 1 AS n", "WITH a AS (SELECT 1 AS n) SELECT n FROM a", "SELECT count(*) FROM (SELECT 1)", "SELECT 'O''Brien' AS \"a\"\"b\"", "SELECT 1 UNION ALL SELECT 2", "SELECT 1;"])
def test_gate_accepts(session, sql):
    assert check_sql(session.spark, f"  {sql} ") == sql.rstrip(";")


@pytest.mark.parametrize(
    "sql",
    ["", "SELECT 1 +", "SELECT 1; SELECT 2", "CREATE TABLE t AS SELECT 1", "INSERT INTO t VALUES (1)", "COPY t TO 'x'", "ATTACH 'x'", "DELETE FROM t", "PRAGMA x", "/* c */ PRAGMA x", "CALL x()",
     "SELECT * FROM read_csv('x')", "SELECT '/*' AS m, * FROM read_parquet('x')", 'SELECT * FROM "read_csv"(\'x\')', "SELECT * FROM 'a.csv'", "SELECT 1 FROM t JOIN 'b.parquet'", "SELECT '/etc/passwd'",
     "SELECT 'it\\'s' AS a, reflect('java.lang.System', 'exit') AS b", "SELECT IDENTIFIER('reflect')('java.lang.System','getProperty','user.home')", "SELECT IDENTIFIER('java_' || 'method')('java.lang.System','exit')", "SELECT * FROM IDENTIFIER('a' || 'b')",
     "WITH a AS (SELECT java_method('x','y') AS b) SELECT * FROM a", "SELECT (SELECT max(try_reflect('x','y'))) AS m", "SELECT transform(array(1), x -> reflect('a','b'))", "SELECT 1 WHERE EXISTS (SELECT * FROM read_json('x'))", "EXECUTE IMMEDIATE 'SELECT 1'", "SET a = 1",
     "EXPLAIN SELECT 1", "CACHE TABLE t", "SELECT TRANSFORM(a) USING 'cat' FROM t", "BEGIN SELECT 1; END"],
)
def test_gate_refuses(session, sql):
    with pytest.raises(UnsafeSql):
        check_sql(session.spark, sql)


def test_preview_is_the_receipt(tools):
    """What is shown is what is stored, also where a second run would give something else."""
    r = tools.run_sql("SELECT current_timestamp() AS t, rand() AS x, uuid() AS u FROM range(3)")
    stored = tools.session.data(tools.session.artifact(r["artifact_id"])).collect()
    assert all(row.u in r["preview"] for row in stored)


def test_preview(tools):
    r = tools.run_sql("SELECT id AS n, id AS n FROM range(100) ORDER BY id DESC")
    assert r["columns"] == ["n", "n_1"] and "_showing 50 of 100 rows_" in r["preview"] and r["preview"].splitlines()[2] == "| 99 | 99 |"
    assert tools.run_sql("SELECT 1 AS n WHERE 1 = 0")["preview"] == "_0 rows_"
    r = tools.run_sql("SELECT NULL AS a, 'NULL' AS b, 1e7 AS c, TIMESTAMP_NTZ '2024-01-01 10:00:05.5' AS t")
    assert "| ␀ | NULL | 10000000.0 | 2024-01-01 10:00:05.5 |" in r["preview"]
    wide = tools.run_sql("SELECT repeat('x', 200) AS v FROM range(50)")["preview"]
    assert len(wide.encode()) <= 4096 and "truncated" in wide
    assert tools.run_sql("SELECT * FROM parquet.`/tmp/x`")["status"] == "error"


def test_sanitize():
    assert sanitize("a\x00b\x07c") == "abc"
    assert sanitize("a\r\nb\nc d") == "a\\nb\\nc\\nd"
    assert sanitize(" a\t\tb  c ") == "a b c"
    assert sanitize("a​b‮c") == "abc"
    assert sanitize("abcdef", 4) == "abc…" and sanitize("ab", 1) == "…"
    with pytest.raises(ValueError):
        sanitize("a", 0)
    assert cell_text(float("nan")) == "nan" and cell_text(1e-5) == "1e-05" and cell_text(True) == "true"
    assert len(cut_bytes("ü" * 100, 60).encode()) <= 60


@pytest.mark.parametrize("code", ["import os", "from . import x", "from sys import path", "eval('1')", "open('x')", "getattr(1, 'a')", "(1).__class__", "x = ().__class__.__bases__", "def f(:"])
def test_python_gate(code):
    with pytest.raises(UnsafePython):
        check_python(code)


def test_python_runs(tools):
    r = tools.run_python("import pandas as pd\nprint('hi')\nresult = df.groupby('region').revenue.sum()")
    assert (r["status"], r["row_count"], r["stdout"]) == ("ok", 2, "hi\n")
    assert tools.run_python("result = 41 + 1")["preview"] == "42"
    assert "ZeroDivisionError" in tools.run_python("1 / 0")["error"]
    assert "timed out" in tools.run_python("while True: pass", timeout_seconds=3)["error"]
    assert tools.run_python("result = len(datasets)", [])["preview"] == "0"
    with pytest.raises(KeyError):
        tools.run_python("1", ["ds_none"])
    n = len(tools.session.artifacts())
    with pytest.raises(UnsafePython):
        tools.run_python("import os")
    assert len(tools.session.artifacts()) == n


def test_preview_opens_the_first_files_only(spark, tmp_path):
    """Rows in the order of files, some of them empty, and no file after the 50th row."""
    from attesta.execute import first_rows

    folder = str(tmp_path / "a b%20c")
    spark.range(0, 400, 1, 8).where("id >= 60").repartitionByRange(8, "id").sortWithinPartitions("id").write.parquet(folder)
    df = spark.read.parquet(folder)
    want = [r.id for r in df.orderBy("id").limit(50).collect()]
    assert [r.id for r in first_rows(spark, folder, df.schema)] == want
    # files after the first ones may be anything
    for f in sorted((tmp_path / "a b%20c").glob("part-*"))[3:]:
        f.write_bytes(b"broken")
    for f in (tmp_path / "a b%20c").glob(".*.crc"):
        f.unlink()
    assert [r.id for r in first_rows(spark, folder, df.schema)] == want
    assert first_rows(spark, str(tmp_path / "none"), df.schema) == []
