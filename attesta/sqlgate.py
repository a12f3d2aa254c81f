"""The gate of run_sql: one read-only query, no files, no Java calls.

Everything is decided on the plans that Spark itself makes. Of the parsed plan, subqueries included, only nodes of queries
pass; names that are only known at run time, unknown table functions and functions that call Java don't. Texts that look
like files are refused as a choice, since analysts who write them expect a file to be read. Reading files by name in FROM
is off in the session (spark.sql.runSQLOnFiles). Once a query is analysed, its expressions are looked through again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession


class UnsafeSql(ValueError):
    pass


#: What the parser makes of queries, and of the two kinds of statements that only tell of tables.
QUERY_NODES = frozenset(
    """Aggregate CurrentNamespace Deduplicate DescribeColumn DescribeRelation Distinct Except Expand Filter Generate
    GlobalLimit Intersect Join LateralJoin LocalLimit LocalRelation Offset OneRowRelation PipeOperator Pivot Project
    Repartition RepartitionByExpression RebalancePartitions Sample ShowColumns ShowTables Sort SubqueryAlias Union
    UnresolvedHaving UnresolvedHint UnresolvedInlineTable UnresolvedNamespace UnresolvedPivot UnresolvedRelation
    UnresolvedSubqueryColumnAliases UnresolvedTVFAliases UnresolvedTableOrView UnresolvedTableValuedFunction UnresolvedWith
    Unpivot Window WithWindowDefinition""".split()
)
#: Functions that call Java; fixed values.
JAVA_FUNCTIONS = frozenset(("java_method", "reflect", "try_reflect"))
JAVA_EXPRESSIONS = frozenset(("CallMethodViaReflection", "TryReflect", "Invoke", "StaticInvoke", "NewInstance"))
#: Endings of data files; fixed values.
FILE_ENDINGS = frozenset((".arrow", ".avro", ".csv", ".db", ".duckdb", ".feather", ".json", ".jsonl", ".ndjson", ".orc", ".parquet", ".pq", ".psv", ".sqlite", ".tsv", ".wal", ".xls", ".xlsx"))


def _each(scala) -> Iterator:
    it = scala.iterator()
    while it.hasNext():
        yield it.next()


def _kind(node) -> str:
    return node.getClass().getName().rpartition(".")[2].strip("$").rpartition("$")[2]


def plans_of(plan) -> Iterator:
    """All nodes of a logical plan, those of plans inside expressions and of named subqueries included."""
    yield plan
    for group in (plan.children(), plan.innerChildren(), plan.subqueries()):
        for child in _each(group):
            if hasattr(child, "innerChildren") and hasattr(child, "subqueries"):
                yield from plans_of(child)


def expressions_of(plan) -> Iterator:
    """All expressions of one node."""
    todo = list(_each(plan.expressions()))
    while todo:
        e = todo.pop()
        yield e
        todo += _each(e.children())


def looks_like_file(text: str) -> bool:
    text = text.strip()
    rooted = text.startswith(("/", "~", "./", "../", "\\\\")) or re.match(r"[A-Za-z]:[\\/]", text)
    return bool(rooted) or PurePosixPath(text).suffix.lower() in FILE_ENDINGS


def _check_expression(e) -> None:
    kind = _kind(e)
    if kind == "UnresolvedFunction":
        name = [str(x) for x in _each(e.nameParts())][-1].lower()
        if name in JAVA_FUNCTIONS:
            raise UnsafeSql(f"function {name!r} calls Java and is not allowed")
    elif "UnresolvedIdentifier" in kind:
        raise UnsafeSql("names made at run time, IDENTIFIER(...), are not allowed")
    elif kind in JAVA_EXPRESSIONS:
        raise UnsafeSql(f"{kind} calls Java and is not allowed")
    elif kind == "Literal" and e.dataType().typeName() == "string" and e.value() is not None and looks_like_file(str(e.value().toString())):
        raise UnsafeSql(f"string literal {str(e.value().toString())[:60]!r} looks like a file path and is not allowed")


def check_sql(spark: SparkSession, sql: str) -> str:
    """The stripped statement; UnsafeSql if it is not a single read-only query."""
    sql = sql.strip().rstrip("; \n\t")
    if not sql:
        raise UnsafeSql("empty SQL statement")
    state = spark._jsparkSession.sessionState()
    try:
        plan = state.sqlParser().parsePlan(sql)
    except Exception as e:
        raise UnsafeSql(f"not a single query that Spark can parse: {str(getattr(e, 'desc', e)).splitlines()[0][:300]}") from e
    for node in plans_of(plan):
        kind = _kind(node)
        if kind not in QUERY_NODES:
            raise UnsafeSql(f"only SELECT queries are allowed, got {kind}")
        if kind == "UnresolvedTableValuedFunction":
            name = [str(x) for x in _each(node.name())][-1]
            if not spark.catalog.functionExists(name):
                raise UnsafeSql(f"unknown table function {name!r}; none that reads files or the network is allowed")
        for e in expressions_of(node):
            _check_expression(e)
    return sql


def check_analyzed(df: DataFrame) -> DataFrame:
    """df; UnsafeSql if its analysed plan calls Java, whatever the names in the text were."""
    for node in plans_of(df._jdf.queryExecution().analyzed()):
        for e in expressions_of(node):
            if _kind(e) in JAVA_EXPRESSIONS:
                raise UnsafeSql(f"{_kind(e)} calls Java and is not allowed")
    return df
