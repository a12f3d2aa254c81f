"""Queries of claims and of numbers in prose, over claims that are made from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import storage
from ..operators import claims


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def claim_lookup(spark, sf_dir):
    """The cell that a claim points to, read again from a grouped result."""
    sums = _table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("total"))
    one = spark.createDataFrame([("f", 0, "sums", "total", {"l_returnflag": "A", "l_linestatus": "F"}, 0.0, 1e-9, 1e-12)], claims.CLAIM)
    return claims.check_claims(one, {"sums": sums}).select(F.col("actual").alias("cell"))


def line_results(spark, sf_dir):
    """A result to make claims on: a row for each order and line, with some nulls."""
    lines = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("quantity"), F.max("l_returnflag").alias("flag"))
    return lines.withColumn("quantity", F.when(F.col("l_orderkey") % 10 != 3, F.col("quantity")))


def claims_on_lines(spark, sf_dir):
    """A claim for each row of that result: true and false ones, without a row, with many, and on cells that are no numbers."""
    k = F.col("l_orderkey") % 10
    key = F.create_map(F.lit("l_orderkey"), F.col("l_orderkey").cast("string"), F.lit("l_linenumber"), F.col("l_linenumber").cast("string"))
    where = F.when(k == 6, F.create_map(F.lit("flag"), F.lit("A"))).when(k == 7, F.create_map(F.lit("l_orderkey"), F.lit("-1"))).otherwise(key)
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct().select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("finding_id"),
        F.lit(0).alias("claim"),
        F.when(k == 8, "gone").when(k == 9, "broken").otherwise("lines").alias("artifact_id"),
        F.when(k == 4, "flag").when(k == 5, "weight").otherwise("quantity").alias("column"),
        where.alias("where"),
        F.lit(25.0).alias("value"),
        F.when(k == 1, 0.5).otherwise(1e-9).alias("rel_tol"),
        F.lit(1e-12).alias("abs_tol"),
    )


def claims_checked(spark, sf_dir):
    checks = claims.check_claims(claims_on_lines(spark, sf_dir), {"lines": storage.written(line_results(spark, sf_dir), "lines"), "broken": None})
    return checks.select("finding_id", "ok", "actual", "reason")


CLAIMS_SQL = """
WITH r AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 10 <> 3 THEN max(l_quantity) END AS quantity, max(l_returnflag) AS flag FROM lineitem GROUP BY 1, 2),
c AS (SELECT l_orderkey || '-' || l_linenumber AS finding_id, l_orderkey % 10 AS k, CASE WHEN l_orderkey % 10 < 4 THEN quantity END AS actual, flag, (SELECT count(*) FROM r WHERE flag = 'A') AS many FROM r)
SELECT finding_id, coalesce(abs(actual - 25) <= CASE WHEN k = 1 THEN 0.5 ELSE 1e-9 END * greatest(actual, 25), false) AS ok, actual,
CASE k WHEN 8 THEN 'no artifact ''gone''' WHEN 9 THEN 'artifact has no tabular result' WHEN 5 THEN 'unknown column(s): weight'
WHEN 6 THEN 'expected exactly 1 matching row, got ' || many WHEN 7 THEN 'expected exactly 1 matching row, got 0'
WHEN 4 THEN 'cell value ''' || flag || ''' is not numeric' WHEN 3 THEN 'cell value None is not numeric'
ELSE CASE WHEN abs(actual - 25) > CASE WHEN k = 1 THEN 0.5 ELSE 1e-9 END * greatest(actual, 25) THEN 'claimed 25.0 but artifact cell is ' || actual ELSE '' END END AS reason FROM c
"""


def documented_numbers(spark, sf_dir):
    """(findings, claims): each document says its length and a share before its whole text, and claims these and its id."""
    docs = _table(spark, sf_dir, "documents")
    key, share = F.col("doc_id").cast("string").alias("finding_id"), F.col("doc_id") / 7
    prose = F.concat(F.lit("has "), F.col("n_chars").cast("string"), F.lit(" characters, share "), F.format_string("%.2f%% ", share), F.coalesce("text", F.lit("")))
    return docs.select(key, prose.alias("prose")), docs.select(key, F.explode(F.array(F.col("n_chars").cast("double"), F.col("doc_id").cast("double"), share)).alias("value"))


def unbacked(spark, sf_dir):
    loose = claims.unbacked_numbers(*documented_numbers(spark, sf_dir))
    tokens = loose.groupBy("finding_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("token")).alias("t"))
    return tokens.select("finding_id", "n", F.md5(F.array_join("t", " ").cast("binary")).alias("tokens_md5"))


UNBACKED_SQL = r"""
WITH f AS (SELECT doc_id, 'has ' || n_chars || ' characters, share ' || printf('%.2f', doc_id / 7) || '% ' || coalesce(text, '') AS prose, n_chars FROM documents),
t AS (SELECT doc_id, n_chars, unnest(regexp_extract_all(prose, '[-+]?\$?\d[\d,]*(?:\.\d+)?%?')) AS token FROM f),
p AS (SELECT *, regexp_replace(regexp_replace(token, '[$,]', '', 'g'), '%+$', '') AS plain FROM t),
q AS (SELECT *, CAST(plain AS DOUBLE) AS shown, CAST(length(split_part(plain, '.', 2)) AS INTEGER) AS d FROM p),
e AS (SELECT *, round(CAST(n_chars AS DOUBLE), d) AS a, round(CAST(doc_id AS DOUBLE), d) AS b, round(doc_id / 7, d) AS c FROM q),
u AS (SELECT doc_id, token FROM e WHERE NOT (abs(a - shown) <= greatest(1e-9 * greatest(a, abs(shown)), 1e-9) OR abs(b - shown) <= greatest(1e-9 * greatest(b, abs(shown)), 1e-9) OR abs(c - shown) <= greatest(1e-9 * greatest(c, abs(shown)), 1e-9)))
SELECT CAST(doc_id AS VARCHAR) AS finding_id, count(*) AS n, md5(string_agg(token, ' ' ORDER BY encode(token))) AS tokens_md5 FROM u GROUP BY 1
"""


def verdicts_of_orders(spark, sf_dir):
    """A finding for each order: how many lines it has and their sum, claimed from grouped lines; every third order says one more."""
    lines = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("total"))
    lines = storage.written(lines, "lines")
    key = F.col("l_orderkey").cast("string").alias("finding_id")
    said = F.col("n") + F.when(F.col("l_orderkey") % 3 == 0, 1).otherwise(0)
    findings = lines.select(key, F.format_string("%d lines with %.1f in all", said, "total").alias("prose"))
    each = F.array(F.struct(F.lit("n").alias("column"), F.col("n").cast("double").alias("value")), F.struct(F.lit("total").alias("column"), (F.col("total") + F.when(F.col("l_orderkey") % 5 == 0, 0.5).otherwise(0)).alias("value")))
    made = lines.select(key, F.create_map(F.lit("l_orderkey"), F.col("l_orderkey").cast("string")).alias("where"), F.posexplode(each).alias("claim", "c"))
    made = made.select("finding_id", "claim", F.lit("orders").alias("artifact_id"), "c.column", "where", "c.value", F.lit(1e-9).alias("rel_tol"), F.lit(1e-12).alias("abs_tol"))
    return claims.verdicts(findings, made, {"orders": lines})


VERDICTS_SQL = """
WITH r AS (SELECT l_orderkey AS k, count(*) AS n, sum(l_quantity) AS total FROM lineitem GROUP BY 1),
s AS (SELECT *, n + CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS said, total + CASE WHEN k % 5 = 0 THEN 0.5 ELSE 0 END AS claimed FROM r),
u AS (SELECT *, CASE WHEN said = n OR said = round_even(claimed, 0) THEN 0 ELSE 1 END + CASE WHEN claimed = total OR total = n THEN 0 ELSE 1 END AS loose FROM s)
SELECT CAST(k AS VARCHAR) AS finding_id, CAST(2 AS BIGINT) AS n_claims, CAST(CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_failed, CAST(loose AS BIGINT) AS n_unbacked, k % 5 <> 0 AND loose = 0 AS verified FROM u
"""

QUERIES = {
    "claim_keyed_lookup": (claim_lookup, "SELECT round(sum(l_quantity), 2) AS cell FROM lineitem WHERE l_returnflag = 'A' AND l_linestatus = 'F'"),
    "claims_checked_lineitem": (claims_checked, CLAIMS_SQL),
    "claims_unbacked_documents": (unbacked, UNBACKED_SQL),
    "claims_verdicts_orders": (verdicts_of_orders, VERDICTS_SQL),
}
