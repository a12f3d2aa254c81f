"""Queries of sketches that are stored by group and merged, and of unions by name."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import storage
from ..operators.sketches import DISTINCT_ERROR, RANK_ERROR, all_values, estimates, merged, sketches

SKETCHED = ("l_orderkey", "l_suppkey", "l_quantity", "l_extendedprice")
FRACTIONS = (0.05, 0.5, 0.95)
COUNTED = ("l_linenumber", "l_returnflag", "l_suppkey")


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def merged_sketches(spark, sf_dir):
    """Sketches by flag and status, stored, merged to statuses, and whether each estimate keeps its bound against exact counts."""
    lines = _table(spark, sf_dir, "lineitem")
    stored = storage.written(sketches(lines, SKETCHED, by=["l_returnflag", "l_linestatus"]), "sketches")
    said = storage.written(estimates(merged([stored], by=["l_linestatus"]), FRACTIONS, by=["l_linestatus"]), "estimates")
    values = lines.select("l_linestatus", F.explode(F.create_map(*(x for c in SKETCHED for x in (F.lit(c), F.col(c).cast("double"))))).alias("column", "v"))
    # a row for each status and column
    beside = values.join(F.broadcast(said.select("l_linestatus", "column", "n_distinct", "quantiles")), ["l_linestatus", "column"])
    ranks = [F.avg((F.col("v") < F.col("quantiles")[k]).cast("double")) - RANK_ERROR <= p for k, p in enumerate(FRACTIONS)]
    ranks += [F.avg((F.col("v") <= F.col("quantiles")[k]).cast("double")) + RANK_ERROR >= p for k, p in enumerate(FRACTIONS)]
    exact = F.count_distinct("v")
    # counted apart, as a distinct count beside other aggregates writes each row once more
    near = beside.groupBy("l_linestatus", "column").agg((F.abs(exact - F.first("n_distinct")) <= DISTINCT_ERROR * exact).alias("distinct_within"))
    true = beside.groupBy("l_linestatus", "column").agg(*(r.alias(f"r{k}") for k, r in enumerate(ranks)))
    true = true.select("l_linestatus", "column", F.forall(F.array(*(f"r{k}" for k in range(len(ranks)))), lambda r: r).alias("ranks_within"))
    return said.join(near, ["l_linestatus", "column"]).join(true, ["l_linestatus", "column"]).select("l_linestatus", "column", "rows", "non_null", "low", "high", "distinct_within", "ranks_within")


def frequent_in_all(spark, sf_dir):
    """Counts of all values, from sketches by status; a column of more values than a sketch holds is counted in its rows."""
    lines = _table(spark, sf_dir, "lineitem")
    stored = storage.written(sketches(lines, COUNTED, by=["l_linestatus"]), "sketches")
    return all_values(lines, COUNTED, merged([stored]))


def union_by_name(spark, sf_dir):
    """Customers and suppliers under each other by the names of their columns; those that one lacks are null."""
    a = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    b = _table(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("key"))
    return a.unionByName(b, allowMissingColumns=True)


QUERIES = {
    "sketch_merge_lineitem": (
        merged_sketches,
        " UNION ALL ".join(
            f"SELECT l_linestatus, '{c}' AS \"column\", count(*) AS \"rows\", count({c}) AS non_null, CAST(min({c}) AS DOUBLE) AS low, CAST(max({c}) AS DOUBLE) AS high, "
            "true AS distinct_within, true AS ranks_within FROM lineitem GROUP BY 1"
            for c in SKETCHED
        ),
    ),
    "sketch_frequent_lineitem": (
        frequent_in_all,
        " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, count(*) AS count FROM lineitem WHERE {c} IS NOT NULL GROUP BY 2" for c in COUNTED),
    ),
    "union_by_name": (
        union_by_name,
        "SELECT c_custkey AS key, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL BY NAME SELECT s_acctbal AS balance, s_suppkey AS key FROM supplier",
    ),
}
