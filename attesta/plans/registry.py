"""Queries of the library, one or more for each family of operators, and the SQL that checks them."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..execute import run_sql
from ..functions.pvalues import benjamini_hochberg, chi2_tail
from ..functions.textsafe import sanitized
from ..ingest import ingest
from ..operators import coverage, profile
from ..operators.claims import prose_numbers as prose_tokens
from ..operators.discover import discover
from ..operators.pairs import outcomes
from ..operators.ordered import average_ranks, counted, percentiles, with_previous
from ..session import Session
from ..sources.names import normalize
from . import claim_queries, discovery_sql, join_queries, sketch_queries
from .texts import SAME, SPARK_OWN


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile basics of lineitem."""
    return profile_basics(spark, sf_dir)


NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
BASIC = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *NUMBERS, "l_returnflag", "l_linestatus")


def profile_basics(spark, sf_dir):
    """What a profile of lineitem says of rows, nulls and distinct values of each column."""
    report = profile.profile(table(spark, sf_dir, "lineitem").select(*BASIC))
    rows = [(c.name, report.row_count, report.row_count - c.null_count, c.distinct_count, c.null_rate) for c in report.columns]
    return spark.createDataFrame(rows, "column string, n_rows long, non_null long, n_distinct long, null_rate double")


def profile_numbers(spark, sf_dir):
    """The same profile's statistics of numbers."""
    report = profile.profile(table(spark, sf_dir, "lineitem").select(*NUMBERS))
    rows = [(c.name, *(round(x, 9) for x in (c.numeric.mean, c.numeric.median, c.numeric.std, c.numeric.p5, c.numeric.p95))) for c in report.columns]
    return spark.createDataFrame(rows, "column string, mean double, median double, std double, p5 double, p95 double")


def profile_min_max(spark, sf_dir):
    report = profile.profile(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"))
    rows = [(c.name, report.row_count - c.null_count, float(c.min_value), float(c.max_value)) for c in report.columns]
    return spark.createDataFrame(rows, "column string, non_null long, low double, high double")


def profile_topk(spark, sf_dir):
    report = profile.profile(table(spark, sf_dir, "part").select("p_brand"))
    return spark.createDataFrame(report.columns[0].top_values, "value string, count long")


TOPS = ("p_brand", "p_size", "p_retailprice")


def profile_topk_columns(spark, sf_dir):
    """The most frequent values of several columns, with their places."""
    report = profile.profile(table(spark, sf_dir, "part").select(*TOPS))
    rows = [(c.name, k, float(v) if c.kind == "numeric" else None, v if c.kind == "text" else None, n) for c in report.columns for k, (v, n) in enumerate(c.top_values, 1)]
    return spark.createDataFrame(rows, "column string, place long, number double, text string, count long")


def date_parse_rate(spark, sf_dir):
    report = profile.profile(table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_orderpriority"))
    return spark.createDataFrame([tuple(c.date_parse_rate for c in report.columns)], "date_rate double, priority_rate double")


def grain_orders(spark, sf_dir):
    times = coverage.distinct_times(table(spark, sf_dir, "orders"), "o_orderdate")
    steps = with_previous(times, "t", "p").where("p is not null").select(((F.col("t") - F.col("p")) / 1_000_000).cast("long").alias("step_seconds"))
    return steps.groupBy("step_seconds").agg(F.count("*").cast("long").alias("n_steps"))


def coverage_row(spark, df, name):
    c = coverage.coverage(df, name)
    return spark.createDataFrame([(c.grain, c.gaps, c.first, c.last)], "grain string, gaps long, first_time timestamp_ntz, last_time timestamp_ntz")


def coverage_orders(spark, sf_dir):
    return coverage_row(spark, table(spark, sf_dir, "orders").select("o_orderdate"), "o_orderdate")


def coverage_months(spark, sf_dir):
    return coverage_row(spark, table(spark, sf_dir, "orders").select(F.date_trunc("month", "o_orderdate").alias("m")), "m")


def gap_examples(spark, sf_dir):
    c = coverage.coverage(table(spark, sf_dir, "orders").select("o_orderdate"), "o_orderdate")
    return spark.createDataFrame([(x,) for x in c.examples], "gap string")


def ranks(spark, sf_dir):
    return average_ranks(counted(table(spark, sf_dir, "customer"), "c_acctbal"), "c_acctbal", "rank").select("c_acctbal", F.col("count").cast("long").alias("n"), "rank")


def statistic(spark, df, probe, digits=6):
    """One probe's row: n, statistic, p-value and effect, rounded."""
    (o,) = outcomes(df, [probe])
    cut = lambda x: None if x is None else round(x, digits)
    return spark.createDataFrame([(o.n, cut(o.statistic), cut(o.p_value), cut(o.effect), o.dof)], "n long, statistic double, p_value double, effect double, dof long")


def spearman(spark, sf_dir):
    r = statistic(spark, table(spark, sf_dir, "lineitem"), ("spearman", "l_quantity", "l_extendedprice"))
    return r.select("n", F.col("statistic").alias("rho"))


def kruskal(spark, sf_dir):
    r = statistic(spark, table(spark, sf_dir, "lineitem"), ("kruskal", "l_extendedprice", "l_returnflag"), 12)
    return r.select("n", (F.col("dof") + 1).alias("k"), F.round("statistic", 4).alias("h"), F.round("p_value", 6).alias("p_value"), F.round("effect", 8).alias("epsilon_sq"))


def chi_square(spark, sf_dir):
    r = statistic(spark, table(spark, sf_dir, "lineitem"), ("chi_square", "l_returnflag", "l_linestatus"))
    return r.select("n", F.col("statistic").alias("chi2"), F.col("effect").alias("v"))


def chi_square_yates(spark, sf_dir):
    r = statistic(spark, table(spark, sf_dir, "labels"), ("chi_square", "quality", "toxic"))
    return r.select("n", F.col("statistic").alias("chi2"), F.col("effect").alias("v"))


def segment_tails(spark, sf_dir):
    """(nation, p): for each nation, whether its customers are spread evenly over segments, as chi-squared tails."""
    counts = table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("o"))
    k = table(spark, sf_dir, "customer").agg(F.count_distinct("c_mktsegment").alias("k"))
    sums = counts.groupBy("c_nationkey").agg(F.sum("o").alias("n"), F.sum(F.col("o") * F.col("o")).alias("q")).join(F.broadcast(k))
    # one row a nation
    rows = sums.select("c_nationkey", (F.col("q") * F.col("k") / F.col("n") - F.col("n")).alias("x2"), "k").orderBy("c_nationkey").collect()
    return [(int(r.c_nationkey), chi2_tail(r.x2, r.k - 1)) for r in rows]


def chi_square_tail(spark, sf_dir):
    return spark.createDataFrame([(n, round(p, 9)) for n, p in segment_tails(spark, sf_dir)], "nation long, p double")


def bh(spark, sf_dir):
    """False-discovery control over the tails of all nations, at a level at which some are rejected."""
    tails = segment_tails(spark, sf_dir)
    kept = benjamini_hochberg([p for _, p in tails], 0.8)
    return spark.createDataFrame([(n, k) for (n, _), k in zip(tails, kept, strict=True)], "nation long, rejected boolean")


def orders_of_customers(spark, sf_dir):
    return table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))


RANKED, GROUPING = ["o_totalprice", "c_acctbal"], ["o_orderstatus", "c_mktsegment"]
JOINED_SQL = "SELECT * FROM orders JOIN customer ON o_custkey = c_custkey"


def discover_report(spark, sf_dir):
    """Each probe of a whole discovery pass, with its statistic, p-value, effect and fate."""
    report = discover(orders_of_customers(spark, sf_dir).select(*RANKED, *GROUPING))
    return judged_rows(spark, [(*j.columns, j.test, j.outcome, j.fate) for j in report.judged])


def judged_rows(spark, rows, digits=6):
    cut = lambda x: None if x is None else round(x, digits)
    out = [(t, a, b, o.n, cut(o.statistic), cut(o.p_value), cut(o.effect), fate) for a, b, t, o, fate in rows]
    return spark.createDataFrame(out, "test string, left string, right string, n long, statistic double, p_value double, effect double, fate string")


def discover_ledger(spark, sf_dir):
    """The ledger of the same pass: what was generated, held back and surfaced."""
    ledger = discover(orders_of_customers(spark, sf_dir).select(*RANKED, *GROUPING)).ledger
    names = ("generated", "probe_cap", "insufficient", "run", "not_significant", "below_floor", "finding_cap", "surfaced")
    return spark.createDataFrame([tuple(getattr(ledger, n) for n in names)], ", ".join(f"{n} long" for n in names))


#: Columns with nulls, and one with a group that is too small on small tables, as (name, Spark SQL, DuckDB SQL).
GAPS = (
    ("price", "if(o_orderkey % 7 = 0, null, o_totalprice)", "CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END"),
    ("balance", "if(o_custkey % 5 = 0, double('nan'), c_acctbal)", "CASE WHEN o_custkey % 5 = 0 THEN CAST('nan' AS DOUBLE) ELSE c_acctbal END"),
    ("day", "o_orderdate", "epoch(o_orderdate)"),
    ("segment", "if(o_orderkey % 11 = 0, null, c_mktsegment)", "CASE WHEN o_orderkey % 11 <> 0 THEN c_mktsegment END"),
    ("kind", "if(o_orderkey % 4001 = 1, 'rare', o_orderstatus)", "CASE WHEN o_orderkey % 4001 = 1 THEN 'rare' ELSE o_orderstatus END"),
)
GAP_PROBES = discovery_sql.probes_of(["price", "balance", "day"], ["segment", "kind"])


def discover_pairs(spark, sf_dir):
    """All statistics of columns with nulls, NaN and a small group: each pair has its own rows and ranks."""
    df = orders_of_customers(spark, sf_dir).select(*(F.expr(s).alias(n) for n, s, _ in GAPS))
    return judged_rows(spark, [(a, b, t, o, None) for (t, a, b), o in zip(GAP_PROBES, outcomes(df, GAP_PROBES), strict=True)]).drop("fate")


def prose_numbers(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select(F.explode(prose_tokens(F.coalesce("text", F.lit("")))).alias("number"))
    return found.groupBy("number").agg(F.count("*").cast("long").alias("n"))


def sanitize_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(sanitized(F.coalesce("text", F.lit("")))).alias("clean_md5"))


def headers(spark, sf_dir):
    """Names for headers that are made of the types, brands and names of parts and nations, some of them the same or bad."""
    brands = [r[0] for r in table(spark, sf_dir, "part").select("p_brand").distinct().orderBy("p_brand").collect()]
    nations = [r[0] for r in table(spark, sf_dir, "nation").select("n_name").distinct().orderBy("n_name").collect()]
    found = [*brands, *(b.lower().replace("#", " (") for b in brands), *(f"{k} {n}" for k, n in enumerate(nations)), "select", "", "From", "café"]
    return spark.createDataFrame([(i, h, n) for i, (h, n) in enumerate(zip(found, normalize(found), strict=True))], "i long, header string, name string")


def ingest_csv(spark, sf_dir):
    """Customers by way of a CSV file: names, types and values survive."""
    session = Session(spark, storage.scratch(spark))
    table(spark, sf_dir, "customer").withColumnRenamed("c_name", "C Name!").write.csv(f"{session.folder}/customer.csv", header=True)
    return session.table(ingest(session, f"{session.folder}/customer.csv").dataset_id)


def sql_artifact(spark, sf_dir):
    """The stored result of a guarded query."""
    session = Session(spark, storage.scratch(spark))
    d = ingest(session, f"{sf_dir}/orders.parquet")
    return stored(session, f'SELECT o_orderstatus, count(*) AS n, count(*) AS n FROM "{d.dataset_id}" GROUP BY 1')


def stored(session: Session, text: str) -> DataFrame:
    """The artifact's data of a text that goes through the gate and run_sql."""
    r = run_sql(session, text)
    if r.status != "ok":
        raise RuntimeError(r.error)
    return session.data(r)


def quartiles(spark, sf_dir):
    """First and third quartiles of prices; percentile() would hold all prices of a status in one task."""
    found = percentiles(table(spark, sf_dir, "lineitem"), "l_extendedprice", [0.25, 0.75], ["l_linestatus"])
    return found.select("l_linestatus", F.round("p0", 6).alias("q1"), F.round("p1", 6).alias("q3"))


def same_sql(name, spark, sf_dir):
    """A text of the dialect, through run_sql, over the tables by name."""
    tables, text = SAME[name] if name in SAME else SPARK_OWN[name][:2]
    session = Session(spark, storage.scratch(spark))
    for t in tables.split():
        table(spark, sf_dir, t).createOrReplaceTempView(t)
    return stored(session, text)


_OWN = {
    "profile_basics_lineitem": (
        profile_basics,
        " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count({c}) AS non_null, count(DISTINCT {c}) AS n_distinct, "
            f"CAST(count(*) - count({c}) AS DOUBLE) / count(*) AS null_rate FROM lineitem"
            for c in BASIC
        ),
    ),
    "profile_numeric_stats_lineitem": (
        profile_numbers,
        " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", round(avg({c}), 9) AS mean, round(median({c}), 9) AS median, round(stddev_samp({c}), 9) AS std, "
            f"round(quantile_cont({c}, 0.05), 9) AS p5, round(quantile_cont({c}, 0.95), 9) AS p95 FROM lineitem WHERE isfinite({c})"
            for c in NUMBERS
        ),
    ),
    "profile_min_max_orders": (
        profile_min_max,
        " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", count({c}) AS non_null, CAST(min({c}) AS DOUBLE) AS low, CAST(max({c}) AS DOUBLE) AS high FROM orders"
            for c in ("o_orderkey", "o_custkey", "o_totalprice")
        ),
    ),
    "profile_topk_part_brand": (profile_topk, "SELECT p_brand AS value, count(*) AS count FROM part WHERE p_brand IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5"),
    "profile_date_parse_rate": (
        date_parse_rate,
        "SELECT CAST(count(try_cast(strftime(o_orderdate, '%Y-%m-%d') AS TIMESTAMP)) AS DOUBLE) / count(*) AS date_rate, "
        "CAST(count(try_cast(o_orderpriority AS TIMESTAMP)) AS DOUBLE) / count(*) AS priority_rate FROM orders",
    ),
    "coverage_steps_orders": (
        grain_orders,
        "WITH t AS (SELECT DISTINCT o_orderdate AS d FROM orders WHERE o_orderdate IS NOT NULL), s AS (SELECT date_diff('second', lag(d) OVER (ORDER BY d), d) AS step_seconds FROM t) "
        "SELECT CAST(step_seconds AS BIGINT) AS step_seconds, count(*) AS n_steps FROM s WHERE step_seconds IS NOT NULL GROUP BY 1",
    ),
    "coverage_grain_orders": (
        coverage_orders,
        "SELECT 'day' AS grain, CAST(date_diff('day', min(o_orderdate), max(o_orderdate)) + 1 - count(DISTINCT o_orderdate) AS BIGINT) AS gaps, "
        "CAST(min(o_orderdate) AS TIMESTAMP) AS first_time, CAST(max(o_orderdate) AS TIMESTAMP) AS last_time FROM orders",
    ),
    "coverage_calendar_orders_month": (
        coverage_months,
        "WITH m AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS d FROM orders WHERE o_orderdate IS NOT NULL) "
        "SELECT 'month' AS grain, CAST(max(year(d) * 12 + month(d)) - min(year(d) * 12 + month(d)) + 1 - count(*) AS BIGINT) AS gaps, min(d) AS first_time, max(d) AS last_time FROM m",
    ),
    "coverage_gap_examples_orders": (
        gap_examples,
        "WITH g AS (SELECT unnest(generate_series((SELECT min(o_orderdate) FROM orders), (SELECT max(o_orderdate) FROM orders), INTERVAL 1 DAY)) AS d) "
        "SELECT strftime(d, '%Y-%m-%d') AS gap FROM g WHERE d NOT IN (SELECT o_orderdate FROM orders) ORDER BY d LIMIT 5",
    ),
    "discover_average_ranks": (
        ranks,
        "SELECT c_acctbal, count(*) AS n, min(r) + (count(*) - 1) / 2.0 AS rank FROM (SELECT c_acctbal, rank() OVER (ORDER BY c_acctbal) AS r FROM customer) GROUP BY 1",
    ),
    "discover_spearman_lineitem": (
        spearman,
        "WITH p AS (SELECT l_quantity AS a, l_extendedprice AS b FROM lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL), "
        "r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM p) "
        "SELECT count(*) AS n, round(corr(ra, rb), 6) AS rho FROM r",
    ),
    "discover_kruskal_lineitem": (
        kruskal,
        "WITH p AS (SELECT l_returnflag AS g, l_extendedprice AS v FROM lineitem), r AS (SELECT g, v, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS r FROM p), "
        "s AS (SELECT g, count(*) AS n, sum(r) AS s FROM r GROUP BY g), t AS (SELECT sum(c * c * c - c) AS ties FROM (SELECT CAST(count(*) AS DOUBLE) AS c FROM p GROUP BY v)), "
        "a AS (SELECT count(*) AS k, CAST(sum(n) AS DOUBLE) AS n, sum(s * s / n) AS q FROM s), "
        "h AS (SELECT n, k, (12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (n * n * n - n)) AS h FROM a, t) "
        "SELECT CAST(n AS BIGINT) AS n, k, round(h, 4) AS h, round(exp(-h / 2), 6) AS p_value, round(greatest(0.0, (h - k + 1) / (n - k)), 8) AS epsilon_sq FROM h",
    ),
}


def _chi2_sql(source: str, a: str, b: str, yates: bool) -> str:
    d = "abs(coalesce(o, 0) - ra * cb / n)"
    d = f"({d} - least(0.5, {d}))" if yates else d
    return (
        f"WITH c AS (SELECT CAST({a} AS VARCHAR) AS a, CAST({b} AS VARCHAR) AS b, CAST(count(*) AS DOUBLE) AS o FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2), "
        "ra AS (SELECT a, sum(o) AS ra FROM c GROUP BY a), cb AS (SELECT b, sum(o) AS cb FROM c GROUP BY b), t AS (SELECT sum(o) AS n, least(count(DISTINCT a), count(DISTINCT b)) AS k FROM c), "
        f"x AS (SELECT sum({d} * {d} / (ra * cb / n)) AS x2, max(n) AS n, max(k) AS k FROM ra CROSS JOIN cb LEFT JOIN c USING (a, b) CROSS JOIN t) "
        "SELECT CAST(n AS BIGINT) AS n, round(x2, 6) AS chi2, round(sqrt(x2 / (n * (k - 1))), 6) AS v FROM x"
    )


#: Tails with four degrees of freedom have a closed form.
_TAILS = (
    "c AS (SELECT c_nationkey, count(*) AS o FROM customer GROUP BY c_nationkey, c_mktsegment), "
    "x AS (SELECT c_nationkey, sum(o * o) * (SELECT count(DISTINCT c_mktsegment) FROM customer) / sum(o) - sum(o) AS x2 FROM c GROUP BY 1), "
    "t AS (SELECT CAST(c_nationkey AS BIGINT) AS nation, exp(-x2 / 2) * (1 + x2 / 2) AS p FROM x)"
)


_OWN |= {
    "discover_chi_square_lineitem": (chi_square, _chi2_sql("lineitem", "l_returnflag", "l_linestatus", False)),
    "discover_chi_square_yates_labels": (chi_square_yates, _chi2_sql("labels", "quality", "toxic", True)),
    "discover_chi_square_tail": (chi_square_tail, f"WITH {_TAILS} SELECT nation, round(p, 9) AS p FROM t"),
    "discover_bh_fdr": (
        bh,
        f"WITH {_TAILS}, r AS (SELECT *, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS m FROM t), l AS (SELECT coalesce(max(k), 0) AS last FROM r WHERE p <= 0.8 * k / m) "
        "SELECT nation, k <= last AS rejected FROM r, l",
    ),
    "discover_report_orders": (discover_report, f"{discovery_sql.pass_sql(JOINED_SQL, RANKED, GROUPING)} SELECT {discovery_sql.rows_sql()}, fate FROM f"),
    "discover_ledger_orders": (
        discover_ledger,
        f"{discovery_sql.pass_sql(JOINED_SQL, RANKED, GROUPING)} SELECT count(*) AS generated, CAST(0 AS BIGINT) AS probe_cap, count(*) FILTER (fate = 'insufficient') AS insufficient, "
        "count(*) FILTER (fate <> 'insufficient') AS run, "
        + ", ".join(f"count(*) FILTER (fate = '{x}') AS {x}" for x in ("not_significant", "below_floor", "finding_cap", "surfaced"))
        + " FROM f",
    ),
    "discover_pairs_with_gaps": (
        discover_pairs,
        f"{discovery_sql.statistics_sql('SELECT ' + ', '.join(f'{q} AS {n}' for n, _, q in GAPS) + ' FROM orders JOIN customer ON o_custkey = c_custkey', GAP_PROBES)} SELECT {discovery_sql.rows_sql()} FROM v",
    ),
    "profile_topk_part_columns": (
        profile_topk_columns,
        " UNION ALL ".join(
            f"(SELECT '{c}' AS \"column\", row_number() OVER (ORDER BY count(*) DESC, {c}) AS place, {'NULL' if c == 'p_brand' else f'CAST({c} AS DOUBLE)'} AS number, {c if c == 'p_brand' else 'NULL'} AS text, count(*) AS count "
            f"FROM part WHERE {c} IS NOT NULL GROUP BY {c} QUALIFY place <= 5)"
            for c in TOPS
        ),
    ),
    "ingest_csv_customer": (
        ingest_csv,
        "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer",
    ),
    "sql_percentiles": (
        quartiles,
        "SELECT l_linestatus, round(quantile_cont(l_extendedprice, 0.25), 6) AS q1, round(quantile_cont(l_extendedprice, 0.75), 6) AS q3 FROM lineitem GROUP BY 1",
    ),
    "run_sql_artifact": (sql_artifact, "SELECT o_orderstatus, count(*) AS n, count(*) AS n_1 FROM orders GROUP BY 1"),
    "prose_numbers": (
        prose_numbers,
        r"WITH n AS (SELECT unnest(regexp_extract_all(coalesce(text, ''), '[-+]?\$?\d[\d,]*(?:\.\d+)?%?')) AS number FROM documents) SELECT number, count(*) AS n FROM n GROUP BY 1",
    ),
    "sanitize_text_documents": (
        sanitize_text,
        r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(replace(regexp_replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), '[\n\r\x0b\x0c\x{2028}\x{2029}]', '\\\\n', 'g'), chr(9), ' '), '\p{C}', '', 'g'), ' +', ' ', 'g'), ' ')) AS clean_md5 FROM documents",
    ),
    "normalize_headers": (
        headers,
        "WITH p AS (SELECT DISTINCT p_brand AS b FROM part), n AS (SELECT n_name, row_number() OVER (ORDER BY n_name) - 1 AS k FROM (SELECT DISTINCT n_name FROM nation)), "
        "h AS (SELECT 1 AS part, b AS o, b AS header FROM p UNION ALL SELECT 2, b, replace(lower(b), '#', ' (') FROM p UNION ALL SELECT 3, n_name, k || ' ' || n_name FROM n "
        "UNION ALL SELECT 4, o, h FROM (VALUES ('1', 'select'), ('2', ''), ('3', 'From'), ('4', 'café')) AS t(o, h)), "
        "v AS (SELECT row_number() OVER (ORDER BY part, o) - 1 AS i, header FROM h), "
        "a AS (SELECT *, regexp_replace(trim(regexp_replace(lower(header), '[^a-z0-9_]+', '_', 'g'), '_'), '_+', '_', 'g') AS s FROM v), "
        "b AS (SELECT *, CASE WHEN s = '' THEN 'col_' || i WHEN s IN ('select', 'from') THEN s || '_' WHEN regexp_matches(s, '^[0-9]') THEN 'c_' || s ELSE s END AS n FROM a), "
        "c AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY i) AS k FROM b) SELECT i, header, CASE WHEN k = 1 THEN n ELSE n || '_' || k END AS name FROM c",
    ),
}


_OWN |= claim_queries.QUERIES | join_queries.QUERIES | sketch_queries.QUERIES


def queries() -> dict:
    out = {k: f for k, (f, _) in _OWN.items()}
    for k in (*SAME, *SPARK_OWN):
        out[k] = partial(same_sql, k)
    return out


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _OWN.items()} | {k: s for k, (_, s) in SAME.items()} | {k: s for k, (_, _, s) in SPARK_OWN.items()}
