"""SQL that computes a whole discovery pass: statistics, tails from their series, false-discovery control and fates."""

from __future__ import annotations

from itertools import combinations, product

FLOORS = {"spearman": 0.3, "kruskal": 0.06, "chi_square": 0.1}


def _values(name: str) -> str:
    return f"CASE WHEN isnan(CAST({name} AS DOUBLE)) THEN NULL ELSE CAST({name} AS DOUBLE) END"


def _ranked(source: str, value: str, more: str) -> str:
    return f"SELECT {more}, rank() OVER (ORDER BY {value}) + (count(*) OVER (PARTITION BY {value}) - 1) / 2.0 AS r_{value} FROM {source}"


def spearman_sql(seq: int, a: str, b: str) -> str:
    return (
        f"(WITH p AS (SELECT {_values(a)} AS a, {_values(b)} AS b FROM src), q AS (SELECT * FROM p WHERE a IS NOT NULL AND b IS NOT NULL), "
        f"r1 AS ({_ranked('q', 'a', 'a, b')}), r2 AS ({_ranked('r1', 'b', 'r_a')}), "
        "s AS (SELECT count(*) AS n, CASE WHEN count(*) >= 20 AND stddev_pop(r_a) > 0 AND stddev_pop(r_b) > 0 THEN corr(r_a, r_b) END AS rho FROM r2) "
        f"SELECT {seq} AS seq, 'spearman' AS test, '{a}' AS \"left\", '{b}' AS \"right\", n, rho AS statistic, CAST(NULL AS BIGINT) AS dof, abs(rho) AS effect FROM s)"
    )


def kruskal_sql(seq: int, value: str, group: str) -> str:
    return (
        f"(WITH p AS (SELECT CAST({group} AS VARCHAR) AS g, {_values(value)} AS v FROM src), q AS (SELECT * FROM p WHERE g IS NOT NULL AND v IS NOT NULL), "
        "k AS (SELECT q.* FROM q JOIN (SELECT g FROM q GROUP BY g HAVING count(*) >= 5) USING (g)), "
        f"r AS ({_ranked('k', 'v', 'g, v')}), s AS (SELECT g, count(*) AS n, sum(r_v) AS s FROM r GROUP BY g), "
        "t AS (SELECT sum(c * c * c - c) AS ties FROM (SELECT CAST(count(*) AS DOUBLE) AS c FROM k GROUP BY v)), "
        "a AS (SELECT count(*) AS k, CAST(sum(n) AS DOUBLE) AS n, sum(s * s / n) AS q FROM s), "
        "h AS (SELECT coalesce(n, 0) AS n, k, CASE WHEN k >= 2 AND n >= 20 AND ties < n * n * n - n THEN (12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (n * n * n - n)) END AS h FROM a, t) "
        f"SELECT {seq} AS seq, 'kruskal' AS test, '{value}' AS \"left\", '{group}' AS \"right\", CAST(n AS BIGINT) AS n, h AS statistic, CAST(k - 1 AS BIGINT) AS dof, greatest(0.0, (h - k + 1) / (n - k)) AS effect FROM h)"
    )


def chi_square_sql(seq: int, a: str, b: str) -> str:
    return (
        f"(WITH c AS (SELECT CAST({a} AS VARCHAR) AS a, CAST({b} AS VARCHAR) AS b, CAST(count(*) AS DOUBLE) AS o FROM src WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2), "
        "ra AS (SELECT a, sum(o) AS ra FROM c GROUP BY a), cb AS (SELECT b, sum(o) AS cb FROM c GROUP BY b), "
        "t AS (SELECT coalesce(sum(o), 0) AS n, count(DISTINCT a) AS r, count(DISTINCT b) AS c FROM c), "
        "d AS (SELECT abs(coalesce(o, 0) - ra * cb / n) AS d, ra * cb / n AS e, r, c FROM ra CROSS JOIN cb LEFT JOIN c USING (a, b) CROSS JOIN t), "
        "x AS (SELECT sum(power(d - CASE WHEN r = 2 AND c = 2 THEN least(0.5, d) ELSE 0 END, 2) / e) AS x2 FROM d), "
        "y AS (SELECT n, r, c, CASE WHEN least(r, c) >= 2 AND n >= 20 THEN x2 END AS x2 FROM x, t) "
        f"SELECT {seq} AS seq, 'chi_square' AS test, '{a}' AS \"left\", '{b}' AS \"right\", CAST(n AS BIGINT) AS n, x2 AS statistic, CAST((r - 1) * (c - 1) AS BIGINT) AS dof, sqrt(x2 / (n * (least(r, c) - 1))) AS effect FROM y)"
    )


def statistics_sql(source: str, probes: list[tuple[str, str, str]]) -> str:
    """CTEs up to v: a row for each probe with its statistic and p-value.

    A chi-squared tail is one minus the series of the lower gamma function; Student's with nu degrees of freedom is one
    minus a finite sum over powers of 1 - rho ** 2, with an arc sine if nu is odd.
    """
    make = {"spearman": spearman_sql, "kruskal": kruskal_sql, "chi_square": chi_square_sql}
    every = " UNION ALL ".join(make[t](i, a, b) for i, (t, a, b) in enumerate(probes))
    return (
        f"WITH src AS MATERIALIZED ({source}), st AS MATERIALIZED (SELECT * FROM ({every})), "
        "ln AS (SELECT seq, CASE WHEN test = 'spearman' THEN (n - 2) // 2 ELSE CAST(ceil(statistic) AS BIGINT) + 300 END AS terms FROM st WHERE statistic IS NOT NULL), "
        "j AS (SELECT unnest(range((SELECT coalesce(max(terms), 0) FROM ln))) AS j), "
        "sm AS (SELECT seq, sum(CASE WHEN test <> 'spearman' THEN CASE WHEN statistic > 0 THEN exp((dof / 2.0 + j) * ln(statistic / 2) - statistic / 2 - lgamma(dof / 2.0 + j + 1)) ELSE 0 END "
        "WHEN n % 2 = 0 THEN exp(lgamma(j + 0.5) - lgamma(j + 1) + j * ln(1 - statistic * statistic)) / sqrt(pi()) "
        "ELSE exp(lgamma(j + 1) - lgamma(j + 1.5) + (j + 0.5) * ln(1 - statistic * statistic)) * sqrt(pi()) / 2 END) AS total "
        "FROM st JOIN ln USING (seq) JOIN j ON j < terms WHERE NOT (test = 'spearman' AND abs(statistic) >= 1) GROUP BY seq), "
        "v AS MATERIALIZED (SELECT st.*, CASE WHEN statistic IS NULL THEN NULL WHEN test <> 'spearman' THEN greatest(0.0, 1 - total) WHEN abs(statistic) >= 1 THEN 0.0 "
        "WHEN n % 2 = 0 THEN greatest(0.0, 1 - abs(statistic) * total) ELSE greatest(0.0, 1 - 2 / pi() * (asin(abs(statistic)) + abs(statistic) * total)) END AS p FROM st LEFT JOIN sm USING (seq))"
    )


def probes_of(ranked: list[str], grouping: list[str]) -> list[tuple[str, str, str]]:
    return [*(("spearman", *x) for x in combinations(ranked, 2)), *(("kruskal", *x) for x in product(ranked, grouping)), *(("chi_square", *x) for x in combinations(grouping, 2))]


def pass_sql(source: str, ranked: list[str], grouping: list[str], alpha: float = 0.1, findings: int = 5) -> str:
    """CTEs up to f: every probe with its fate."""
    floor = "CASE test " + " ".join(f"WHEN '{t}' THEN {x}" for t, x in FLOORS.items()) + " END"
    return (
        f"{statistics_sql(source, probes_of(ranked, grouping))}, "
        "o AS (SELECT *, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS m FROM v WHERE statistic IS NOT NULL), "
        f"l AS (SELECT coalesce(max(k), 0) AS last FROM o WHERE p <= {alpha} * k / m), "
        f"w AS (SELECT o.*, k <= last AS rejected, effect >= {floor} AS large FROM o, l), "
        "g AS (SELECT seq, row_number() OVER (ORDER BY effect DESC, seq) AS place FROM w WHERE rejected AND large), "
        f"f AS (SELECT v.*, CASE WHEN v.statistic IS NULL THEN 'insufficient' WHEN NOT rejected THEN 'not_significant' WHEN NOT large THEN 'below_floor' WHEN place > {findings} THEN 'finding_cap' ELSE 'surfaced' END AS fate "
        "FROM v LEFT JOIN w USING (seq) LEFT JOIN g USING (seq))"
    )


def rows_sql(digits: int = 6) -> str:
    return f"test, \"left\", \"right\", n, round(statistic, {digits}) AS statistic, round(p, {digits}) AS p_value, round(effect, {digits}) AS effect"
