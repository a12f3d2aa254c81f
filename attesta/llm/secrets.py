"""Secret scans: fixed patterns, and a randomness test battery for strings that no pattern names.

A candidate is a run of token characters that mixes letters with digits or cases, or a part of one between marks. Its
encoding (hex, base32, base36, base62, base64) gives an alphabet; three tests ask whether it may be random in it:
chi-squared uniformity of the symbols, Wald-Wolfowitz runs about the middle of the alphabet, and serial correlation of
neighbours. Short strings pass such tests whatever they are, so a string that passes is reported only if ordinary writing
would hardly give it: the chance of its neighbours in the corpus, divided by their chance in the encoding, is a p-value
(ordinary writing reaches 1 / p with a chance of p at most), and these go through Benjamini-Hochberg control over the
whole corpus, in strata of encoding and length. Runs inside spans of patterns are tested too, as evidence for these.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import column, documents, freed, ship, written

KINDS = ("assign", "access", "hex", "random")
#: kind, pattern, group whose length counts, least length; fixed values.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
PATTERNS = ((0, ASSIGN, 2, 6), (1, re.compile(r"AKIA[A-Z0-9]+"), 0, 20), (2, re.compile(r"[0-9a-f]{24,}"), 0, 24))

LEAST_LENGTH = 20
RUN = re.compile(r"[A-Za-z0-9+/_-]{%d,}={0,2}" % LEAST_LENGTH)
#: A random string fails one of the three tests with about three times this chance.
BATTERY_LEVEL = 0.001
FALSE_DISCOVERY_RATE = 0.01
#: p-values are counted in steps of this many to a power of ten.
STEPS = 20
#: Ordinary writing is how often characters of MARKED follow each other in the corpus (candidates aside), with so many
#: pairs a character from LETTERS and the shares below; and at any place, with this chance, any character whatever.
PRIOR_PAIRS = 1000
ANY = 0.05
#: Relative frequency of a to z in English prose, in thousandths; fixed values.
LETTERS = (82, 15, 28, 43, 127, 22, 20, 61, 70, 2, 8, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 10, 24, 2, 20, 1)
#: Share of digits, capitals and marks in ordinary mixed strings.
DIGITS, CAPITALS, MARKS = 0.2, 0.15, 0.05

LOWER, UPPER, DECIMAL = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Encodings from the smallest alphabet up.
ENCODINGS = (
    ("hex", DECIMAL + "abcdef"),
    ("hex_upper", DECIMAL + "ABCDEF"),
    ("base32", UPPER + "234567"),
    ("base36", DECIMAL + LOWER),
    ("base36_upper", DECIMAL + UPPER),
    ("base62", DECIMAL + UPPER + LOWER),
    ("base64", UPPER + LOWER + DECIMAL + "+/"),
    ("base64url", UPPER + LOWER + DECIMAL + "-_"),
)


MARKED = DECIMAL + UPPER + LOWER + "+/_-"
_SPLIT = re.compile(r"[+/_-]+")
_PART = re.compile("[A-Za-z0-9]{%d,}" % LEAST_LENGTH)
_CODE = np.full(256, len(MARKED), dtype=np.int64)
_CODE[np.frombuffer(MARKED.encode(), dtype=np.uint8)] = np.arange(len(MARKED))
_WIDTH = len(MARKED) + 1
#: Bytes of a text whose pairs are counted at once.
PART = 1 << 17


def single_shares() -> np.ndarray:
    """Shares of the characters of MARKED in ordinary writing, as far as no corpus tells."""
    raw = []
    for c in MARKED:
        if c in DECIMAL:
            raw.append(DIGITS / 10)
        elif c in LOWER:
            raw.append((1 - DIGITS - CAPITALS - MARKS) * LETTERS[ord(c) - 97] / sum(LETTERS))
        elif c in UPPER:
            raw.append(CAPITALS * LETTERS[ord(c) - 65] / sum(LETTERS))
        else:
            raw.append(MARKS / 4)
    return np.array(raw)


def costs(pairs: np.ndarray) -> np.ndarray:
    """-log chance of a character of MARKED after another (or after anything else), from counts of such pairs."""
    counts = pairs[:, :-1] + PRIOR_PAIRS * single_shares()
    return -np.log((1 - ANY) * counts / counts.sum(axis=1, keepdims=True) + ANY / len(MARKED))


def _plain(m: re.Match) -> str:
    """A run without candidates."""
    return " " if encoding_of(m[0]) is not None else _PART.sub(lambda p: p[0] if encoding_of(p[0]) is None else " ", m[0])


def _pairs(texts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each character, or anything else, comes before each in a task's texts, candidates left out."""
    total = np.zeros(_WIDTH * _WIDTH, dtype=np.int64)
    for batch in freed(texts):
        for text in batch.column(0):
            plain = RUN.sub(_plain, text.as_py() or "")
            data = np.frombuffer(plain.encode("utf-8", "surrogatepass"), dtype=np.uint8)
            for at in range(0, len(data) - 1, PART):
                codes = _CODE[data[at : at + PART + 1]]
                total += np.bincount(codes[:-1] * _WIDTH + codes[1:], minlength=len(total))
    at = np.flatnonzero(total)
    yield pa.record_batch([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["pair", "n"])


def fit_ordinary(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """costs() of neighbours in all texts; the table that comes to the driver has one row a pair of characters."""
    ship(docs.sparkSession)
    counted = docs.select(column(text_col).alias("text")).mapInArrow(_pairs, "pair int, n long")
    pairs = np.zeros(_WIDTH * _WIDTH)
    for r in counted.groupBy("pair").agg(F.sum("n").alias("n")).collect():
        pairs[r.pair] = r.n
    return costs(pairs.reshape(_WIDTH, _WIDTH))


#: name, symbols, place of each symbol.
TABLE = [(name, frozenset(a), {c: i for i, c in enumerate(a)}) for name, a in ENCODINGS]


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def chi2_z(x: float, dof: float) -> float:
    """Wilson-Hilferty: about standard normal if x is chi-squared."""
    return ((x / dof) ** (1 / 3) - 1 + 2 / (9 * dof)) / math.sqrt(2 / (9 * dof))


def encoding_of(s: str) -> int | None:
    """The smallest encoding that holds s; none for words, numbers, and capitals that only begin words."""
    chars = set(s.rstrip("="))
    digits, lower, upper = any(c in DECIMAL for c in chars), any(c in LOWER for c in chars), any(c in UPPER for c in chars)
    if not (digits and (lower or upper)) and not (lower and upper and re.search(r"[a-z][A-Z]", s)):
        return None
    return next((k for k, (_, symbols, _) in enumerate(TABLE) if chars <= symbols), None)


def battery(s: str, encoding: int) -> tuple[float, float, float]:
    """p-values of the three tests if s is random in its encoding."""
    _, symbols, place = TABLE[encoding]
    at = [place[c] for c in s.rstrip("=")]
    n, k = len(at), len(symbols)
    counts = [0] * k
    for i in at:
        counts[i] += 1
    chi2 = sum(c * c for c in counts) * k / n - n
    uniform = normal_sf(chi2_z(chi2, k - 1))
    high = [2 * i >= k for i in at]
    ups = sum(high)
    downs = n - ups
    if ups and downs:
        changes = 1 + sum(a != b for a, b in zip(high, high[1:], strict=False))
        mean = 1 + 2 * ups * downs / n
        var = (mean - 1) * (mean - 2) / (n - 1)
        runs = 2 * normal_sf(abs(changes - mean) / math.sqrt(var)) if var > 0 else 1.0
    else:
        runs = 2.0 ** (1 - n)
    m = sum(at) / n
    square = sum((x - m) ** 2 for x in at)
    serial = 2 * normal_sf(abs(sum((a - m) * (b - m) for a, b in zip(at, at[1:], strict=False)) / square + 1 / n) * math.sqrt(n)) if square else 0.0
    return uniform, runs, serial


def ordinary_p(s: str, encoding: int, cost: np.ndarray) -> float:
    """At most this chance has ordinary writing to be as much likelier in the encoding as s is."""
    codes = _CODE[np.frombuffer(s.rstrip("=").encode(), dtype=np.uint8)]
    log_p = len(codes) * math.log(len(TABLE[encoding][1])) - cost[np.concatenate([[len(MARKED)], codes[:-1]]), codes].sum()
    return math.exp(max(min(0.0, log_p), -690.0))


def stratum_of(n: int, encoding: int) -> int:
    """Lengths within a factor of the square root of two share a stratum."""
    return encoding * 64 + min(63, int(2 * math.log2(n / LEAST_LENGTH)))


def judged(s: str, cost: np.ndarray) -> tuple[int, float] | None:
    """(stratum, p) of a candidate; p is 1 if it fails the battery."""
    if (encoding := encoding_of(s)) is None:
        return None
    p = ordinary_p(s, encoding, cost)
    return stratum_of(len(s), encoding), p if p < 1 and min(battery(s, encoding)) >= BATTERY_LEVEL else 1.0


def candidates(text: str, cost: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
    """(start, end, stratum, p) of each run, or, where one of them is less ordinary, of its long parts between marks."""
    for m in RUN.finditer(text):
        s, (start, end) = m.group(), m.span()
        whole = judged(s, cost)
        parts, at = [], 0
        for gap in [*_SPLIT.finditer(s), None]:
            stop = gap.start() if gap else len(s)
            if LEAST_LENGTH <= stop - at < len(s) and (found := judged(s[at:stop], cost)):
                parts.append((start + at, start + stop, *found))
            at = gap.end() if gap else stop
        if parts and (whole is None or min(p for *_, p in parts) < whole[1]):
            yield from parts
        elif whole:
            yield start, end, *whole


def scan(text: str, cost: np.ndarray) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, float, int]]]:
    """Base spans (start, kind, end) by start and kind; candidates (start, end, stratum, p, number of base spans touched)."""
    base = []
    for kind, pattern, group, least in PATTERNS:
        if kind == 0 and ":" not in text and "=" not in text:
            continue
        base += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    base.sort()
    return base, [(*c, sum(a < c[1] and c[0] < b for a, _, b in base)) for c in candidates(text, cost)]


SCANNED = "key long, base array<struct<start:int,kind:int,end:int>>, tried array<struct<start:int,end:int,stratum:int,p:double,within:int>>"
_BASE = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
_TRIED = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("stratum", pa.int32()), ("p", pa.float64()), ("within", pa.int32())]))


def _scanner(cost: np.ndarray):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in freed(batches):
            base, tried = [], []
            for text in batch.column(1):
                b, t = scan(text.as_py() or "", cost)
                base.append([dict(zip(("start", "kind", "end"), x, strict=True)) for x in b])
                tried.append([dict(zip(("start", "end", "stratum", "p", "within"), x, strict=True)) for x in t])
            yield pa.record_batch([batch.column(0), pa.array(base, _BASE), pa.array(tried, _TRIED)], names=["key", "base", "tried"])

    return run


def scanned(docs: DataFrame, key: Column, cost: np.ndarray, text_col: str) -> DataFrame:
    """(key, base, tried) of each row; key is a long."""
    return docs.select(key.cast("long").alias("key"), column(text_col).alias("text")).mapInArrow(_scanner(cost), SCANNED)


def step(p: float) -> int:
    """The number of the step that p lies in, counted from 1 downwards; p is at most 10 ** (-step / STEPS)."""
    return math.floor(-math.log10(p) * STEPS)


def step_of(p: Column) -> Column:
    return F.floor(-F.log10(p) * STEPS).cast("int")


def thresholds(found: DataFrame, rate: float) -> dict[int, int]:
    """For each stratum with discoveries, the lowest step that Benjamini-Hochberg accepts; at most a few hundred."""
    counts = found.select(F.explode("tried").alias("t")).groupBy(F.col("t.stratum").alias("stratum"), step_of(F.col("t.p")).alias("step")).count()
    s = W.partitionBy("stratum")
    accepted = (
        counts.withColumn("m", F.sum("count").over(s))
        .withColumn("upto", F.sum("count").over(s.orderBy(F.desc("step"))))
        .where(F.pow(F.lit(10.0), -F.col("step") / STEPS) <= rate * F.col("upto") / F.col("m"))
        .groupBy("stratum")
        .agg(F.min("step").alias("step"))
    )
    return {r.stratum: r.step for r in accepted.collect()}


def accepted(least: dict[int, int], within: bool) -> Column:
    """The candidates of a scanned row that are discoveries, inside or outside base spans."""
    if not least:
        return F.filter("tried", lambda t: F.lit(False))
    steps = F.create_map(*(F.lit(x) for kv in sorted(least.items()) for x in kv))
    return F.filter(
        "tried", lambda t: (step_of(t["p"]) >= F.coalesce(F.try_element_at(steps, t["stratum"]), F.lit(2**31 - 1))) & ((t["within"] > 0) == F.lit(within))
    )


def spans_of(least: dict[int, int]) -> Column:
    """All spans of a scanned row: the base ones and the discoveries outside of them, by start and kind."""
    span = lambda t: F.struct(t["start"].alias("start"), F.lit(len(KINDS) - 1).alias("kind"), t["end"].alias("end"))
    return F.sort_array(F.concat("base", F.transform(accepted(least, False), span)))


def listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def find_secrets(docs: DataFrame, *, rate: float = FALSE_DISCOVERY_RATE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, spans, n_proven), a row for each row of docs: arrays of (start, kind, end) in code points, end exclusive.

    n_proven is the number of candidates inside base spans that the battery and the control of false discoveries accept
    too. Whole texts are scanned, of any length; null is empty and has no spans. Spans of different kinds may overlap;
    candidates that touch a base span add no span. Repeated rows and equal texts get the same spans; a null id stays null;
    other columns of any name play no role; an empty table gives no rows. Only the spans, never the texts, are written
    between the scan and the control of false discoveries.
    """
    cost = fit_ordinary(docs, text_col)
    found = written(scanned(docs, column(id_col), cost, text_col), "secret_spans")
    least = thresholds(found, rate)
    return found.select(F.col("key").alias("doc_id"), "base", spans_of(least).alias("spans"), F.size(accepted(least, True)).cast("long").alias("n_proven"))


def redacted(text: str, cost: np.ndarray, least: dict[int, int], mark: str) -> str:
    """The text with each of its spans, overlapping ones together, replaced by a mark."""
    base, tried = scan(text, cost)
    spans = [(a, b) for a, _, b in base] + [(a, b) for a, b, s, p, within in tried if not within and s in least and step(p) >= least[s]]
    out, at = [], 0
    for a, b in sorted(spans):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _redactor(cost: np.ndarray, least: dict[int, int], mark: str, text_at: int, sizes_at: list[int]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in freed(batches):
            columns, texts = batch.columns, batch.column(text_at)
            new = [None if not t.is_valid else redacted(t.as_py(), cost, least, mark) for t in texts]
            changed = [k for k, (t, n) in enumerate(zip(texts, new, strict=True)) if n is not None and t.as_py() != n]
            if changed:
                columns[text_at] = pa.array(new, texts.type)
                for at in sizes_at:
                    sizes = columns[at].to_pylist()
                    for k in changed:
                        sizes[k] = len(new[k])
                    columns[at] = pa.array(sizes, columns[at].type)
            yield pa.record_batch(columns, schema=batch.schema)

    return run


def redact_secrets(docs: DataFrame, *, rate: float = FALSE_DISCOVERY_RATE, mark: str = "[secret]", text_col: str = "text") -> DataFrame:
    """docs with each span of secrets in the text replaced by a mark, in the same columns.

    Overlapping spans are replaced together. Texts without secrets, null and empty ones included, stay as they are; an
    n_chars column follows the new text. Texts may be of any length; rows are kept each, repeated ones and those of one
    text alike; extra columns of any name stay; an empty table gives no rows. The scan runs twice: once for the
    thresholds, of which only counts are kept.
    """
    cost = fit_ordinary(docs, text_col)
    least = thresholds(scanned(docs, F.lit(0), cost, text_col), rate)
    # names of any kind don't pass through Arrow's schema, places do
    plain = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))
    work = _redactor(cost, least, mark, docs.columns.index(text_col), [k for k, c in enumerate(docs.columns) if c == "n_chars"])
    return plain.mapInArrow(work, plain.schema).toDF(*docs.columns)


def op2_secrets(spark, sf_dir):
    found = find_secrets(documents(spark, sf_dir))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
        "n_proven",
    )
