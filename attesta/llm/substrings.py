"""Removal of long substrings that repeat anywhere in the corpus, by prefix-free parsing.

A rolling hash over 16 bytes triggers where it is the least of 200 neighbours, which content alone decides. Each text is
parsed into phrases, one a trigger: the bytes of all 400-byte strings whose middle has its least hash there. Neighbouring
phrases overlap by 399 bytes, so each 400-byte string lies in exactly one phrase, at the place its trigger gives, and equal
strings lie in phrases with equal triggers. The parse therefore needs no order beyond its counts: a phrase of the
dictionary that occurs twice repeats whole. What is left are strings of two different phrases with one trigger.
A trigger with few phrases is compared in one task, place by place. One with many is split: its distances are halved, and
phrases go on together only where the bytes that all strings of a half have in common are equal, until few are left.
Phrases that are equal over a whole half are told apart no further, so each half goes on with one of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, freed, ship, written

LENGTH = 400
GRAM = 16
NEIGHBOURS = 200
#: A trigger lies so far from the start of its strings at least, and has so many bytes in front and after in common.
LEAD = (LENGTH - NEIGHBOURS) // 2
TAIL = LENGTH - NEIGHBOURS - LEAD + 1
#: Longer texts are parsed in parts of so many strings.
PART = 1 << 18
#: Phrases that are compared in one task, at most: about 2 MB, and a second or two. A trigger with more is split.
SIDE_BY_SIDE = 2_000
#: Rows of ids that may be broadcast, of 16 bytes each; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
LOWEST = -(2**63)

_rng = np.random.default_rng(400)
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_powers: list[np.ndarray] = []


def _power_tables() -> list[np.ndarray]:
    if not _powers:
        for b in (_BASE, _INVERSE):
            table = np.full(PART + LENGTH, b, dtype=np.uint64)
            table[0] = 1
            _powers.append(np.cumprod(table, dtype=np.uint64))
    return _powers


def _least_of_neighbours(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` values in a row, from running minima of blocks in both directions."""
    n = len(v) - width + 1
    padded = np.full(-(-len(v) // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(v)] = v
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def triggers(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trigger, first string, last string) of each phrase of some bytes; strings are given by their starts."""
    n = len(data)
    power, inverse = _power_tables()
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * power[:n], out=sums[1:])
    at = np.arange(LEAD, n - LENGTH + LEAD + NEIGHBOURS, dtype=np.int64)
    h = (sums[at[0] + GRAM : at[-1] + GRAM + 1] - sums[at[0] : at[-1] + 1]) * inverse[at[0] : at[-1] + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h = (h & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    chosen = (_least_of_neighbours(h, NEIGHBOURS) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
    last = np.concatenate([first[1:], [len(chosen)]]) - 1
    return chosen[first], first, last


def phrases(data: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
    """(trigger's key, phrase's hash, trigger, its distance from the first and from the last string) of each phrase."""
    for begin in range(0, len(data) - LENGTH + 1, PART):
        part = data[begin : begin + PART + LENGTH - 1]
        raw = part.tobytes()
        for x, lo, hi in zip(*(a.tolist() for a in triggers(part)), strict=True):
            key = xxhash.xxh3_64_intdigest(raw[x - LEAD : x + TAIL])
            whole = xxhash.xxh3_64_intdigest(raw[lo : hi + LENGTH], seed=(x - lo) << 16 | (x - hi))
            yield key - 2**63, whole - 2**63, begin + x, x - lo, x - hi


def _bytes_of(column: pa.Array) -> Iterator[np.ndarray]:
    for t in column:
        yield np.frombuffer((t.as_py() or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)


PARSED = "key long, phrase long, at long, tie long, x long, lo int, hi int"


def _parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in freed(batches):
        docs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _bytes_of(batch.column(2)), strict=True)
        out: list[list] = [[] for _ in range(7)]
        for at, tie, data in docs:
            for key, whole, x, lo, hi in phrases(data):
                for k, v in enumerate((key, whole, at, tie, x, lo, hi)):
                    out[k].append(v)
        yield pa.record_batch([pa.array(c, pa.int64() if k < 5 else pa.int32()) for k, c in enumerate(out)], names=["key", "phrase", "at", "tie", "x", "lo", "hi"])


PHRASE = "key long, m long, at long, tie long, x long, lo int, hi int, bytes binary"


def _cut_out(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the phrases that are asked for in each text."""
    for batch in freed(batches):
        out: list[list] = [[] for _ in range(8)]
        for at, tie, data, asked in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _bytes_of(batch.column(2)), batch.column(3).to_pylist(), strict=True):
            for p in asked:
                raw = data[p["x"] - p["lo"] : p["x"] - p["hi"] + LENGTH].tobytes()
                for k, v in enumerate((p["key"], p["m"], at, tie, p["x"], p["lo"], p["hi"], raw)):
                    out[k].append(v)
        kinds = [pa.int64()] * 5 + [pa.int32()] * 2 + [pa.binary()]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=[x.split()[0] for x in PHRASE.split(", ")])


SPAN = "at long, tie long, start long, stop long"


def _spans(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    return pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=["at", "tie", "start", "stop"])


def repeated_places(group: list[tuple[int, int, int, bytes]]) -> list[list[int]]:
    """For phrases (count, lo, hi, bytes) with one trigger, the distances at which a string of each repeats in another.

    A phrase that occurs twice repeats whole anyway, so nothing is told of it.
    """
    found: list[list[int]] = [[] for _ in group]
    for s in range(min(g[2] for g in group), max(g[1] for g in group) + 1):
        seen: dict[bytes, int] = {}
        for k, (_, lo, hi, raw) in enumerate(group):
            if hi <= s <= lo:
                digest = xxhash.xxh3_128_digest(raw[lo - s : lo - s + LENGTH])
                before = seen.setdefault(digest, k)
                if before != k:
                    for i in (before, k):
                        if group[i][0] == 1 and (not found[i] or found[i][-1] != s):
                            found[i].append(s)
    return found


def _compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Phrases come sorted by trigger; a group is held until the next begins."""
    held: list[dict] = []

    def close() -> list[tuple[int, int, int, int]]:
        places = repeated_places([(g["m"], g["lo"], g["hi"], g["bytes"]) for g in held]) if len(held) > 1 else []
        out = []
        for g, found in zip(held, places, strict=False):
            for a, b in runs(sorted(g["x"] - s for s in found)):
                out.append((g["at"], g["tie"], a, b + LENGTH))
        return out

    for batch in freed(batches):
        done: list[tuple[int, int, int, int]] = []
        for row in batch.to_pylist():
            if held and held[0]["key"] != row["key"]:
                done += close()
                held = []
            held.append(row)
        yield _spans(done)
    yield _spans(close())


def runs(sorted_places: list[int]) -> Iterator[tuple[int, int]]:
    """First and last of each run of neighbours."""
    for k, p in enumerate(sorted_places):
        if k == 0 or p != sorted_places[k - 1] + 1:
            first = p
        if k + 1 == len(sorted_places) or sorted_places[k + 1] != p + 1:
            yield first, p


NODE = f"{PHRASE}, a int, b int"
HALF = NODE.replace("m long", "phrase long, m long")


def halves(a: int, b: int, lo: int, hi: int, raw: bytes) -> Iterator[tuple[int, int, int, int, bytes, int, int]]:
    """(key, phrase, lo, hi, bytes, a, b) of what a phrase has in each half of the distances a to b.

    The key is of the bytes that all strings of the half share, the phrase of those that this phrase has there.
    """
    middle = (a + b) // 2
    for a2, b2 in ((a, middle), (middle + 1, b)):
        lo2, hi2 = min(lo, b2), max(hi, a2)
        if hi2 <= lo2:
            part = raw[lo - lo2 : lo - hi2 + LENGTH]
            key = xxhash.xxh3_64_intdigest(part[lo2 - a2 : lo2 + LENGTH - b2], seed=a2 << 16 | b2)
            whole = xxhash.xxh3_64_intdigest(part, seed=1 << 32 | lo2 << 16 | hi2)
            yield key - 2**63, whole - 2**63, lo2, hi2, part, a2, b2


def _halve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in HALF.split(", ")]
    kinds = [pa.int64()] * 6 + [pa.int32()] * 2 + [pa.binary()] + [pa.int32()] * 2
    for batch in freed(batches):
        out: list[list] = [[] for _ in names]
        for g in batch.to_pylist():
            for key, whole, lo, hi, part, a, b in halves(g["a"], g["b"], g["lo"], g["hi"], g["bytes"]):
                for k, v in enumerate((key, whole, g["m"], g["at"], g["tie"], g["x"], lo, hi, part, a, b)):
                    out[k].append(v)
        yield pa.record_batch([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=names)


CUT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def merged(spans: Iterable[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def without(data: bytes, spans: list[list[int]]) -> bytes:
    ends = [0, *(b for _, b in spans)]
    return b"".join(data[a:b] for a, b in zip(ends, [*(a for a, _ in spans), len(data)], strict=True))


def _remove(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in freed(batches):
        out: list[list] = [[] for _ in range(4)]
        for data, spans in zip(_bytes_of(batch.column(2)), batch.column(3).to_pylist(), strict=True):
            gone = merged((s["start"], s["stop"]) for s in spans)
            kept = without(data.tobytes(), gone)
            for k, v in enumerate((len(data), len(data) - len(kept), len(gone), hashlib.sha256(kept).hexdigest())):
                out[k].append(v)
        cols = [pa.array(c, pa.int64()) for c in out[:3]] + [pa.array(out[3], pa.string())]
        yield pa.record_batch([batch.column(0), batch.column(1), *cols], names=["at", "tie", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """docs joined with wanted, a table with one row for each (at, tie) that it needs texts of.

    Up to a bound, the ids are broadcast first, so that only the texts asked for are shuffled.
    """
    ids = ["at", "tie"]
    if wanted.count() <= BROADCAST_ROWS:
        docs = docs.join(F.broadcast(wanted.select(*ids)), ids, "left_semi")
    return docs.join(wanted, ids)


def _span(df: DataFrame) -> DataFrame:
    """The bytes that all strings of a phrase cover."""
    return df.select("at", "tie", (F.col("x") - F.col("lo")).alias("start"), (F.col("x") - F.col("hi") + LENGTH).alias("stop"))


def _cut(docs: DataFrame, phrases: DataFrame, name: str) -> DataFrame:
    """The given phrases of docs, with their bytes."""
    asked = phrases.groupBy("at", "tie").agg(F.collect_list(F.struct("key", "m", "x", "lo", "hi")).alias("asked"))
    asked = written(asked, f"asked_{name}")
    return _texts(docs, asked).select("at", "tie", "text", "asked").mapInArrow(_cut_out, PHRASE)


def _sizes(phrases: DataFrame) -> DataFrame:
    """(key, n): how many different phrases a key has, where it has more than one."""
    return phrases.select("key", "phrase").distinct().groupBy("key").agg(F.count("*").alias("n")).where("n > 1")


def _split(hot: DataFrame, side_by_side: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """(spans, phrases): of phrases whose triggers have too many for a task, spans that repeat, and parts that are left to compare.

    Eight rounds at most halve the distances down to one, at which phrases with one key are equal.
    """
    spans, few = [], []
    names = [x.split()[0] for x in NODE.split(", ")]
    hot = written(hot.withColumn("a", F.lit(LEAD)).withColumn("b", F.lit(LEAD + NEIGHBOURS - 1)), "hot")
    while not hot.isEmpty():
        parts = written(hot.mapInArrow(_halve, HALF), "halves")
        copies = parts.groupBy("key", "phrase").agg(F.sum("m").alias("copies")).where("copies > 1").select("key", "phrase")
        spans.append(_span(parts.where("m = 1").join(copies, ["key", "phrase"], "left_semi")))
        one = [F.first(c).alias(c) for c in names if c not in ("key", "m")]
        left = parts.join(_sizes(parts), "key").groupBy("key", "phrase").agg(F.sum("m").alias("m"), F.first("n").alias("n"), *one)
        left = written(left.select(*names, "n"), "left")
        few.append(left.where(F.col("n") <= side_by_side).select(*names[:-2]))
        hot = left.where(F.col("n") > side_by_side).select(*names)
    return spans, few


def repeated_spans(docs: DataFrame, side_by_side: int = SIDE_BY_SIDE) -> DataFrame:
    """(at, tie, start, stop): spans of 400 bytes or more of (at, tie, text) whose every 400-byte string repeats somewhere."""
    spark = docs.sparkSession
    parse = written(docs.mapInArrow(_parse, PARSED), "parse")
    one = [F.first(c).alias(c) for c in ("at", "tie", "x", "lo", "hi")]
    dictionary = parse.groupBy("key", "phrase").agg(F.count("*").alias("m"), *one).join(_sizes(parse), "key", "left")
    dictionary = written(dictionary.where("m > 1 or n > 1"), "dictionary")
    spans = [_span(parse.join(dictionary.where("m > 1").select("key", "phrase"), ["key", "phrase"], "left_semi"))]
    few = [_cut(docs, dictionary.where(F.col("n") <= side_by_side), "few")]
    many = dictionary.where(F.col("n") > side_by_side)
    if not many.isEmpty():
        more, parts = _split(_cut(docs, many, "many"), side_by_side)
        spans, few = spans + more, few + parts
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    beside = reduce(DataFrame.unionByName, few)
    beside = beside.repartition(tasks, "key").sortWithinPartitions("key").mapInArrow(_compare, SPAN)
    return reduce(DataFrame.unionByName, spans).unionByName(beside)


def remove_repeats(docs: DataFrame, *, side_by_side: int = SIDE_BY_SIDE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), a row for each row of docs.

    Removed is each byte covered by a 400-byte string that also starts anywhere else, in the same text or another; texts
    are their UTF-8 bytes, null is empty, and no match crosses texts. Shorter texts lose nothing. Repeated rows repeat each
    other; null ids are told apart by their texts; an empty table gives no rows. Spans and phrases of a text are at most
    one for each 400 bytes or so and travel with it; all else is joined or grouped by Spark.
    """
    ship(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST)).alias("at"),
        F.xxhash64(text).alias("tie"),
        text.alias("text"),
    )
    texts = rows.select("at", "tie", "text").where(F.octet_length("text") >= LENGTH)
    spans = repeated_spans(texts, side_by_side).groupBy("at", "tie").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    spans = written(spans, "spans")
    names = ["at", "tie", "text", "spans"]
    changed = _texts(texts, spans).select(*names).mapInArrow(_remove, f"at long, tie long, {CUT}")
    changed = changed.drop("n_bytes").dropDuplicates(["at", "tie"])
    plain = rows.select("doc_id", "at", "tie", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    return plain.join(changed, ["at", "tie"], "left").select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"),
    )


def op7_substrings(spark, sf_dir):
    return remove_repeats(documents(spark, sf_dir))
