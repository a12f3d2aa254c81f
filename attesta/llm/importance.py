"""Importance resampling towards a target distribution, over hashed n-gram buckets.

The document-by-bucket counts are stored once as blocks in compressed sparse row form (CSR). Its column sums are the
distribution of the corpus, those of the target's matrix the wanted one; a bucket's gain is the logarithm of their ratio,
and the product of the matrix with the vector of gains gives the weights. Documents are then drawn without replacement by
Gumbel keys: the highest sums of weight and key are a sample in proportion to the weights.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, documents, freed, numbered, ship, written

BUCKETS = 10_000
LONGEST = 1
LEAST_WORDS = 20
PERCENT = 10
SEED = "2024"
#: Bytes of a text that are cut into words at once, about; and words whose buckets a worker keeps.
SLICE = 1 << 20
KEPT_WORDS = 1 << 18

_WORD_BYTES = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyz") | frozenset(range(0x80, 0x100))
#: A-Z become a-z, and what is in no word becomes a space.
_PLAIN = bytes(x if x in _WORD_BYTES else x + 32 if 0x41 <= x <= 0x5A else 0x20 for x in range(256))


class _Buckets(dict):
    """Buckets of byte strings; at most KEPT_WORDS are kept."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        found = self[word] = zlib.crc32(word) % self.buckets
        return found


def _word_lists(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in order, some at a time; a word is never cut."""
    plain, at = text.translate(_PLAIN), 0
    while at < len(plain):
        end = plain.find(b" ", at + SLICE)
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


def _features(text: bytes, buckets: _Buckets, longest: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(buckets, their counts, words, features) of a text."""
    total, words, features, tail = None, 0, 0, []
    for found in _word_lists(text):
        parts = [list(map(buckets.__getitem__, found))]
        words += len(found)
        joined = [*tail, *found]
        for n in range(2, longest + 1):
            # runs that end in this slice
            first = max(0, len(tail) - n + 1)
            parts.append([buckets[b" ".join(joined[i : i + n])] for i in range(first, len(joined) - n + 1)])
        tail = joined[len(joined) - longest + 1 :] if longest > 1 else []
        ids = np.array([x for p in parts for x in p], dtype=np.int64)
        features += len(ids)
        kinds, counts = np.unique(ids, return_counts=True)
        if total is None:
            total = (kinds, counts)
        else:
            both = np.concatenate([total[0], kinds])
            kinds, where = np.unique(both, return_inverse=True)
            sums = np.zeros(len(kinds), dtype=np.int64)
            np.add.at(sums, where, np.concatenate([total[1], counts]))
            total = (kinds, sums)
    kinds, counts = total if total is not None else (np.empty(0, np.int64), np.empty(0, np.int64))
    return kinds, counts, words, features


def count_matrix(rows: DataFrame, *, id_col: str | None = "doc_id", text_col: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """The sparse matrix of counts: a row for each block of rows, in CSR form.

    ids and words have a value for each row of a block; pointers one more: row r has the entries pointers[r] to
    pointers[r + 1] of indices (buckets, ascending) and counts. The last two are little-endian 32- and 64-bit integers.
    Whole texts count; a null text has no words. Rows are not moved.
    """
    ship(rows.sparkSession)
    kind = rows.schema[id_col].dataType if id_col else T.LongType()
    schema = T.StructType([T.StructField("ids", T.ArrayType(kind)), T.StructField("words", T.ArrayType(T.LongType())), T.StructField("features", T.ArrayType(T.LongType())), T.StructField("pointers", T.ArrayType(T.LongType())), T.StructField("indices", T.BinaryType()), T.StructField("counts", T.BinaryType())])

    def blocks(batches):
        known = _Buckets(buckets)
        for batch in batches:
            if not batch.num_rows:
                continue
            words, features, pointers, indices, counts = [], [], [0], [], []
            for text in batch.column(1):
                k, c, w, f = _features(text.as_py() or b"", known, longest)
                words.append(w)
                features.append(f)
                pointers.append(pointers[-1] + len(k))
                indices.append(k.astype("<u4"))
                counts.append(c.astype("<i8"))
            ids = batch.column(0)
            one = [
                pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                pa.array([words], pa.list_(pa.int64())),
                pa.array([features], pa.list_(pa.int64())),
                pa.array([pointers], pa.list_(pa.int64())),
                pa.array([np.concatenate(indices).tobytes()], pa.binary()),
                pa.array([np.concatenate(counts).tobytes()], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(one, names=["ids", "words", "features", "pointers", "indices", "counts"])

    chosen = rows.select((column(id_col) if id_col else F.lit(None).cast("long")).alias("ids"), column(text_col).cast("binary").alias("text"))
    return chosen.mapInArrow(lambda b: freed(blocks(b)), schema)


def column_sums(matrix: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Counts of each bucket in the whole matrix; each task adds its blocks up first, and `buckets` numbers come to the driver."""

    def sums(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for i, c in zip(batch.column("indices"), batch.column("counts"), strict=True):
                np.add.at(total, np.frombuffer(i.as_buffer(), "<u4"), np.frombuffer(c.as_buffer(), "<i8"))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["bucket", "n"])

    out = np.zeros(buckets, dtype=object)
    for r in matrix.select("indices", "counts").mapInArrow(sums, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Gain of each bucket: a thousand times the logarithm of the ratio of its smoothed shares, rounded down."""
    n, s_all, t_all = len(corpus), int(sum(corpus)), int(sum(target))
    return np.array([math.floor(1000 * math.log(((int(t) + 1) * (s_all + n)) / ((int(s) + 1) * (t_all + n)))) for s, t in zip(corpus, target, strict=True)], dtype=np.int64)


def gumbel_key(seed: str, doc_id: object) -> int:
    """A thousand times a Gumbel variate that the seed and the id decide, rounded down; a null id has the name of no id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scores(matrix: DataFrame, gain: np.ndarray, seed: str = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score): the product of the matrix with the gains, over the features' number."""
    kind = matrix.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("doc_id", kind), *(T.StructField(n, T.LongType()) for n in ("n_words", "n_features", "weight", "score"))])

    def product(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                ids, words, features, pointers = (batch.column(n)[r].values for n in ("ids", "words", "features", "pointers"))
                at = np.asarray(pointers)
                each = gain[np.frombuffer(batch.column("indices")[r].as_buffer(), "<u4")] * np.frombuffer(batch.column("counts")[r].as_buffer(), "<i8")
                running = np.concatenate([[0], np.cumsum(each)]).astype(np.int64)
                n = np.asarray(features)
                weight = (running[at[1:]] - running[at[:-1]]) // np.maximum(n, 1)
                score = [w + gumbel_key(seed, i) for w, i in zip(weight.tolist(), ids.to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([ids, words, features, pa.array(weight, pa.int64()), pa.array(score, pa.int64())], names=schema.names)

    return matrix.mapInArrow(product, schema)


def resample(
    docs: DataFrame,
    target: DataFrame,
    *,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    buckets: int = BUCKETS,
    longest: int = LONGEST,
    seed: str = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank), a row for each row of docs.

    Of the N rows with at least least_words words, the floor(percent * N / 100) highest scores are drawn; their rank
    counts from 1 by score, then the smaller id (a null id last). All else has no rank. Weights are floored means of the
    gains of a row's features, repeats counted; a row without words, or with a null or empty text, has weight 0. Equal ids
    have equal keys; which of rows with equal id and score comes first follows from their features, and rows alike in
    all of these are interchangeable. An empty table gives no rows, an empty target gains from its smoothed shares alone.
    Other columns of docs play no role, whatever their names.
    """
    matrix = written(count_matrix(docs, id_col=id_col, text_col=text_col, buckets=buckets, longest=longest), "importance_matrix")
    wanted = column_sums(count_matrix(target, id_col=None, text_col=target_text_col, buckets=buckets, longest=longest), buckets)
    gain = gains(column_sums(matrix, buckets), wanted)
    scored = written(scores(matrix, gain, seed), "importance_scores")
    enough = F.col("n_words") >= least_words
    # scores are whole numbers within a thousand times the logarithms of doubles: some 100,000 rows at most
    by_score = sorted(((r.score, r["count"]) for r in scored.where(enough).groupBy("score").count().collect()), reverse=True)
    draw, seen, lowest = percent * sum(n for _, n in by_score) // 100, 0, None
    for score, n in by_score:
        if seen >= draw:
            break
        seen, lowest = seen + n, score
    shown = ["doc_id", "n_features", "weight", "score"]
    if lowest is None:
        return scored.select(*shown, F.lit(None).cast("long").alias("rank"))
    reached = enough & (F.col("score") >= lowest)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features").asc()]
    ranked = numbered(scored.where(reached).select(*shown), order, "importance_ranks")
    rank = F.when(F.col("nth") < draw, F.col("nth") + 1).cast("long")
    return ranked.select(*shown, rank.alias("rank")).unionByName(scored.where(~reached).select(*shown, F.lit(None).cast("long").alias("rank")))


def op11_importance(spark, sf_dir):
    return resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_WORD_SQL = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"
#: The table of crc32 by its rule, and the checksum of a text, bytewise; for SQL without such a function.
CRC_TABLE = "SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS tab FROM range(256) AS r(i)"


def crc_sql(text: str) -> str:
    each = f"list_transform(range(octet_length(encode({text}))), lambda i: CAST('0x' || hex(encode({text}))[2 * i + 1 : 2 * i + 2] AS BIGINT))"
    return f"xor(list_reduce({each}, lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"


ORACLE = f"""
WITH crc AS MATERIALIZED ({CRC_TABLE}),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORD_SQL} AS words FROM documents),
b AS (SELECT {_WORD_SQL} AS words FROM benchmark),
dw AS MATERIALIZED (SELECT r, word, count(*) AS c FROM (SELECT r, unnest(words) AS word FROM d) GROUP BY ALL),
bw AS MATERIALIZED (SELECT word, count(*) AS c FROM (SELECT unnest(words) AS word FROM b) GROUP BY ALL),
k AS MATERIALIZED (SELECT word, {crc_sql("word")} % {BUCKETS} AS bucket FROM (SELECT word FROM dw UNION SELECT word FROM bw), crc),
s AS (SELECT bucket, sum(c) AS s FROM dw JOIN k USING (word) GROUP BY 1),
t AS (SELECT bucket, sum(c) AS t FROM bw JOIN k USING (word) GROUP BY 1),
a AS (SELECT coalesce((SELECT sum(s) FROM s), 0) AS s_all, coalesce((SELECT sum(t) FROM t), 0) AS t_all),
g AS MATERIALIZED (SELECT bucket, CAST(floor(1000 * ln((CAST(coalesce(t, 0) AS DOUBLE) + 1) * (s_all + {BUCKETS}) / ((CAST(coalesce(s, 0) AS DOUBLE) + 1) * (t_all + {BUCKETS})))) AS BIGINT) AS gain FROM s FULL JOIN t USING (bucket), a),
w AS (SELECT r, CAST(floor(sum(c * gain) / CAST(sum(c) AS DOUBLE)) AS BIGINT) AS weight FROM dw JOIN k USING (word) JOIN g USING (bucket) GROUP BY r),
x AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, CAST('0x' || sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8] AS BIGINT) AS h FROM d LEFT JOIN w USING (r)),
y AS (SELECT doc_id, n_features, weight, CAST(weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM x),
n AS (SELECT {PERCENT} * count(*) // 100 AS draw FROM y WHERE n_features >= {LEAST_WORDS}),
z AS (SELECT *, CASE WHEN n_features >= {LEAST_WORDS} THEN row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS} ORDER BY score DESC, doc_id NULLS LAST, n_features) END AS nth FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN nth <= draw THEN nth END AS rank FROM z, n
"""
