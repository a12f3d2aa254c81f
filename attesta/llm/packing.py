"""Hierarchical residual best-fit packing of token pieces into sequences.

Documents are tokenized and cut; pieces are dealt to partitions at random, so that each sees pieces of all lengths, and
packed best-fit there (largest first). Bins that are nearly full, or that no other bin can still go with, are closed. The
others travel, with their pieces, as items of their fill up a tree: tasks of a level merge the open bins of several tasks
below by best fit again, until one task at the top has what is left. After best fit a task has at most one bin that is no
more than half full, and each merge takes such a bin; so that one goes up with the emptiest of the others, a fixed number.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, documents, freed, pieces_for, ship, written

CAPACITY = 2048
END = 0
#: A bin with at most so many free tokens is closed at once.
NEARLY_FULL = 4
#: Tasks whose open bins one task of the next level merges.
FAN_IN = 16
#: Bins over half full that a task sends up, for those that are less full in other tasks.
HOSTS = 64
#: Pieces that one task packs.
PIECES = 50_000
VOCABULARY = "byte_bpe_50k"
#: Words whose ids a Python worker keeps, the first that it meets, as common ones are; of others ids are made each time.
KEPT_WORDS = 340_000

BIN = "bin long, fill int, open boolean, node int, doc_id array<long>, piece array<int>, start array<long>, length array<int>, ids_crc32 array<long>, offset array<int>"
_PARTS = (("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64()), ("offset", pa.int32()))
_ARROW = pa.schema([("bin", pa.int64()), ("fill", pa.int32()), ("open", pa.bool_()), ("node", pa.int32()), *((n, pa.list_(t)) for n, t in _PARTS)])

# The byte-level BPE vocabulary splits text by this rule before merging:
#   's|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+
# In texts of the characters of PLAIN, the rule below is the same.
_LETTER = "A-Za-zÀ-ÖØ-öø-ſ"
_PLAIN = re.compile(rf"[\n -~{_LETTER}]*")
_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[0-9]+| ?[^ \n0-9{_LETTER}]+|[ \n]+(?![^ \n])|[ \n]+")


class Ids:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes, all made by the tokenizers library.

    In texts of the characters of PLAIN, words are split here and the ids of a word are kept.
    """

    def __init__(self, vocabulary: str):
        import public_tokenizers as files
        from tokenizers import Tokenizer

        self._full = Tokenizer.from_file(files.path(f"{vocabulary}.json"))
        self._line_end = self._full.encode("\n", add_special_tokens=False).ids[0]
        self._words: dict[str, bytes] = {}

    def __call__(self, text: str) -> bytes:
        if "<|endoftext|>" in text or not _PLAIN.fullmatch(text):
            return np.array(self._full.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        words, kept = _SPLIT.findall(text), self._words
        try:
            return b"".join(map(kept.__getitem__, words))
        except KeyError:
            pass
        new = [w for w in dict.fromkeys(words) if w not in kept]
        lines = [w for w in new if w.strip(" ") and "\n" not in w]
        # lines of one word each are split between words and at line ends only, so one call serves all
        ids = np.array(self._full.encode("\n".join(lines), add_special_tokens=False).ids, dtype="<u4")
        found: dict[str, bytes] = {}
        for w, part in zip(lines, np.split(ids, np.flatnonzero(ids == self._line_end)), strict=bool(lines)):
            found[w] = part[bool(found) :].tobytes()
        for w in new:
            if w not in found:
                found[w] = np.array(self._full.encode(w, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if len(kept) + len(found) <= KEPT_WORDS:
            kept.update(found)
        return b"".join([kept.get(w) or found[w] for w in words])


_ids: dict[str, Ids] = {}


def ids_of(vocabulary: str) -> Ids:
    if vocabulary not in _ids:
        _ids[vocabulary] = Ids(vocabulary)
    return _ids[vocabulary]


def cut(n: int, capacity: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole ones of `capacity` after a first one with the rest."""
    at, step = 0, n % capacity or capacity
    while at < n:
        yield at, step
        at += step
        step = capacity


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of indices of sizes: largest first, each into the fullest bin that has room."""
    bins: list[list[int]] = []
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    some = 0  # bit r: a bin with r free
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        n = sizes[i]
        if fit := some >> n:
            room = n + (fit & -fit).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                some &= ~(1 << room)
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        if room > n:
            free[room - n].append(b)
            some |= 1 << (room - n)
    return bins


def _emit(rows: list[tuple], level: int, capacity: int, least: int, hosts: int) -> Iterator[pa.RecordBatch]:
    """rows: (fill, six lists), each an item; packs them and yields one row a bin.

    Open stay the bin that is at most half full, and of the others those with the most room, if it is for `least` tokens.
    """
    task = TaskContext.get().partitionId()
    packed = best_fit([r[0] for r in rows], capacity)
    fills = [sum(rows[i][0] for i in members) for members in packed]
    roomy = sorted((f, b) for b, f in enumerate(fills) if capacity // 2 < f <= capacity - least)
    opened = {b for _, b in roomy[:hosts]} | {b for b, f in enumerate(fills) if f <= capacity // 2 and f <= capacity - least}
    out: list[list] = [[] for _ in range(4 + len(_PARTS))]
    for b, members in enumerate(packed):
        lists: list[list] = [[] for _ in _PARTS]
        fill = 0
        for i in members:
            size, *parts = rows[i]
            for k in range(5):
                lists[k] += parts[k]
            lists[5] += [x + fill for x in parts[5]]
            fill += size
        for k, v in enumerate(((level << 56) | (task << 28) | b, fill, b in opened, task, *lists)):
            out[k].append(v)
        if len(out[0]) == 2000:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(out, _ARROW, strict=True)], schema=_ARROW)
            out = [[] for _ in out]
    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(out, _ARROW, strict=True)], schema=_ARROW)


PIECE = "doc_id long, piece int, start long, length int, ids_crc32 long"


def _tokenize(vocabulary: str, capacity: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, end = ids_of(vocabulary), END.to_bytes(4, "little")
        for batch in freed(batches):
            out: list[list] = [[] for _ in range(5)]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = memoryview(ids(text.as_py() or "") + end)
                for k, (start, n) in enumerate(cut(len(data) // 4, capacity)):
                    for c, v in zip(out, (doc_id, k, start, n, zlib.crc32(data[4 * start : 4 * (start + n)])), strict=True):
                        c.append(v)
            yield pa.record_batch([pa.array(c, t) for c, (_, t) in zip(out, _PARTS, strict=False)], names=[n for n, _ in _PARTS[:5]])

    return run


def _pack(capacity: int, least: int, hosts: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in freed(batches):
            for doc_id, k, start, n, crc in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows.append((n, [doc_id], [k], [start], [n], [crc], [0]))
        yield from _emit(rows, 0, capacity, least, hosts)

    return run


def _merge(level: int, capacity: int, least: int, hosts: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [tuple(r.values()) for batch in freed(batches) for r in batch.select(["fill", *(n for n, _ in _PARTS)]).to_pylist()]
        yield from _emit(rows, level, capacity, least, hosts)

    return run


def pack_documents(
    docs: DataFrame,
    *,
    vocabulary: str = VOCABULARY,
    capacity: int = CAPACITY,
    nearly_full: int = NEARLY_FULL,
    fan_in: int = FAN_IN,
    hosts: int = HOSTS,
    pieces: int = PIECES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), a row for each piece of each row of docs.

    A document is the ids of its whole text (null: empty, so END alone) and END; longer ones than the capacity are cut
    into pieces of the capacity, the first of which may be shorter. Offsets are gapless from 0 in each sequence. Each row
    of docs is packed, also one with a repeated or null id or a repeated text; other columns of any name play no role; an
    empty table gives no rows. Open bins go up the tree to its one root, at every size. A task holds about `pieces` pieces, at higher
    levels at most fan_in * (hosts + 1) bins. Bins with no room for the shortest piece or open bin, or with at most
    nearly_full free tokens, are closed.
    """
    spark = docs.sparkSession
    ship(spark)
    source = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).alias("text"))
    cuts = written(source.mapInArrow(_tokenize(vocabulary, capacity), PIECE), "pieces")
    short = cuts.where(F.col("length") < capacity)
    state = short.agg(F.count("*").alias("n"), F.min("length").alias("least")).first()
    # whole pieces are sequences of their own; the numbers of others are not negative
    alone = cuts.where(F.col("length") == capacity).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    least, nodes, level, tables = state.least or 1, pieces_for(state.n, pieces), 0, []
    work, task = short.repartition(nodes), _pack(capacity, max(least, nearly_full + 1), hosts)
    while True:
        bins = written(work.mapInArrow(task, BIN), f"bins_{level}")
        state = bins.where("open").agg(F.count("*").alias("n"), F.min("fill").alias("least")).first()
        if nodes == 1 or not state.n:
            tables.append(bins)
            break
        tables.append(bins.where("not open"))
        level, before, nodes = level + 1, nodes, pieces_for(nodes, fan_in)
        node = F.floor(F.col("node") * F.lit(nodes) / F.lit(before)).cast("int")
        work = bins.where("open").repartition(nodes, node) if nodes > 1 else bins.where("open").coalesce(1)
        task = _merge(level, capacity, max(state.least, nearly_full + 1), hosts)
    every = tables[0]
    for t in tables[1:]:
        every = every.unionByName(t)
    names = [n for n, _ in _PARTS]
    packed = every.select("bin", F.explode(F.arrays_zip(*names)).alias("p")).select("p.*", F.col("bin").alias("sequence_id"))
    columns = [*names[:3], F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", F.col("offset").cast("long").alias("offset")]
    return packed.select(*columns).unionByName(alone.select(*columns))


def op10_packing(spark, sf_dir):
    return pack_documents(documents(spark, sf_dir))
