"""N-gram Jaccard join of documents: grouped prefix join, exact, with components in place of all pairs.

1. Documents with equal shingle sets are one unit; units with the same size and the same prefix are one group.
2. Of a set of n in some order, a partner shares one of the first n - ceil(0.8 n) + 1. Prefixes are first taken by hash
   and their shingles counted exactly; units with one that is in more than SHORT prefixes have further ones counted, as
   many as may take its place, and prefixes are picked again with all that is common at the end. The order decides only
   how many candidates there are, never which links are found.
3. A shared prefix shingle lists groups. Each member of a list is first verified against one hub of the list. What hubs
   link is one component, and pairs inside a component need no further look.
4. In short lists, pairs of groups with members in different components are expanded to these members and verified.
5. A long list isn't paired with itself: each member is reduced to what sets it apart from the list's hub, a set that is
   small for near copies of a central hub and foremost holds shingles that few others have. Two members that aren't both linked with the
   hub can link only if these differences share elements, so a second prefix join, of the differences, gives the pairs.
That is exact: every link either was verified or lies inside a component.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import column, discard, documents, freed, release, ship, written
from .components import components

WORDS = 5
#: Links: intersection / union >= NUM / DEN.
NUM, DEN = 4, 5
ROUNDS = 1
#: Lists with at most so many members are paired with themselves; shingles in more prefixes are common.
SHORT = 16
#: The commonest shingles, of 9 bytes each, go to all tasks; where more are common, the others are ordered by hash.
MOST_COMMON = 1 << 20
#: Steps in which a common shingle's count is kept, for each doubling.
STEPS = 8
#: Ids of candidates that may be broadcast, of 8 bytes each; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
LOWEST = -(2**63)

_rng = np.random.default_rng(5)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)[_FOLD]
_GAP = np.zeros(256, dtype=bool)
_GAP[[32, 9, 10, 11, 12, 13]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_C = np.uint64(0xBF58476D1CE4E5B9)
_PART = 1 << 17
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        _powers.clear()
        for b in (_BASE, _INVERSE):
            table = np.full(size, b, dtype=np.uint64)
            table[0] = 1
            _powers.append(np.cumprod(table, dtype=np.uint64))
    return _powers


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words of UTF-8 bytes in order, capitals A-Z folded."""
    gap = _GAP[data]
    edges = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8)))
    starts, stops = edges[::2], edges[1::2]
    out, first = [], 0
    while first < len(starts):
        # words that begin within a part's length of each other are hashed together
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + _PART)))
        a, b = starts[first], stops[last - 1]
        power, inverse = _power_tables(b - a + 1)
        sums = np.zeros(b - a + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data[a:b]] * power[: b - a], out=sums[1:])
        s, e = starts[first:last] - a, stops[first:last] - a
        out.append(_mixed((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64)))
        first = last
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the 5-word shingles; of the whole sequence where it is shorter; empty without words."""
    w = word_hashes(np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8))
    if not len(w):
        return w
    n = min(WORDS, len(w))
    h = np.full(len(w) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        h = h * _C + w[k : len(w) - n + 1 + k]
    return np.unique(_mixed(h))


def _sets(column: pa.Array) -> Iterator[np.ndarray]:
    for t in column:
        yield shingle_set(t.as_py())


#: Sorted common shingles (the upper 56 bits of their hashes) and how common each is, from 1 to 127.
Common = tuple[np.ndarray, np.ndarray]
NONE_COMMON: Common = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))


def places(tokens: np.ndarray, common: Common) -> tuple[np.ndarray, np.ndarray]:
    """For each token, where it would be among the common ones, and whether it is there."""
    if not len(common[0]):
        return np.zeros(len(tokens), dtype=np.int64), np.zeros(len(tokens), dtype=bool)
    at = np.minimum(np.searchsorted(common[0], tokens), len(common[0]) - 1)
    return at, common[0][at] == tokens


def order_keys(s: np.ndarray, common: Common) -> np.ndarray:
    """Sorted keys of a sorted set in the common order: how common in the high byte, then the hash."""
    keys = (s >> np.uint64(8)).astype(np.int64)
    at, there = places(keys, common)
    if there.any():
        keys[there] |= common[1][at[there]] << 56
        keys.sort()
    return keys


def commonness(counted: DataFrame) -> Common:
    """The common ones of (token, times), a row for each token; where they are too many, the commonest of them."""
    level = F.least(F.floor(F.log2(F.col("times") / SHORT) * STEPS) + 1, F.lit(127)).cast("int")
    counted = written(counted.where(F.col("times") > SHORT).select("token", level.alias("level")), "counted")
    least, room = 128, MOST_COMMON
    for r in counted.groupBy("level").count().orderBy(F.desc("level")).collect():
        room -= r["count"]
        if room < 0:
            break
        least = r["level"]
    table = counted.where(F.col("level") >= least).toArrow()
    discard(counted)
    tokens, levels = (table.column(c).to_numpy().astype(np.int64) for c in ("token", "level"))
    order = np.argsort(tokens)
    return tokens[order], levels[order]


def least_overlap(n):
    return -(-NUM * n // DEN)


def signature(s: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(s.tobytes()) - 2**63


PROFILE = "doc_id long, text_key long, n long, unit long, prefix array<long>"
HEAD = "unit long, n long, prefix array<long>"


def prefix_of(s: np.ndarray, common: Common) -> np.ndarray:
    return order_keys(s, common)[: len(s) - least_overlap(len(s)) + 1]


def _long_lists(values: list[np.ndarray | None]) -> pa.Array:
    return pa.array(values, pa.list_(pa.int64()))


def _profiles(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in freed(batches):
        n, unit, prefix = [], [], []
        for s in _sets(batch.column(1)):
            n.append(len(s)), unit.append(signature(s) if len(s) else None), prefix.append(prefix_of(s, NONE_COMMON) if len(s) else None)
        cols = [pa.array(n, pa.int64()), pa.array(unit, pa.int64()), _long_lists(prefix)]
        yield pa.record_batch([batch.column(0), batch.column(2), *cols], names=["doc_id", "text_key", "n", "unit", "prefix"])


def _with_common(common: Common, wanted: bool):
    """Of heads in the order of hashes, those with or without a common shingle in the prefix."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in freed(batches):
            prefix = batch.column(2)
            there = np.concatenate([[0], np.cumsum(places(prefix.flatten().to_numpy(zero_copy_only=False), common)[1])])
            ends = np.concatenate([[0], np.cumsum(prefix.value_lengths().to_numpy(zero_copy_only=False))])
            keep = pa.array((np.diff(there[ends]) > 0) == wanted)
            yield pa.record_batch([c.filter(keep) for c in batch.columns], names=batch.schema.names)

    return run


def _token_counts(common: Common):
    """(token, times) of the sets of each batch of texts, as far as prefixes without common shingles would reach."""

    def counted(s: np.ndarray) -> np.ndarray:
        keys = order_keys(s, NONE_COMMON)
        size = len(s) - least_overlap(len(s)) + 1
        rare = size - int(places(keys[:size], common)[1].sum())
        return keys[: size * size * 3 // (2 * rare) + 8] if rare else keys

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in freed(batches):
            sets = [counted(s) for s in _sets(batch.column(0))]
            token, times = np.unique(np.concatenate([*sets, NONE_COMMON[0]]), return_counts=True)
            yield pa.record_batch([pa.array(token, pa.int64()), pa.array(times, pa.int64())], names=["token", "times"])

    return run


def _heads(common: Common):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in freed(batches):
            sets = [s for s in _sets(batch.column(0)) if len(s)]
            cols = [pa.array([signature(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), _long_lists([prefix_of(s, common) for s in sets])]
            yield pa.record_batch(cols, names=["unit", "n", "prefix"])

    return run


def _packed_sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The unit and the set of each text."""
    for batch in freed(batches):
        sets = list(_sets(batch.column(0)))
        yield pa.record_batch([pa.array([signature(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["unit", "packed"])


def common_count(a: np.ndarray, b: np.ndarray) -> int:
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    return int(np.count_nonzero(both[1:] == both[:-1]))


def may_link(n_a: int, a: np.ndarray, n_b: int, b: np.ndarray) -> bool:
    """Whether sets of these sizes and prefixes can be similar.

    Up to the lesser of the last keys, the prefixes show all that the sets have; beyond, at most the smaller rest is shared.
    """
    end = min(a[-1], b[-1])
    rest = min(n_a - int(np.searchsorted(a, end, "right")), n_b - int(np.searchsorted(b, end, "right")))
    return (common_count(a, b) + rest) * (NUM + DEN) >= (n_a + n_b) * NUM


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether sorted sets have an intersection of at least NUM / DEN of their union."""
    shared = common_count(a, b)
    return DEN * shared >= NUM * (len(a) + len(b) - shared)


def _bounded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in freed(batches):
        rows = zip(batch.column(2).to_pylist(), batch.column(3), batch.column(4).to_pylist(), batch.column(5), strict=True)
        keep = [may_link(n, a.values.to_numpy(), m, b.values.to_numpy()) for n, a, m, b in rows]
        yield pa.record_batch([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])


def _verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in freed(batches):
        keep = [similar(np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8")) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
        yield pa.record_batch([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], names=["u", "v"])


def difference(hub: np.ndarray, s: np.ndarray, common: Common) -> tuple[int, bool, int, np.ndarray]:
    """Size of the difference of a set and its hub, whether they link, and the prefix of the difference, short and long.

    Sets link if and only if their difference is at most d / k of their sizes' sum, with d = DEN - NUM and k = DEN + NUM.
    What the set adds comes before what it lacks. A partner that may link has a difference of its own not smaller by more
    than that, for which the long prefix stands; where the partner's is not smaller at all, twice as much is shared, and
    the short prefix does. Pages with a text of their own round a frame that all have lack the same, but the short prefix
    of what they add is their own. Where the set is linked with the hub, the partner isn't, or both would be in one
    component; then both prefixes are the same.
    """
    more, less = np.setdiff1d(s, hub, assume_unique=True), np.setdiff1d(hub, s, assume_unique=True)
    size, k, d = len(more) + len(less), DEN + NUM, DEN - NUM
    near = k * size <= d * (len(s) + len(hub))
    if near:
        shared = least = (k * size + d * (len(hub) - len(s))) // (2 * k) + 1
    else:
        most = d * (len(s) + len(s) * DEN // NUM)
        shared, least = size - most // k, size - most // (2 * k)
    keys = np.concatenate([order_keys(more, common), order_keys(less, common)])
    return size, near, size - max(1, least) + 1, keys[: size - max(1, shared) + 1]


DIFFERENCE = "hub long, unit long, n long, size long, near boolean, short long, prefix array<long>"


def _differences(common: Common):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in freed(batches):
            n, size, near, short, prefix = [], [], [], [], []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                s = np.frombuffer(y.as_py(), "<u8")
                for out, v in zip((size, near, short, prefix), difference(np.frombuffer(x.as_py(), "<u8"), s, common), strict=True):
                    out.append(v)
                n.append(len(s))
            cols = [pa.array(n, pa.int64()), pa.array(size, pa.int64()), pa.array(near, pa.bool_()), pa.array(short, pa.int64()), pa.array(prefix, pa.list_(pa.int64()))]
            yield pa.record_batch([*batch.columns[:2], *cols], names=["hub", "unit", "n", "size", "near", "short", "prefix"])

    return run


def few(df: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


class Texts:
    """The texts of units, each from the one document that stands for it."""

    def __init__(self, docs: DataFrame, rows: DataFrame):
        """docs: (doc_id, text, text_key); rows: (doc_id, text_key, n, unit)."""
        at = F.coalesce("doc_id", F.lit(LOWEST)).alias("at")
        self.docs = docs.select(at, "text_key", "text")
        standing = rows.where("n > 0").groupBy("unit").agg(F.min(F.struct(at, "text_key")).alias("doc"), F.min("doc_id").alias("doc_id"))
        self.of = written(standing.select("unit", "doc.*", "doc_id"), "of")

    def read(self, units: DataFrame, name: str) -> DataFrame:
        """(text) of units, whose ids are written first; more than once where rows repeat an id and a text."""
        asked = written(self.of.join(units, "unit", "left_semi").select("at", "text_key").distinct(), name)
        return self.docs.join(few(asked), ["at", "text_key"], "left_semi").select("text")


def once(df: DataFrame) -> DataFrame:
    """One of the rows of each unit, which are all the same."""
    return df.dropDuplicates(["unit"])


def picked_again(texts: Texts, heads: DataFrame) -> tuple[DataFrame, Common]:
    """Heads with prefixes in the common order, which comes with them; heads given in the order of hashes."""
    common = commonness(heads.select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count("*").alias("times")))
    if len(common[0]):
        some = written(heads.mapInArrow(_with_common(common, True), HEAD).select("unit"), "some")
        counted = texts.read(some, "counted_docs").mapInArrow(_token_counts(common), "token long, times long")
        common = commonness(counted.groupBy("token").agg(F.sum("times").alias("times")))
        discard(some)
    if not len(common[0]):
        return heads, common
    changed = written(heads.mapInArrow(_with_common(common, True), HEAD).select("unit"), "changed")
    again = texts.read(changed, "changed_docs").mapInArrow(_heads(common), HEAD).join(few(changed), "unit", "left_semi")
    out = written(heads.mapInArrow(_with_common(common, False), HEAD).unionByName(once(again)), "heads")
    discard(heads, changed)
    return out, common


class Verifier:
    """Checks pairs of units: by their prefixes first, and what may link by whole sets."""

    def __init__(self, texts: Texts, heads: DataFrame, candidates: DataFrame):
        """candidates: (unit) of those that may be asked for."""
        self.texts = texts
        self.heads = written(heads.join(few(written(candidates, "candidates")), "unit", "left_semi"), "asked_heads")

    def _meet(self, table: DataFrame, pairs: DataFrame, *columns: str) -> DataFrame:
        """(a, b, columns of a, columns of b). While pairs are few, a table isn't shuffled for those that no pair asks for."""
        a, b = (table.select(F.col("unit").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in columns)) for c in "ab")
        firsts = written(pairs.select("a").distinct(), "firsts")
        joined = b.join(few(pairs), "b").join(a.join(few(firsts), "a", "left_semi"), "a")
        return joined.select("a", "b", *(f"{x}_a" for x in columns), *(f"{x}_b" for x in columns))

    def links(self, pairs: DataFrame) -> DataFrame:
        pairs = written(pairs, "pairs")
        may = written(self._meet(self.heads, pairs, "n", "prefix").mapInArrow(_bounded, "a long, b long"), "may")
        out = self._with_sets(may, _verify, "u long, v long", "links")
        discard(pairs, may)
        return out

    def differences(self, pairs: DataFrame, common: Common) -> DataFrame:
        """What sets b apart from its hub a, for each of the pairs."""
        pairs = written(pairs, "hub_pairs")
        out = self._with_sets(pairs, _differences(common), DIFFERENCE, "differences")
        discard(pairs)
        return out

    def _with_sets(self, pairs: DataFrame, task, schema: str, name: str) -> DataFrame:
        """What task makes of (a, b, packed_a, packed_b) of a written table of pairs."""
        asked = written(pairs.select(F.col("a").alias("unit")).unionByName(pairs.select(F.col("b").alias("unit"))).distinct(), "asked")
        sets = written(once(self.texts.read(asked, "asked_docs").mapInArrow(_packed_sets, "unit long, packed binary").join(few(asked), "unit", "left_semi")), "sets")
        out = written(self._meet(sets, pairs, "packed").mapInArrow(task, schema), name)
        discard(sets, asked)
        return out


def alike_in_size(a: Column, b: Column) -> Column:
    return F.least(a, b) * DEN >= F.greatest(a, b) * NUM


def first_shared(n_a: Column, at_a: Column, n_b: Column, at_b: Column) -> Column:
    """Whether sets that can link may have their first shared element at these places: enough must follow in both."""
    return F.least(n_a - at_a, n_b - at_b) * (NUM + DEN) >= (n_a + n_b) * NUM


def labelled(labels: DataFrame | None, df: DataFrame, unit: str, name: str) -> DataFrame:
    if labels is None:
        return df.withColumn(name, F.col(unit))
    mine = labels.select(F.col("node").alias(unit), F.col("root").alias(name))
    return df.join(mine, unit, "left").withColumn(name, F.coalesce(name, unit))


def ngram_join(docs: DataFrame, *, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, component, text_key), a row for each row of docs.

    Words of the whole text, A-Z lower-cased, give the set of distinct 5-word shingles; with fewer words the whole
    sequence is the one shingle; null texts and texts without words have none and are linked with nothing. Documents
    link from a Jaccard similarity of 0.8. component_id is the smallest doc_id that links reach, component a number
    that differs between components even where ids repeat (null without shingles), text_key the text's xxhash64. A null id joins components but is
    never their smallest id unless they have no other. Repeated rows and equal texts are one unit; an empty table gives
    no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("text_key", F.xxhash64("text"))
    profiles = written(docs.select("doc_id", "text", "text_key").mapInArrow(_profiles, PROFILE), "profiles")
    rows = written(profiles.drop("prefix"), "rows")
    texts = Texts(docs, rows)
    heads = written(once(profiles.where("n > 0").select("unit", "n", "prefix")), "heads")
    discard(profiles)
    heads, common = picked_again(texts, heads)
    keyed = written(heads.select("unit", "n", F.xxhash64("n", "prefix").alias("prefix_key")), "keyed")
    groups = keyed.groupBy("prefix_key").agg(F.min("unit").alias("gid"), F.count("*").alias("members"))
    units = written(keyed.join(groups, "prefix_key"), "units")
    others = written(units.where("unit <> gid").select("unit"), "others")
    tokens = heads.join(few(others), "unit", "left_anti").select("unit", "n", F.posexplode("prefix").alias("place", "token"))
    listed = tokens.groupBy("token").agg(F.count("*").alias("entries")).where("entries > 1")
    inside = units.where("members > 1").select(F.col("prefix_key").alias("token"), "unit", "n", F.lit(-1).alias("place"), F.col("members").alias("entries"))
    every = tokens.join(listed, "token").select("token", "unit", "n", "place", "entries")
    lists = one_of_each(written(every.unionByName(inside), "all_lists"))
    release(spark)
    if lists.isEmpty():
        return finished(rows, units, texts.of, None)
    asked = lists.select(F.col("unit").alias("gid")).distinct()
    verifier = Verifier(texts, heads, units.join(asked, "gid", "left_semi").select("unit"))
    discard(heads)
    labels = None
    for r in range(rounds):
        mine = labelled(labels, lists, "unit", "label").withColumn("kind", F.col("place") < 0)
        # a list's hub comes by an aggregate and a join, so a list of very many members is combined early and may be split
        hubs = mine.groupBy("token", "kind").agg(F.max(F.struct(*hub_order(r), "unit", "n", "place", "label")).alias("hub"))
        pairs = mine.join(hubs, ["token", "kind"]).where(
            (F.col("hub.label") != F.col("label"))
            & alike_in_size(F.col("n"), F.col("hub.n"))
            & (F.col("kind") | first_shared(F.col("n"), F.col("place"), F.col("hub.n"), F.col("hub.place")))
        )
        links = verifier.links(pairs.select(F.col("hub.unit").alias("a"), F.col("unit").alias("b")).distinct())
        labels = joined(labels, links)
        release(spark)
    short, hub_pairs = remaining(lists, units, labels)
    differences = verifier.differences(hub_pairs, common)
    labels = joined(labels, differences.where("near").select(F.col("hub").alias("u"), F.col("unit").alias("v")))
    pairs = short.unionByName(apart_from_hubs(differences, labels)).distinct()
    labels = joined(labels, verifier.links(pairs))
    return finished(rows, units, texts.of, labels)


def one_of_each(lists: DataFrame) -> DataFrame:
    """Lists without those that have the same entries as another: one shingle of a shared passage stands for the rest.

    Adds how central a unit is: the entries of all its lists, beside its size. A copy with few changes of its own is in
    most lists of its family.
    """
    entries = F.col("place") >= 0
    same = lists.groupBy("token", entries.alias("kind")).agg(
        F.count("*").alias("k"), F.bit_xor(F.xxhash64("unit")).alias("x"), F.sum(F.pmod(F.xxhash64("unit", F.lit(1)), F.lit(2**31))).alias("y")
    )
    chosen = same.groupBy("kind", "k", "x", "y").agg(F.min("token").alias("token")).select("token", "kind")
    central = lists.groupBy("unit").agg((F.sum("entries") / F.first("n")).alias("central"))
    chosen = lists.withColumn("kind", entries).join(chosen, ["token", "kind"], "left_semi").drop("kind", "entries")
    return written(chosen.join(central, "unit"), "lists")


def hub_order(r: int) -> list[Column]:
    """The greatest is a list's hub: the most central member at first, then any by chance."""
    return [*([F.col("central")] if r == 0 else []), F.xxhash64("unit", F.lit(r)).alias("h")]


def remaining(lists: DataFrame, units: DataFrame, labels: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Of lists and groups with several components: pairs (a, b) of units of short ones, pairs (hub, unit) of long ones."""
    in_groups = labelled(labels, units.where("members > 1").select("gid", "unit", "members"), "unit", "label")
    spread = in_groups.groupBy("gid").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.first("members").alias("members"))
    mine = labelled(labels, lists, "unit", "label")
    tokens = mine.where("place >= 0").join(spread.withColumnRenamed("gid", "unit"), "unit", "left")
    tokens = tokens.withColumn("low", F.coalesce("low", "label")).withColumn("high", F.coalesce("high", "label"))
    # lists inside one component have no pair left
    open_lists = tokens.groupBy("token").agg(
        F.min("low").alias("l"),
        F.max("high").alias("h"),
        F.sum(F.coalesce("members", F.lit(1))).alias("listed"),
        F.max(F.struct(*hub_order(0), "unit")).alias("hub"),
    )
    open_lists = open_lists.where("l <> h").select("token", "listed", F.col("hub.unit").alias("hub"))
    tokens = written(tokens.join(open_lists, "token"), "open_lists")
    x, y = tokens.where(F.col("listed") <= SHORT).alias("x"), tokens.where(F.col("listed") <= SHORT).alias("y")
    apart = ~((F.col("x.low") == F.col("x.high")) & (F.col("y.low") == F.col("y.high")) & (F.col("x.low") == F.col("y.low")))
    pairs = x.join(
        y,
        (F.col("x.token") == F.col("y.token"))
        & (F.col("x.unit") < F.col("y.unit"))
        & apart
        & alike_in_size(F.col("x.n"), F.col("y.n"))
        & first_shared(F.col("x.n"), F.col("x.place"), F.col("y.n"), F.col("y.place")),
    ).select(F.col("x.unit").alias("p"), F.col("y.unit").alias("q"))
    pairs = pairs.distinct()
    whole = labelled(labels, units.select("gid", "unit"), "unit", "label")
    p = whole.select(F.col("gid").alias("p"), F.col("unit").alias("a"), F.col("label").alias("label_a"))
    q = whole.select(F.col("gid").alias("q"), F.col("unit").alias("b"), F.col("label").alias("label_b"))
    across = pairs.join(p, "p").join(q, "q").where("label_a <> label_b").select("a", "b")
    small = in_groups.where(F.col("members") <= SHORT)
    u, v = small.alias("u"), small.alias("v")
    within = u.join(v, (F.col("u.gid") == F.col("v.gid")) & (F.col("u.unit") < F.col("v.unit")) & (F.col("u.label") != F.col("v.label")))
    short = across.unionByName(within.select(F.col("u.unit").alias("a"), F.col("v.unit").alias("b")))
    large = spread.where((F.col("members") > SHORT) & (F.col("low") != F.col("high"))).select(F.col("gid").alias("hub"), "gid")
    long = tokens.where(F.col("listed") > SHORT).select("hub", F.col("unit").alias("gid")).unionByName(large).distinct()
    hub_pairs = long.join(units.select("gid", "unit"), "gid").where("unit <> hub").select(F.col("hub").alias("a"), F.col("unit").alias("b"))
    return short, hub_pairs


def apart_from_hubs(differences: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs (a, b) of units in different components whose differences from one hub can share enough.

    The short prefix of the smaller difference meets the long one of the larger.
    """
    mine = labelled(labels, differences, "unit", "label")
    mixed = mine.groupBy("hub").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l <> h").select("hub")
    entries = mine.join(mixed, "hub", "left_semi").select("hub", "unit", "n", "size", "near", "short", "label", F.posexplode("prefix").alias("place", "token"))
    entries = written(entries, "difference_lists")
    x, y = entries.where("place < short").alias("x"), entries.alias("y")
    apart = F.least(F.col("x.size") - F.col("x.place"), F.col("y.size") - F.col("y.place"))
    shared = (F.col("x.size") + F.col("y.size")) * (DEN + NUM) - (F.col("x.n") + F.col("y.n")) * (DEN - NUM)
    pairs = x.join(
        y,
        (F.col("x.hub") == F.col("y.hub"))
        & (F.col("x.token") == F.col("y.token"))
        & (F.struct("x.size", "x.unit") < F.struct("y.size", "y.unit"))
        & (F.col("x.label") != F.col("y.label"))
        & ~(F.col("x.near") & F.col("y.near"))
        & alike_in_size(F.col("x.n"), F.col("y.n"))
        & (apart * (2 * (DEN + NUM)) >= shared),
    )
    return pairs.select(F.col("x.unit").alias("a"), F.col("y.unit").alias("b"))


def joined(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels (node, root) after further links between nodes."""
    edges = links.select("u", "v")
    if labels is not None:
        edges = edges.unionByName(labels.select(F.col("node").alias("u"), F.col("root").alias("v")))
    return written(components(edges), "labels")


def finished(rows: DataFrame, units: DataFrame, of: DataFrame, labels: DataFrame | None) -> DataFrame:
    mine = labelled(labels, units.select("unit"), "unit", "component").join(of, "unit")
    least = mine.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    mine = mine.select("unit", "component").join(least, "component")
    return rows.join(mine, "unit", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        "component",
        "text_key",
    )


def keep_one_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one document of each component, the one of the smallest id; documents without words all stay.

    An id and a text name a document: rows that repeat both are one, and rows of one id, or of none, with other texts go
    or stay by their own components. Among documents of the smallest id, or all without ids, the least hash of the text
    stays. While the documents that go are few, they are broadcast and texts stay where they are.
    """
    found = written(ngram_join(docs, id_col=id_col, text_col=text_col, **options), "joined")
    linked = found.where("n_shingles > 0")
    first = linked.where("doc_id <=> component_id").select("component", "doc_id", "text_key")
    several = first.groupBy("component").agg(F.min("text_key").alias("l"), F.max("text_key").alias("h")).where("l <> h")
    later = linked.where("not (doc_id <=> component_id)").select("doc_id", "text_key")
    gone = later.unionByName(first.join(several, "component").where("text_key <> l").select("doc_id", "text_key"))
    gone = written(gone.select(F.col("doc_id").alias("_gone"), F.col("text_key").alias("_gone_key")).distinct(), "gone")
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    same = F.col(id_col).cast("long").eqNullSafe(F.col("_gone")) & (F.xxhash64(F.col(text_col)) == F.col("_gone_key"))
    out = docs.join(gone, same, "left_anti")
    n = found.agg(F.count("*").alias("rows"), F.count_distinct(F.coalesce("doc_id", F.lit(LOWEST))).alias("ids")).first()
    if n.rows > n.ids:
        row = F.struct(*(column(c) for c in docs.columns))
        one = W.partitionBy(F.col(id_col), F.xxhash64(text_col)).orderBy(F.xxhash64(F.to_json(row)))
        out = out.select(row.alias("row"), F.row_number().over(one).alias("k")).where("k = 1").select("row.*")
    return out


def op1_ngram_join(spark, sf_dir):
    return ngram_join(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")
