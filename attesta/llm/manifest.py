"""Merkle manifest of a table: a tree of hashes for each language, and one over their roots.

Leaves are numbered in sorted ranges. The node store is Parquet with a folder for each level; a pass reads the level
below in blocks of 8 ** DEPTH consecutive nodes and writes the next DEPTH levels of each block, so a pass shrinks the data
by that factor and no task holds more than one block. Proofs come from the store the other way: from the top down, each
pass merges the nodes of a block, by their coordinates, with the path of the block to the root, which gives the paths of
the blocks below and in the end the proofs of the leaves.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, documents, numbered, pieces_for, shared_folder, ship, small, written
from .importance import CRC_TABLE, crc_sql

FANOUT_BITS = 3
FANOUT = 1 << FANOUT_BITS
#: Levels that a pass adds: blocks of 4096 nodes.
DEPTH = 4
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
ROWS_PER_TASK = 50_000
NODE = "tree string, size long, pos long, digest string, level int"


def digest_of(*texts: str) -> str:
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def encoded(value: Column) -> Column:
    """A value as one input of a hash: `-` if null, else its UTF-8 byte count, a colon and itself; integers are decimal."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(values: list[Column]) -> Column:
    return F.sha2(F.concat(*map(encoded, values)), 256)


def width(size: int, level: int) -> int:
    """Nodes of a level in a tree of `size` leaves; the tree ends at the first level with one."""
    return -(-size // FANOUT**level)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of each (tree, block), from batches that are sorted by them."""
    held, at = [], None
    for batch in batches:
        for row in batch.to_pylist():
            key = row["tree"], row["block"]
            if key != at and held:
                yield held
                held = []
            at = key
            held.append(row)
    if held:
        yield held


def _sent(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


_NODE_ARROW = pa.schema([("tree", pa.string()), ("size", pa.int64()), ("pos", pa.int64()), ("digest", pa.string()), ("level", pa.int32())])


def _levels_above(base: int, depth: int):
    """Builds the levels base + 1 to base + depth of each block of nodes of level base."""

    def build(batches):
        for rows in _blocks(batches):
            tree, size, first = rows[0]["tree"], rows[0]["size"], rows[0]["pos"]
            nodes, out = [r["digest"] for r in rows], []
            for level in range(base + 1, base + depth + 1):
                if width(size, level - 1) == 1:
                    break
                nodes, first = [digest_of(*nodes[i : i + FANOUT]) for i in range(0, len(nodes), FANOUT)], first // FANOUT
                out += [{"tree": tree, "size": size, "pos": first + i, "digest": d, "level": level} for i, d in enumerate(nodes)]
            yield _sent(out, _NODE_ARROW)

    return build


@dataclass
class Forest:
    """Stored trees: the folder of levels, the leaves of the largest tree, all leaves, and how many levels a pass adds."""

    spark: SparkSession
    folder: str
    largest: int
    leaves: int
    depth: int

    @property
    def passes(self) -> int:
        n = 0
        while width(self.largest, n * self.depth) > 1:
            n += 1
        return n

    def level(self, k: int) -> DataFrame:
        """(tree, size, pos, digest) of level k, 0 being the leaves."""
        return self.spark.read.schema(T._parse_datatype_string(NODE.rpartition(",")[0])).parquet(f"{self.folder}/level={k}")

    @property
    def levels(self) -> int:
        n = 0
        while width(self.largest, n) > 1:
            n += 1
        return n + 1

    def tops(self) -> DataFrame:
        """(tree, size, digest): the root of each tree, the node of its first level that has only one."""
        out = None
        for k in range(self.levels):
            own = self.level(k).where(F.col("size") <= FANOUT**k).select("tree", "size", "digest")
            out = own if out is None else out.unionByName(own)
        return out


def _tasks(rows: int) -> int:
    return pieces_for(rows, ROWS_PER_TASK)


def grow(nodes: DataFrame, leaves: int, largest: int, depth: int = DEPTH) -> Forest:
    """The store of the trees whose leaves are nodes (tree, size, pos, digest)."""
    spark = nodes.sparkSession
    ship(spark)
    forest = Forest(spark, f"{shared_folder(spark)}/attesta/{uuid.uuid4().hex}/merkle_nodes", largest, leaves, depth)
    nodes.select("tree", "size", "pos", "digest").write.parquet(f"{forest.folder}/level=0")
    for k in range(forest.passes):
        base = k * depth
        below = forest.level(base).where(F.col("size") > FANOUT**base).withColumn("block", F.shiftright("pos", FANOUT_BITS * depth))
        below = below.repartition(_tasks(leaves // FANOUT**base), "tree", "block").sortWithinPartitions("tree", "block", "pos")
        below.mapInArrow(_levels_above(base, depth), NODE).write.mode("append").partitionBy("level").parquet(forest.folder)
    return forest


def _path_of(at: int, size: int, base: int, depth: int, nodes: dict[int, dict[int, str]], above: str, known: dict) -> str:
    """The path of node `at` of level base: `left|right` siblings for each level up to the root, comma-joined."""
    parts, level = [], base
    while level < base + depth and width(size, level) > 1:
        held = (level, at)
        if held in known:
            parts.append(known[held])
            return ",".join(parts)
        own, first = nodes[level], at - at % FANOUT
        left = "".join(own[p] for p in range(first, at))
        right = "".join(own[p] for p in range(at + 1, first + FANOUT) if p in own)
        parts.append(f"{left}|{right}")
        at, level = at // FANOUT, level + 1
    return ",".join([*parts, above]) if above else ",".join(parts)


def _block_paths(rows: list[dict], base: int, depth: int) -> Iterator[tuple[dict, str, str]]:
    """(row, its path, the root that the block was given) of each node of level base in a block."""
    nodes: dict[int, dict[int, str]] = {}
    above, root = "", None
    for r in rows:
        if r["kind"] < 0:
            above, root = r["path"], r["root"]
        else:
            nodes.setdefault(r["kind"], {})[r["pos"]] = r["digest"]
    known: dict = {}
    for r in rows:
        if r["kind"] == base:
            up = base + 1, r["pos"] // FANOUT
            if depth > 1 and up not in known and width(r["size"], base) > 1 and width(r["size"], base + 1) > 1:
                known[up] = _path_of(up[1], r["size"], up[0], depth - 1, nodes, above, {})
            yield r, _path_of(r["pos"], r["size"], base, depth, nodes, above, known), root


def _merged(forest: Forest, k: int, bottom: DataFrame, paths: DataFrame) -> DataFrame:
    """Rows of pass k, by block and sorted: its path, its inner nodes, and bottom, the nodes of its lowest level."""
    base, depth = k * forest.depth, forest.depth
    empty = {c: F.lit(None).cast(t) for c, t in (("path", "string"), ("root", "string"))}
    parts = [
        bottom.withColumns({"block": F.shiftright("pos", FANOUT_BITS * depth), "kind": F.lit(base)} | empty),
        paths.select("tree", "block", F.lit(-1).alias("kind"), "path", "root"),
    ]
    for level in range(base + 1, base + depth):
        if level < forest.levels:
            inner = forest.level(level).where(F.col("size") > FANOUT**level)
            parts.append(inner.withColumns({"block": F.shiftright("pos", FANOUT_BITS * (base + depth - level)), "kind": F.lit(level)}))
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p, allowMissingColumns=True)
    return both.repartition(_tasks(forest.leaves // FANOUT**base), "tree", "block").sortWithinPartitions("tree", "block", "kind", "pos")


def paths_of(forest: Forest, bottom: DataFrame, starts: DataFrame, make, schema) -> DataFrame:
    """What make(row, path, root) gives of each row of bottom, the forest's leaves with columns of their own.

    starts: (tree, size, path, root), the path from each tree's top on, and what it leads to.
    """
    depth, last = forest.depth, max(1, forest.passes) - 1
    arrow = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("path", pa.string()), ("root", pa.string())])
    paths = None
    for k in range(last, -1, -1):
        base = k * depth
        # trees whose top lies in this pass begin here
        begin = (F.col("size") <= FANOUT ** (base + depth)) & ((F.col("size") > FANOUT**base) if k else F.lit(True))
        own = starts.where(begin).select("tree", F.lit(0).cast("long").alias("block"), "path", "root")
        paths = own if paths is None else paths.unionByName(own)
        if k:
            def lower(batches, base=base):
                for rows in _blocks(batches):
                    yield _sent([{"tree": r["tree"], "block": r["pos"], "path": p, "root": root} for r, p, root in _block_paths(rows, base, depth)], arrow)

            nodes = forest.level(base).where(F.col("size") > FANOUT**base)
            paths = written(_merged(forest, k, nodes, paths).mapInArrow(lower, "tree string, block long, path string, root string"), "merkle_paths")

    def finish(batches):
        for rows in _blocks(batches):
            yield from make(_block_paths(rows, 0, depth))

    return _merged(forest, 0, bottom, paths).mapInArrow(finish, schema)


@dataclass
class Manifest:
    """The trees of a table, the tree over their roots, the leaves with their places, and the root of all (None: no rows)."""

    forest: Forest
    top: Forest
    leaves: DataFrame
    trees: DataFrame
    root: str | None


def build_manifest(
    docs: DataFrame, *, columns: tuple[str, ...] = COLUMNS, id_col: str = "doc_id", tree_col: str = "lang", depth: int = DEPTH, claimed: Column | None = None, rows_per_range: int = 50_000
) -> Manifest:
    """Hashes of every row of docs, up to one root.

    A leaf is the hash of a row's columns; a tree holds the rows of one value of tree_col, ordered by id (null first), then
    leaf; trees are ordered by their value's bytes, null first. Repeated rows have equal leaves, side by side. claimed is a
    digest to fold instead of the leaf when proofs are checked; null where there is none. Columns of docs that are not
    hashed play no role. An empty table has no root.
    """
    spark = docs.sparkSession
    tree = F.coalesce(F.concat(F.lit("v"), column(tree_col).cast("string")), F.lit(""))
    rows = docs.select(tree.alias("tree"), column(id_col).alias("id"), leaf_of([column(c) for c in columns]).alias("digest"), (F.lit(None).cast("string") if claimed is None else claimed).alias("claimed"))
    rows = written(rows, "merkle_leaves")
    order = [F.col("tree").asc(), F.col("id").asc_nulls_first(), F.col("digest").asc()]
    placed = numbered(rows, order, "merkle_order", group=("tree",), rows_per_range=rows_per_range).withColumnRenamed("nth", "pos")
    sizes = written(rows.groupBy("tree").agg(F.count("*").alias("size")), "merkle_sizes")
    seen = sizes.agg(F.sum("size").alias("n"), F.max("size").alias("most"), F.count("*").alias("trees")).first()
    leaves = written(placed.join(small(sizes), "tree"), "merkle_placed")
    forest = grow(leaves, seen.n or 0, seen.most or 0, depth)
    trees = written(forest.tops(), "merkle_tops")
    ordered = numbered(trees, [F.col("tree").asc()], "merkle_trees", rows_per_range=rows_per_range)
    over = ordered.select(F.lit("").alias("tree"), F.lit(seen.trees).cast("long").alias("size"), F.col("nth").alias("pos"), "digest", F.col("tree").alias("of"), F.col("size").alias("own_size"))
    top = grow(over, seen.trees, seen.trees, depth)
    root = top.tops().first()
    return Manifest(forest, top, leaves, over, root and root.digest)


def proofs(manifest: Manifest) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), a row for each leaf of the manifest.

    The proof of a leaf is its siblings on each level, from left to right, up to the root; with no sibling at all it is
    the hash of nothing. folded_root hashes the claimed digest, or else the leaf, up through them.
    """
    spark = manifest.leaves.sparkSession
    kind = manifest.leaves.schema["id"].dataType
    out = T.StructType([T.StructField("doc_id", kind), *(T.StructField(c, T.StringType()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")), T.StructField("verified", T.BooleanType())])
    if manifest.root is None:
        return spark.createDataFrame([], out)
    root = manifest.root
    start = spark.range(1).select(F.lit("").alias("tree"), F.lit(manifest.top.leaves).cast("long").alias("size"), F.lit("").alias("path"), F.lit(root).alias("root"))
    first = pa.schema([("tree", pa.string()), ("size", pa.int64()), ("path", pa.string()), ("root", pa.string())])

    def subroots(found):
        yield _sent([{"tree": r["of"], "size": r["own_size"], "path": p, "root": r["digest"]} for r, p, _ in found], first)

    starts = written(paths_of(manifest.top, manifest.trees, start, subroots, "tree string, size long, path string, root string"), "merkle_starts")

    def proven(found):
        cols: list[list] = [[] for _ in range(7)]
        for r, path, subroot in found:
            siblings = [s.split("|") for s in path.split(",")] if path else []
            node = r["claimed"] or r["digest"]
            for left, right in siblings:
                node = digest_of(left, node, right)
            for c, x in zip(cols, (r["id"], r["digest"], subroot, root, digest_of(*(x for s in siblings for x in s)), node, node == root), strict=True):
                c.append(x)
        if cols[0]:
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], _arrow(kind)), *(pa.array(c) for c in cols[1:])], names=out.names)

    return paths_of(manifest.forest, manifest.leaves, starts, proven, out)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def lower_case(text: Column) -> Column:
    """A-Z as a-z, and nothing else changed."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def audit(docs: DataFrame, **options) -> DataFrame:
    """Proofs of docs against a copy whose texts are lower-cased where 3 divides the checksum of the decimal id.

    A null id has no checksum and is not tampered with; a null text stays. Repeated, tied and long rows count like others.
    """
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    claimed = F.when(hit, leaf_of([lower_case(F.col(c)) if c == "text" else F.col(c) for c in COLUMNS]))
    return proofs(build_manifest(docs, claimed=claimed, **options))


def op13_manifest(spark, sf_dir):
    return audit(documents(spark, sf_dir))


#: Levels that the SQL goes through: trees of up to 8 ** SQL_LEVELS leaves.
SQL_LEVELS = 9


def _enc_sql(value: str) -> str:
    return f"coalesce(octet_length(encode(CAST({value} AS VARCHAR))) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(_enc_sql(text if c == "text" else c) for c in COLUMNS) + ")"


def _tree_sql(name: str, source: str) -> str:
    """Tables {name}0 to {name}N of (tree, pos, digest) and, from them, {name}p: siblings on the left and right by level."""
    out = [f"{name}0 AS MATERIALIZED (SELECT tree, pos, digest, count(*) OVER (PARTITION BY tree) AS w FROM {source})"]
    for k in range(SQL_LEVELS):
        side = "coalesce(string_agg(digest, '') OVER (PARTITION BY tree, pos // 8 ORDER BY pos ROWS BETWEEN {}), '')"
        out.append(
            f"{name}s{k} AS MATERIALIZED (SELECT tree, pos, w, {side.format('UNBOUNDED PRECEDING AND 1 PRECEDING')} AS l, "
            f"{side.format('1 FOLLOWING AND UNBOUNDED FOLLOWING')} AS r FROM {name}{k} WHERE w > 1)"
        )
        out.append(
            f"{name}{k + 1} AS MATERIALIZED (SELECT tree, pos // 8 AS pos, CASE WHEN max(w) > 1 THEN sha256(string_agg(digest, '' ORDER BY pos)) ELSE max(digest) END AS digest, (max(w) + 7) // 8 AS w FROM {name}{k} GROUP BY tree, pos // 8)"
        )
    return ",\n".join(out)


def _fold_sql(name: str, inner: str) -> str:
    """inner (with columns tree, pos, proof, node) after the levels of a tree."""
    for k in range(SQL_LEVELS):
        inner = f"(SELECT x.* REPLACE (x.proof || coalesce(s.l || s.r, '') AS proof, CASE WHEN s.w IS NULL THEN x.node ELSE sha256(s.l || x.node || s.r) END AS node) FROM {inner} x LEFT JOIN {name}s{k} s ON s.tree = x.tree AND s.pos = x.pos // {FANOUT**k})"
    return inner


_LOWER_SQL = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = f"""
WITH crc AS MATERIALIZED ({CRC_TABLE}),
d AS MATERIALIZED (SELECT doc_id, coalesce('v' || lang, '') AS tree, {_leaf_sql("text")} AS leaf, CASE WHEN {crc_sql("CAST(doc_id AS VARCHAR)")} % 3 = 0 THEN {_leaf_sql(_LOWER_SQL)} END AS claimed FROM documents, crc),
p AS MATERIALIZED (SELECT *, leaf AS digest, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
{_tree_sql("a", "p")},
u AS MATERIALIZED (SELECT tree AS own, '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS pos, digest FROM a{SQL_LEVELS}),
{_tree_sql("b", "u")},
f AS (SELECT x.doc_id, x.leaf, u.digest AS subroot, x.proof, x.node, u.tree, u.pos FROM {_fold_sql("a", "(SELECT doc_id, tree, pos, leaf, '' AS proof, coalesce(claimed, leaf) AS node FROM p)")} x JOIN u ON u.own = x.tree)
SELECT doc_id, leaf, subroot, t.digest AS root, sha256(proof) AS proof_sha256, node AS folded_root, node = t.digest AS verified
FROM {_fold_sql("b", "f")} g, b{SQL_LEVELS} t
"""
