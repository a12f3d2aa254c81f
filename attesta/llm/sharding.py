"""Vector bin packing of documents into shards of near-equal bytes, with tokens and rows balanced beside them.

Equal texts form a group. Groups are hashed to a fixed number of buckets, so what is packed on the driver has a proven
size: bytes, tokens and rows of each bucket. A group that is too large for that (at most a few hundred can be) becomes
buckets of its own, cut by the place of a row in the group. Buckets go, largest first, where the dot product of their
vector with the shard's residual capacity is highest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, column, documents, numbered, written

SHARDS = 16
BUCKETS = 8192
#: A group above total / (shards * this) in any dimension is split in parts of about that.
FINE = 64
#: Room over the mean that the bytes of a shard may take before it is closed to further buckets.
SLACK = 0.001


def pack_vectors(items: list[tuple[int, float, float, float]], shards: int, slack: float = SLACK) -> dict[int, int]:
    """Shard of each item (id, bytes, tokens, rows)."""
    totals = [max(1.0, float(sum(x[k] for x in items))) for k in (1, 2, 3)]
    room = [[1.0, 1.0, 1.0] for _ in range(shards)]
    where: dict[int, int] = {}
    scaled = [(x[0], [shards * x[k + 1] / totals[k] for k in range(3)]) for x in items]
    for key, v in sorted(scaled, key=lambda x: (-max(x[1]), x[0])):
        fits = [s for s in range(shards) if room[s][0] + slack >= v[0]]
        if fits:
            best = max(fits, key=lambda s: (v[0] * room[s][0] + v[1] * room[s][1] + v[2] * room[s][2], -s))
        else:
            best = max(range(shards), key=lambda s: (room[s][0], -s))
        where[key] = best
        for k in range(3):
            room[best][k] -= v[k]
    return where


def shard_documents(
    docs: DataFrame,
    *,
    shards: int = SHARDS,
    buckets: int = BUCKETS,
    fine: int = FINE,
    rows_per_range: int = 50_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, size, text_crc32, tokens, shard, slot), a row for each row of docs.

    Size: UTF-8 bytes of the whole text (null: none) plus 1. Equal texts share a shard unless their group alone is more
    than 1/fine of a shard; its rows are then numbered and cut into parts of equal counts, also where they repeat one id or
    have none. Slots are gapless from 0 in each shard, by id (null first), then checksum and size; rows alike in these are
    interchangeable. What is packed are buckets of groups, not single groups. Empty tables give no rows; other columns of
    docs play no role.
    """
    spark = docs.sparkSession
    text = F.coalesce(column(text_col), F.lit(""))
    rows = written(
        docs.select(
            column(id_col).alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
            F.regexp_count(text, F.lit(WORD)).cast("long").alias("tokens"),
            F.xxhash64(text).alias("group_key"),
        ),
        "shard_rows",
    )
    measures = [F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count("*").alias("r")]
    total = rows.agg(*measures).first()
    if not total.r:
        return rows.select("doc_id", "size", "text_crc32", "tokens", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    limits = {k: max(1.0, (total[k] or 0) / (shards * fine)) for k in ("b", "t", "r")}
    # each large group holds over 1 / (shards * fine) of one dimension: at most 3 * shards * fine rows
    large = (
        rows.groupBy("group_key")
        .agg(*measures)
        .where(" or ".join(f"({k} > {v!r} and r > 1)" for k, v in limits.items()))
        .orderBy("group_key")
        .collect()
    )
    first, listed = buckets, []
    for g in large:
        parts = min(g.r, int(max(g[k] / limits[k] for k in limits)) + 1)
        listed.append((g.group_key, first, parts, g.r))
        first += parts
    plain = F.pmod("group_key", F.lit(buckets)).cast("int")
    if listed:
        split = F.broadcast(spark.createDataFrame(listed, "group_key long, first_part int, parts int, group_rows long"))
        order = [F.col("group_key").asc(), F.col("doc_id").asc_nulls_first()]
        inside = numbered(rows.join(split, "group_key"), order, "shard_groups", group=("group_key",), rows_per_range=rows_per_range)
        part = F.col("first_part") + F.floor(F.col("nth") * F.col("parts") / F.col("group_rows")).cast("int")
        columns = ["doc_id", "size", "text_crc32", "tokens"]
        rows = inside.select(*columns, part.alias("bucket")).unionByName(rows.join(split, "group_key", "left_anti").select(*columns, plain.alias("bucket")))
    else:
        rows = rows.withColumn("bucket", plain)
    # at most `first` rows: the fixed buckets and the parts of large groups
    items = [tuple(x) for x in rows.groupBy("bucket").agg(*measures).collect()]
    where = F.broadcast(spark.createDataFrame(sorted(pack_vectors(items, shards).items()), "bucket int, shard int"))
    order = [F.col("shard").asc(), F.col("doc_id").asc_nulls_first(), F.col("text_crc32").asc(), F.col("size").asc()]
    placed = written(rows.join(where, "bucket").select("doc_id", "size", "text_crc32", "tokens", "shard"), "sharded_rows")
    return numbered(placed, order, "shard_slots", group=("shard",), rows_per_range=rows_per_range).withColumnRenamed("nth", "slot")


def op5_sharding(spark, sf_dir):
    return shard_documents(documents(spark, sf_dir)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens"
    )
