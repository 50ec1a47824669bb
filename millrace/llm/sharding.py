"""Sharding over fixed virtual slots.

Records are hashed into a fixed number of slots. Bytes and rows are aggregated
per slot, and a slot-to-shard map, kept as a versioned table, says which shard
owns which slot. Only the map is edited when shards grow or drift apart: a
record's slot never changes.

The map follows the law ``bytes``: shards get nearly equal bytes. It has a row
per slot, so what the driver holds is bounded by the number of slots.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.scratch import Scratch

MAP_SCHEMA = "version long, vslot int, shard int, bytes long, rows long"


def balanced(load: dict[int, int], shards: int) -> dict[int, int]:
    """Slots by falling load, each to the lightest shard (ties: lowest shard);
    slots of equal load go by number."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for slot in sorted(load, key=lambda k: (-load[k], k)):
        have, s = heapq.heappop(heap)
        out[slot] = s
        heapq.heappush(heap, (have + load[slot], s))
    return out


def rebalanced(owner: dict[int, int], load: dict[int, int], shards: int, tolerance: float = 0.01) -> dict[int, int]:
    """An edited map for ``shards`` shards: slots of removed shards, and then as
    few others as bring every shard within ``tolerance`` of the mean, move to
    the lightest shard."""
    have = dict.fromkeys(range(shards), 0)
    for slot, s in owner.items():
        if s in have:
            have[s] += load.get(slot, 0)
    out = dict(owner)
    mean = sum(load.values()) / shards
    move = [k for k, s in owner.items() if s not in have]
    for s in range(shards):
        own = sorted((k for k, o in owner.items() if o == s), key=lambda k: (load.get(k, 0), k))
        while own and have[s] - load.get(own[-1], 0) / 2 > mean * (1 + tolerance):
            k = own.pop()
            have[s] -= load.get(k, 0)
            move.append(k)
    heap = [(v, s) for s, v in have.items()]
    heapq.heapify(heap)
    for k in sorted(move, key=lambda k: (-load.get(k, 0), k)):
        v, s = heapq.heappop(heap)
        out[k] = s
        heapq.heappush(heap, (v + load.get(k, 0), s))
    return out


def write_map(spark: SparkSession, path: str, owner: dict[int, int], stats: dict[int, tuple[int, int]]) -> int:
    """Append the map as the next version of the table at ``path``."""
    version = 1 + (latest_version(spark, path) or 0)
    rows = [(version, k, s, *stats.get(k, (0, 0))) for k, s in sorted(owner.items())]
    spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.mode("append").partitionBy("version").parquet(path)
    return version


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def latest_version(spark: SparkSession, path: str) -> int | None:
    if not _exists(spark, path):
        return None
    return spark.read.schema(MAP_SCHEMA).parquet(path).agg(F.max("version")).first()[0]


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    version = version or latest_version(spark, path)
    return spark.read.schema(MAP_SCHEMA).parquet(path).where(F.col("version") == version)


def shard(docs: DataFrame, scratch: Scratch, shards: int = 40, slots: int = 8192, overhead: int = 16, map_path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, size (UTF-8 bytes of the text plus
    ``overhead``), text_crc32, law (``bytes``), shard, slot (place in the
    shard, gapless from 0), grown_shard (null under this law) and vslot.

    A null text has no bytes and the checksum of an empty one. A row's virtual
    slot is a hash of id and text, so a repeated id spreads. Rows repeated in
    both share a slot; once that holds more than a quarter of a shard's share,
    its rows are dealt over ``slots // 8`` spare slots by their place in the
    written table. A text of any length is one row. Other columns are not looked
    at. An empty table gives no rows.
    """
    spark = docs.sparkSession
    own = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
        (F.octet_length(own) + overhead).cast("long").alias("size"),
        F.crc32(own.cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64(F.lit("slot"), F.col(f"`{doc_id}`").cast("long"), own), F.lit(slots)).cast("int").alias("vslot"),
        F.monotonically_increasing_id().alias("place"),
    )
    rows = scratch.keep(rows, "records")
    spare = slots // 8

    def loads(rows: DataFrame) -> dict[int, tuple[int, int]]:
        """Bytes and rows by slot; at most one row per slot."""
        return {r["vslot"]: (r["b"], r["n"]) for r in rows.groupBy("vslot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()}

    stats = loads(rows)
    share = sum(b for b, _ in stats.values()) / shards
    heavy = [k for k, (b, n) in stats.items() if n > 1 and b > share / 4]
    if heavy:
        spread = F.lit(slots) + F.pmod(F.xxhash64(F.lit("spare"), "place"), F.lit(spare))
        rows = rows.withColumn("vslot", F.when(F.col("vslot").isin(heavy), spread).otherwise(F.col("vslot")).cast("int"))
        stats = loads(rows)
    load = {k: stats.get(k, (0, 0))[0] for k in range(slots + spare)}
    path = map_path or f"{scratch.base}/slot-map"
    if latest_version(spark, path) is None:
        owner = balanced(load, shards)
        write_map(spark, path, owner, stats)
    else:
        before = {r["vslot"]: r["shard"] for r in read_map(spark, path).collect()}
        owner = rebalanced(before, load, shards)
        if owner != before:
            write_map(spark, path, owner, stats)
    place, at = [], dict.fromkeys(range(shards), 0)
    for k in range(slots + spare):
        place.append((k, owner[k], at[owner[k]]))
        at[owner[k]] += stats.get(k, (0, 0))[1]
    place = spark.createDataFrame(place, "vslot int, shard int, before long")
    w = Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size", "place")
    ranked = rows.withColumn("at", F.row_number().over(w) - 1).join(F.broadcast(place), "vslot")
    return ranked.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("at") + F.col("before")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "vslot")
