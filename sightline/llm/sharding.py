"""Sharding by fixed virtual slots and an edited slot-to-shard map.

A record hashes into one of 16384 slots for good.  Bytes are summed per slot;
the map assigns slots to shards so that bytes are nearly equal, and is stored
as a version of a map table, from which it is read back and applied.  A
rebalance edits the newest version: slots move only from the fullest to the
emptiest shards, until no move helps, and the edit is stored as a new version.
Shards differ by a few slots' bytes, whatever rows share a text: equal texts
are no unit here and may lie on several shards, since a text that a third of
all rows share could not be kept together under near-equal bytes.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace

SLOTS = 1 << 14
ROW_BYTES = 16
#: Parts of a virtual slot whose rows are numbered in different tasks.
PARTS = 16

MAP_SCHEMA = T.StructType([T.StructField("version", T.IntegerType()), T.StructField("shards", T.IntegerType()), T.StructField("vslot", T.IntegerType()), T.StructField("shard", T.IntegerType())])


@dataclass(frozen=True)
class SlotMap:
    version: int
    shards: int
    shard_of: np.ndarray  # int32, one entry a slot


def assign(slot_bytes: np.ndarray, shards: int) -> SlotMap:
    """Version 0: heaviest slot first, each to the shard with the fewest bytes (ties: lowest shard); empty slots in turn."""
    heap = [(0, s) for s in range(shards)]
    out = np.zeros(len(slot_bytes), np.int32)
    for i in np.argsort(-slot_bytes, kind="stable")[: np.count_nonzero(slot_bytes)]:
        load, s = heapq.heappop(heap)
        out[i] = s
        heapq.heappush(heap, (load + int(slot_bytes[i]), s))
    none = np.flatnonzero(slot_bytes == 0)
    out[none] = np.arange(len(none)) % shards
    return SlotMap(0, shards, out)


def rebalance(old: SlotMap, slot_bytes: np.ndarray, shards: int | None = None, tolerance: float = 0.005) -> SlotMap:
    """The next version of a map for new sizes or a new shard count, moving few slots.

    Slots of shards that cease go to the emptiest shards, empty slots from shards
    with most of them to those with fewest.  After that the fullest shard gives the emptiest the largest slot that narrows their gap,
    until all shards are within ``tolerance`` of the mean or nothing helps.
    """
    if len(old.shard_of) != len(slot_bytes):
        raise ValueError(f"the stored map has {len(old.shard_of)} slots, not {len(slot_bytes)}: a record's slot is fixed for good")
    shards = old.shards if shards is None else shards
    out = old.shard_of.copy()
    none = np.flatnonzero(slot_bytes == 0)
    quota = np.bincount(np.arange(len(none)) % shards, minlength=shards)
    spare = []
    for i in none:  # empty slots over a shard's quota, and those of shards that cease
        if out[i] < shards and quota[out[i]] > 0:
            quota[out[i]] -= 1
        else:
            spare.append(i)
    out[spare] = np.repeat(np.arange(shards), quota)
    load = np.bincount(out, weights=slot_bytes, minlength=max(shards, old.shards)).astype(np.int64)[:shards]
    for i in np.flatnonzero(out >= shards)[np.argsort(-slot_bytes[out >= shards], kind="stable")]:
        out[i] = int(load.argmin())
        load[out[i]] += int(slot_bytes[i])
    mean = load.sum() / shards
    for _ in range(4 * len(out)):
        hi, lo = int(load.argmax()), int(load.argmin())
        gap = int(load[hi] - load[lo])
        if load[hi] <= mean * (1 + tolerance) and load[lo] >= mean * (1 - tolerance):
            break
        own = np.flatnonzero(out == hi)
        fits = own[(slot_bytes[own] > 0) & (slot_bytes[own] <= gap // 2)]
        if not len(fits):
            fits = own[(slot_bytes[own] > 0) & (slot_bytes[own] < gap)]
            if not len(fits):
                break
            pick = fits[slot_bytes[fits].argmin()]
        else:
            pick = fits[slot_bytes[fits].argmax()]
        out[pick] = lo
        load[hi] -= int(slot_bytes[pick])
        load[lo] += int(slot_bytes[pick])
    return SlotMap(old.version + 1, shards, out)


def map_frame(spark: SparkSession, m: SlotMap) -> DataFrame:
    return spark.createDataFrame([(m.version, m.shards, i, int(s)) for i, s in enumerate(m.shard_of)], MAP_SCHEMA)


def save_map(spark: SparkSession, m: SlotMap, path: str) -> None:
    """Add a version to the map table; older versions stay readable."""
    map_frame(spark, m).coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
    """A stored version, the newest by default."""
    t = spark.read.parquet(path)
    v = t.agg(F.max("version")).first()[0] if version is None else version
    rows = t.where(F.col("version") == v).orderBy("vslot").collect()
    return SlotMap(int(v), rows[0].shards, np.array([r.shard for r in rows], np.int32))


def virtual_slot(slots: int = SLOTS) -> Column:
    """A record's slot: by id, size and text digest, so that one hot id still spreads."""
    return F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(slots)).cast("int")


def records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """doc_id, size (UTF-8 bytes + 16), text_crc32 (null text: of nothing) and vslot."""
    raw = F.coalesce(F.col(text_col).cast("string").cast("binary"), F.lit(b""))
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(raw) + ROW_BYTES).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    return out.withColumn("vslot", virtual_slot(slots))


def shard(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """Every row's shard under near-equal bytes: doc_id, size, text_crc32, vslot, shard, slot.

    ``slot`` is the row's place in its shard, 0, 1, 2, ... without gaps: virtual
    slots follow each other in a shard; a virtual slot's rows are numbered in
    PARTS parts, by where they were read, so that copies of one row, of whatever
    number, are never all in one task.  Null texts have 16 bytes; null ids hash
    like any value; texts of any length count whole, and a single text above a
    shard's share makes its shard larger.  Other columns are not read.  An
    empty table gives an empty result.  The map is stored below ``map_path`` (by
    default in the shared folder), or, where a version exists there, edited into
    a new one; what is applied is what was read back.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "shards")
    rows = ws.stage(records(docs, id_col, text_col, slots).withColumn("part", (F.spark_partition_id() % PARTS)), "records")
    # at most one row a virtual slot reaches the driver and is broadcast: a fixed bound
    size, count = np.zeros(slots, np.int64), np.zeros(slots, np.int64)
    for r in rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect():
        size[r.vslot], count[r.vslot] = r["bytes"], r["rows"]
    stored = None
    map_path = map_path or ws.path("map")
    try:
        stored = load_map(spark, map_path)
    except AnalysisException as e:  # no version yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    save_map(spark, rebalance(stored, size, shards) if stored else assign(size, shards), map_path)
    m = load_map(spark, map_path)
    start = np.zeros(slots, np.int64)
    for s in range(shards):
        own = np.flatnonzero(m.shard_of == s)
        start[own] = np.cumsum(count[own]) - count[own]
    table = spark.createDataFrame([(i, int(m.shard_of[i]), int(start[i])) for i in range(slots)], "vslot int, shard int, start long")
    before = F.sum("rows").over(Window.partitionBy("vslot").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = rows.groupBy("vslot", "part").agg(F.count("*").alias("rows")).select("vslot", "part", F.coalesce(before, F.lit(0)).alias("before"))
    place = Window.partitionBy("vslot", "part").orderBy("doc_id", "text_crc32", "size")
    out = rows.withColumn("in_part", F.row_number().over(place) - 1).join(parts, ["vslot", "part"]).join(F.broadcast(table), "vslot")
    return out.select("doc_id", "size", "text_crc32", "vslot", "shard", (F.col("start") + F.col("before") + F.col("in_part")).alias("slot"))
