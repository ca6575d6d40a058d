"""Sharding by fixed virtual slots, with DataFrame operations only.

A record's id is hashed into one of SLOTS virtual slots, for ever. A versioned map gives the shard of each slot. Growing by a shard edits
the map: the new shard takes its share of slots from the fullest shards, all other slots stay. So a record's shard follows from its id and
the number of shards, and one more shard takes rows only into itself (the `key` law). assign() aggregates bytes and rows by slot over all documents,
stores them with each version of the map, and places rows by the stored versions; rebalance() edits a map by the loads that read_loads() gives.

Defined results. Null text: size 8, crc32 of nothing (0). Null ids: one slot. Repeated rows, or ids: one shard, adjacent positions. Ties: positions go by virtual slot, id, crc32 and size;
rows that agree in all of these are interchangeable. Very long texts: a row like others; only its size counts. Empty table: no rows. Other columns of the input play no part, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import constant, materialize, new_path, pick, prefix_sums

#: Fixed for the life of a data set.
SLOTS = 4096
SHARDS = 24
ROW_BYTES = 8


def _rank(slot: int, shard: int) -> int:
    """A fixed mixing of a slot's number, so that the slots taken by a new shard are spread over the others."""
    x = (slot * 0x9E3779B97F4A7C15 + shard * 0xD1B54A32D192ED03) & (2**64 - 1)
    x ^= x >> 29
    return (x * 0xBF58476D1CE4E5B9) & (2**64 - 1)


def grow(slot_map: list[int], loads: list[int] | None = None) -> list[int]:
    """The map edited for one more shard: it takes slots from the shards that have most (of `loads` per slot, else of slots) until it has its share."""
    loads, new, out = loads or [1] * len(slot_map), max(slot_map) + 1, list(slot_map)
    held: dict[int, list[int]] = {s: [] for s in range(new)}
    for slot, shard in enumerate(slot_map):
        held[shard].append(slot)
    for slots in held.values():
        slots.sort(key=lambda s: (_rank(s, new), s), reverse=True)
    total = {s: sum(loads[x] for x in slots) for s, slots in held.items()}
    share, got = sum(loads) // (new + 1), 0
    while got < share:
        fullest = max((s for s in held if len(held[s]) > 1), key=lambda s: (total[s], -s), default=None)
        if fullest is None:
            break
        slot = held[fullest].pop()
        total[fullest] -= loads[slot]
        got += loads[slot]
        out[slot] = new
    return out


def slot_map(shards: int = SHARDS, slots: int = SLOTS) -> list[int]:
    """The map for so many shards: that for one shard, grown shard by shard."""
    out = [0] * slots
    for _ in range(shards - 1):
        out = grow(out)
    return out


def rebalance(slot_map: list[int], loads: list[int], tolerance: float = 0.02, most_moves: int | None = None) -> list[int]:
    """The map edited so that no shard holds more than (1 + tolerance) times the mean load, moving slots from the fullest to the emptiest shard.

    It ends where no slot of the fullest shard fits; a single slot above the limit can't be split. Works on the slots' totals, SLOTS numbers.
    """
    out, n = list(slot_map), max(slot_map) + 1
    total = [0] * n
    for slot, shard in enumerate(out):
        total[shard] += loads[slot]
    mean = sum(loads) / n
    for _ in range(most_moves if most_moves is not None else len(out)):
        full, empty = max(range(n), key=lambda s: (total[s], -s)), min(range(n), key=lambda s: (total[s], s))
        if total[full] <= mean * (1 + tolerance):
            break
        fits = [s for s, shard in enumerate(out) if shard == full and 0 < loads[s] < total[full] - total[empty]]
        if not fits:
            break
        best = min(fits, key=lambda s: (abs(2 * loads[s] - (total[full] - total[empty])), s))
        out[best] = empty
        total[full] -= loads[best]
        total[empty] += loads[best]
    return out


def slot_of(doc_id: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(slots)).cast("int")


def shard_of(slot: Column, slot_map: list[int]) -> Column:
    return F.get(constant(slot_map, "int"), slot)


def slot_loads(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """virtual_slot, bytes, rows; every slot has a row."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + ROW_BYTES
    sums = pick(docs, "doc_id", "text").groupBy(slot_of(F.col("doc_id"), slots).alias("virtual_slot")).agg(F.sum(size).alias("bytes"), F.count("*").alias("rows"))
    every = docs.sparkSession.range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
    return every.join(sums, "virtual_slot", "left").na.fill(0, ["bytes", "rows"])


def write_map(spark: SparkSession, path: str, version: int, slot_map: list[int], loads: DataFrame | None = None) -> None:
    """Store a version of the map: virtual_slot, shard, and the slot's bytes and rows if given. Versions are never overwritten."""
    rows = spark.range(1).select(F.posexplode(constant(slot_map, "int")).alias("virtual_slot", "shard"))
    if loads is not None:
        rows = rows.join(loads, "virtual_slot")
    rows.coalesce(1).write.mode("error").parquet(f"{path}/version={version}")


def read_map(spark: SparkSession, path: str, version: int) -> list[int]:
    """A stored map; it has SLOTS numbers, whatever the size of the data."""
    return [r[0] for r in spark.read.parquet(f"{path}/version={version}").orderBy("virtual_slot").select("shard").collect()]


def read_loads(spark: SparkSession, path: str, version: int) -> list[int]:
    """The bytes of each slot that are stored with a map."""
    return [r[0] for r in spark.read.parquet(f"{path}/version={version}").orderBy("virtual_slot").select("bytes").collect()]


def assign(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (the position in the shard, from 0 without gaps), grown_shard, virtual_slot of every document.

    The map is stored under `path` (a new folder by default) with the slots' loads: version 0 for so many shards, version 1 grown by one.
    """
    spark, path = docs.sparkSession, path or new_path(docs.sparkSession, "shard-maps")
    loads = materialize(slot_loads(docs, slots), "shard-loads")
    write_map(spark, path, 0, slot_map(shards, slots), loads)
    now = read_map(spark, path, 0)
    write_map(spark, path, 1, grow(now), loads)
    later = read_map(spark, path, 1)
    text = F.coalesce("text", F.lit("")).cast("binary")
    d = pick(docs, "doc_id", "text").select("doc_id", (F.octet_length(text).cast("long") + ROW_BYTES).alias("size"), F.crc32(text).alias("text_crc32"), slot_of(F.col("doc_id"), slots).alias("virtual_slot"))
    d = materialize(d.withColumn("shard", shard_of(F.col("virtual_slot"), now)).withColumn("one", F.lit(1).cast("long")), "shard-rows")
    placed = prefix_sums(d, ["shard"], ["virtual_slot", "doc_id", "text_crc32", "size"], "one", "nth", "shard-slots")
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("nth") - 1).alias("slot"), shard_of(F.col("virtual_slot"), later).alias("grown_shard"), "virtual_slot")


def write_shards(docs: DataFrame, path: str, slot_map: list[int], files_per_shard: int = 1) -> None:
    """The documents with all their columns as Parquet, a folder for each shard; a shard's rows spread over so many files."""
    slot = slot_of(F.col("doc_id"), len(slot_map))
    spread = docs.withColumn("shard", shard_of(slot, slot_map))
    spread.repartition((max(slot_map) + 1) * files_per_shard, "shard", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(files_per_shard))).write.partitionBy("shard").parquet(path)
