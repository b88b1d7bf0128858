"""Sharding by fixed virtual slots and a versioned map from slots to shards.

Records are hashed into ``slots`` virtual slots; the hash covers doc_id, content and, for each
``RUN`` copies of one record, the number of that run, so neither a hot doc_id nor a record that
is repeated without bound stays in one slot. Rows and bytes are summed for each slot.

The map lives in a store, a folder with a table for each version. Version 1 deals the slots out in turn. A
run over other bytes, or for more or fewer shards, loads the last version and edits it by moves and swaps of slots
between the fullest and the emptiest shard until they are within ``TOLERANCE`` or no edit helps; what has not
moved keeps its shard, and an edited map is written as the next version. Only the map (as many rows as slots) ever
meets the driver. The law that holds is ``bytes``.

Equal rows are counted, not carried, in the first shuffle, and by runs in the second.
Places in a shard come from running counts over slots, not from a sort of the shard.

Defined results: null or empty text has size 1 and crc32 0; a null doc_id is hashed as null; repeated
rows get a place each; an empty table gives no rows; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_dir, written

SLOTS, SHARDS = 4096, 8
#: Copies of one record that share a slot; they are one row until the last step.
RUN = 16
#: Runs of one record that one array names; more of them are named by a second array.
LOT = 10_000
#: Largest difference between two shards, as a share of the mean, that needs no edit.
TOLERANCE = 1e-4


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, run, virtual_slot, copies: one row for each ``RUN`` copies of a record."""
    text = F.col("text").cast("string")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"))
    counted = slim.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("all"))
    zero = F.lit(0).cast("long")
    lots = counted.withColumn("lot", F.explode(F.sequence(zero, F.expr(f"(all - 1) div {RUN * LOT}"))))
    inside = F.least(F.lit(LOT - 1).cast("long"), F.expr(f"(all - 1) div {RUN} - lot * {LOT}"))
    runs = lots.withColumn("run", F.explode(F.sequence(zero, inside))).withColumn("run", F.col("lot") * LOT + F.col("run"))
    slot = F.pmod(F.xxhash64("doc_id", "size", "text_crc32", "run"), F.lit(slots)).cast("int")
    return runs.select("doc_id", "size", "text_crc32", "run", slot.alias("virtual_slot"), F.least(F.lit(RUN), F.col("all") - F.col("run") * RUN).alias("copies"))


def rebalance(sizes: list[int], shard_of: list[int], shards: int, tolerance: float = TOLERANCE) -> list[int]:
    """The map edited so that bytes are near equal: each edit moves or swaps slots of the fullest and the emptiest shard and narrows their gap. Slots of shards that are no more go to the emptiest first, the largest slots before the others. Edits end when the shards are within the tolerance, when none narrows the gap, or after four for each slot; in each case the map is valid and every row placed."""
    shard_of = list(shard_of)
    load = [0] * shards
    for slot, shard in enumerate(shard_of):
        if shard < shards:
            load[shard] += sizes[slot]
    for slot in sorted((s for s, h in enumerate(shard_of) if h >= shards), key=lambda s: (-sizes[s], s)):
        shard_of[slot] = min(range(shards), key=load.__getitem__)
        load[shard_of[slot]] += sizes[slot]
    least = tolerance * sum(load) / shards
    for _ in range(4 * len(sizes)):
        full, bare = max(range(shards), key=load.__getitem__), min(range(shards), key=load.__getitem__)
        gap = load[full] - load[bare]
        if gap <= least:
            break
        give = sorted((sizes[s], s) for s, h in enumerate(shard_of) if h == full and sizes[s])
        take = [(0, -1), *sorted((sizes[s], s) for s, h in enumerate(shard_of) if h == bare and sizes[s])]
        best = None
        for size, slot in give:
            at = bisect_left(take, (size - gap / 2, -2))
            for back, other in take[max(0, at - 1) : at + 1]:
                rest = abs(gap - 2 * (size - back))
                if rest < gap and (best is None or rest < best[0]):
                    best = (rest, slot, other, size - back)
        if best is None:
            break
        _, slot, other, moved = best
        shard_of[slot] = bare
        if other >= 0:
            shard_of[other] = full
        load[full] -= moved
        load[bare] += moved
    return shard_of


def map_table(spark: SparkSession, shard_of: list[int]) -> DataFrame:
    shards = F.split(F.lit(",".join(map(str, shard_of))), ",")
    return spark.range(len(shard_of)).select(F.col("id").cast("int").alias("virtual_slot"), F.element_at(shards, (F.col("id") + 1).cast("int")).cast("int").alias("shard")).coalesce(1)


def load_map(spark: SparkSession, store: str) -> tuple[int, list[int]]:
    """The last version in a store and its shard by slot; version 0 and none where there is no store yet."""
    try:
        table = spark.read.schema("virtual_slot int, shard int, version int").parquet(store)
        rows = table.where(F.col("version") == table.agg(F.max("version")).first()[0]).collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = []
    if not rows:
        return 0, []
    shard_of = [0] * len(rows)
    for row in rows:
        shard_of[row["virtual_slot"]] = row["shard"]
    return rows[0]["version"], shard_of


def _save(spark: SparkSession, store: str, version: int, shard_of: list[int]) -> None:
    """A version is written once; a second writer of it fails instead of replacing it."""
    map_table(spark, shard_of).write.parquet(f"{store}/version={version}")


def edit_map(spark: SparkSession, store: str, sizes: list[int], shards: int, tolerance: float = TOLERANCE) -> int:
    """Load the map, edit it for these bytes by slot and this many shards, and write the next version if it changed; the version that holds."""
    version, shard_of = load_map(spark, store)
    if not version:
        version, shard_of = 1, [slot % shards for slot in range(len(sizes))]
        _save(spark, store, version, shard_of)
    if len(shard_of) != len(sizes):
        raise ValueError(f"the map of {store} has {len(shard_of)} slots, not {len(sizes)}")
    edited = rebalance(sizes, shard_of, shards, tolerance)
    if edited != shard_of:
        version += 1
        _save(spark, store, version, edited)
    return version


def slot_map(recs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, store: str | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """All versions of the map: virtual_slot, shard, version, rows, bytes, base (rows of the shard in lower slots); the last holds. Without a ``store`` the map is a new one in the shared folder."""
    spark = recs.sparkSession
    store = store or f"{shared_dir(spark)}/slot-map-{uuid.uuid4().hex}"
    stats = written(recs.groupBy("virtual_slot").agg(F.sum("copies").alias("rows"), F.sum(F.col("copies") * F.col("size")).alias("bytes")), "slots")
    sizes = [0] * slots
    for row in stats.collect():  # at most ``slots`` rows
        sizes[row["virtual_slot"]] = row["bytes"]
    edit_map(spark, store, sizes, shards, tolerance)
    versions = spark.read.schema("virtual_slot int, shard int, version int").parquet(store)
    full = versions.join(stats, "virtual_slot", "left").na.fill(0, ["rows", "bytes"])
    before = Window.partitionBy("version", "shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    return written(full.withColumn("base", F.coalesce(F.sum("rows").over(before), F.lit(0))), "slot-places")


def shard(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, store: str | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (place in the shard from 0), grown_shard, virtual_slot, map_version. With a ``store`` its map is the one that is edited and written on."""
    recs = written(records(docs, slots), "records")
    versions = slot_map(recs, shards, slots, store, tolerance)
    table = versions.where(F.col("version") == versions.agg(F.max("version")).first()[0]).select("virtual_slot", "shard", "version", "base")
    before = Window.partitionBy("virtual_slot").orderBy("doc_id", "size", "text_crc32", "run").rowsBetween(Window.unboundedPreceding, -1)
    placed = recs.withColumn("at", F.coalesce(F.sum("copies").over(before), F.lit(0))).join(F.broadcast(table), "virtual_slot")
    rows = placed.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("at") + F.col("copy")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.col("version").alias("map_version"),
    )
