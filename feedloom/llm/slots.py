"""Sharding by fixed virtual slots (operator 5).

Records hash into a fixed number of slots, thousands, that never changes.  Bytes
are summed for each slot, and a versioned map sends slots to shards.  Rebalancing
edits the map: it moves whole slots, and no record is hashed again.
"""

from __future__ import annotations

import heapq
import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import new_path, stored, table

SLOTS = 8192
SHARDS = 40
#: Bytes that each record counts besides its text.
OVERHEAD = 16


@dataclass
class SlotMap:
    """Which shard holds each slot; every edit makes a new version and keeps what it moved."""

    shard: list[int]
    shards: int
    version: int = 1
    moved: dict[int, list[int]] = field(default_factory=dict)

    @classmethod
    def fit(cls, weight: dict[int, int], slots: int, shards: int) -> SlotMap:
        """Heaviest slot first, each to the lightest shard; slots without records are dealt in turn."""
        heap, shard = [(0, s) for s in range(shards)], [i % shards for i in range(slots)]
        for i in sorted(weight, key=lambda i: (-weight[i], i)):
            load, s = heap[0]
            shard[i] = s
            heapq.heapreplace(heap, (load + weight[i], s))
        return cls(shard, shards)

    def grow(self, weight: dict[int, int]) -> SlotMap:
        """One more shard, which takes slots from the heaviest shards until it has its share; nothing else moves."""
        new, shard, moved = self.shards, list(self.shard), []
        load = [0] * (new + 1)
        held: dict[int, list[int]] = {s: [] for s in range(new)}
        for i in sorted(weight, key=lambda i: (weight[i], i)):
            load[shard[i]] += weight[i]
            held[shard[i]].append(i)
        share = sum(load) / (new + 1)
        heap = [(-load[s], s) for s in held if held[s]]
        heapq.heapify(heap)
        while heap and load[new] < share:
            _, s = heapq.heappop(heap)
            i = held[s].pop()
            if load[new] + weight[i] <= share * 1.01:
                shard[i] = new
                moved.append(i)
                load[s] -= weight[i]
                load[new] += weight[i]
            if held[s]:
                heapq.heappush(heap, (-load[s], s))
        return SlotMap(shard, new + 1, self.version + 1, {**self.moved, self.version + 1: moved})

    def to_json(self) -> str:
        return json.dumps({"version": self.version, "shards": self.shards, "shard": self.shard, "moved": self.moved})

    @classmethod
    def from_json(cls, text: str) -> SlotMap:
        x = json.loads(text)
        return cls(x["shard"], x["shards"], x["version"], {int(k): v for k, v in x["moved"].items()})

    def rows(self, spark: SparkSession, counts: dict[int, int]) -> DataFrame:
        """(virtual_slot, shard, first): first is the number of records in the shard's earlier slots."""
        seen, out = [0] * self.shards, []
        for i, s in enumerate(self.shard):
            out.append((i, s, seen[s]))
            seen[s] += counts.get(i, 0)
        return spark.createDataFrame(out, "virtual_slot int, shard int, first long")

    def save(self, spark: SparkSession, path: str) -> None:
        """One more version beside the earlier ones."""
        spark.createDataFrame([(self.version, self.to_json())], "version int, map string").write.mode("append").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        found = spark.read.parquet(path)
        found = found.filter(F.col("version") == version) if version else found.orderBy(F.desc("version"))
        return cls.from_json(found.first()["map"])


def slot_of(n_slots: int = SLOTS) -> Column:
    """A slot by hash of the record (``h``), and of its number among equal ones (``copy``)."""
    h = F.when(F.col("copy") == 1, F.col("h")).otherwise(F.xxhash64("h", "copy"))
    return F.pmod(F.xxhash64(h), F.lit(n_slots)).cast("int")


def records(docs: DataFrame, n_slots: int = SLOTS) -> DataFrame:
    """Sizes, checksums and slots, written once.

    Rows with one doc_id spread by their texts.  Equal rows are numbered within
    the partition that reads them, and the number is hashed as well: a row that a
    third of the table repeats spreads over all slots, and none gathers in a task.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + F.lit(OVERHEAD)
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    rows = docs.select(F.col("doc_id"), size.alias("size"), crc.alias("text_crc32"), F.xxhash64("doc_id", "text").alias("h"), F.spark_partition_id().alias("part"))
    # Places change no one's result but that of equal rows, and the written table settles them for later steps.
    copy = F.row_number().over(Window.partitionBy("part", "h").orderBy("text_crc32"))
    return stored(rows.withColumn("copy", copy).select("doc_id", "size", "text_crc32", slot_of(n_slots).alias("virtual_slot")), "slot-records")


def slot_weights(recs: DataFrame) -> tuple[dict[int, int], dict[int, int]]:
    """Bytes and records of each slot; at most as many rows as there are slots reach the driver."""
    got = recs.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
    return {r.virtual_slot: r.b for r in got}, {r.virtual_slot: r.n for r in got}


def shard_records(docs: DataFrame, shards: int = SHARDS, n_slots: int = SLOTS, path: str | None = None) -> tuple[DataFrame, SlotMap]:
    """Each record's shard by the first version of the map, and that map.

    ``slot`` is a record's place in its shard, 0, 1, ... without gaps: virtual
    slots follow each other and doc_id orders the records of one.  Null texts
    have no bytes; equal rows get places of their own; records that tie in
    doc_id, checksum and size are interchangeable; a text of any length is one
    record; an empty table gives no rows; other columns are not read.  Both
    versions of the map are stored under ``path`` (a new one in the shared
    folder) and read from there.
    """
    spark = docs.sparkSession
    recs = records(docs, n_slots)
    weight, counts = slot_weights(recs)
    path = path or new_path(spark, "slot-maps")
    made = SlotMap.fit(weight, n_slots, shards)
    for version in (made, made.grow(weight)):
        version.save(spark, path)
    first, then = SlotMap.load(spark, path, 1), SlotMap.load(spark, path)
    # The maps have n_slots rows, a fixed number, so that broadcasting them is bounded.
    rows = first.rows(spark, counts).join(then.rows(spark, counts).select("virtual_slot", F.col("shard").alias("next_shard")), "virtual_slot")
    place = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")) - F.lit(1)
    out = recs.withColumn("place", place).join(F.broadcast(rows), "virtual_slot")
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("place")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "next_shard",
    ), first


def op5_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in 40 shards of nearly equal bytes; next_shard is version 2 of the map, with 41."""
    return shard_records(table(spark, sf_dir, "documents"))[0]


__all__ = ["SlotMap", "op5_virtual_slots", "shard_records"]
