"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

Records are hashed into ``N_SLOTS`` virtual slots by their text, so equal
texts share a slot and hence a shard. Bytes and rows are summed for each slot
(at most ``N_SLOTS`` rows plus the splits of hot slots, whatever the corpus
holds) and only these sums reach the driver, which assigns slots to shards,
largest first, each to the lightest shard. The map is stored as a table with
a version; rebalancing edits it by moving few slots and appends a version.

A slot heavier than one shard's fair share (a group of copies that holds a
large part of the corpus) is split into sub-slots by document id, so the
sizes stay near equal whatever one group weighs.

Defined results: null text has no bytes (size 1, crc 0); null ids hash like
any value; repeated rows are separate records that get neighbouring places;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, scratch_path, text_or_empty

N_SLOTS = 4096
MAP_SCHEMA = "version int, vslot int, sub int, n_sub int, shard int, bytes long, rows long"


def slotted(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, vslot and a spread hash for each record."""
    text = text_or_empty()
    return docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64(text), F.lit(n_slots)).cast("int").alias("vslot"),
        F.pmod(F.xxhash64(F.col("doc_id"), F.lit(17)), F.lit(1 << 20)).cast("int").alias("spread"),
    )


def lightest_first(weights: list[tuple[int, tuple]], n_shards: int) -> dict[tuple, int]:
    """Largest weight first, each to the shard that is lightest so far."""
    heap = [(0, shard) for shard in range(n_shards)]
    placed = {}
    for weight, key in sorted(weights, key=lambda x: (-x[0], x[1])):
        load, shard = heapq.heappop(heap)
        placed[key] = shard
        heapq.heappush(heap, (load + weight, shard))
    return placed


def split_counts(sums: list, n_shards: int) -> dict[int, int]:
    """Into how many sub-slots each slot goes: over 1 beyond a fair share of bytes or 4 times the mean rows."""
    fair = max(1.0, sum(r["bytes"] for r in sums) / n_shards)
    mean = max(1.0, sum(r["rows"] for r in sums) / max(1, len(sums)))
    return {
        r["vslot"]: max(1, 8 * math.ceil(r["bytes"] / fair) if r["bytes"] > fair else 1, math.ceil(r["rows"] / mean) if r["rows"] > 4 * mean else 1)
        for r in sums
    }


def build_map(records: DataFrame, n_shards: int, version: int = 1) -> list[tuple]:
    """Rows of a slot map for ``slotted`` records.

    A slot over a fair share of the bytes is spread sub-slot by sub-slot; one
    that is only long is split for sorting and stays in one shard.
    """
    sums = records.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()
    n_sub = split_counts(sums, n_shards)
    fair = sum(r["bytes"] for r in sums) / n_shards
    weights = {(r["vslot"], 0): (r["bytes"], r["rows"]) for r in sums if n_sub[r["vslot"]] == 1}
    units = [(r["bytes"], (r["vslot"], -1)) for r in sums if r["bytes"] <= fair]
    if any(n > 1 for n in n_sub.values()):
        subs = with_sub(records, n_sub).filter("n_sub > 1").groupBy("vslot", "sub").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
        weights |= {(r["vslot"], r["sub"]): (r["bytes"], r["rows"]) for r in subs.collect()}
    whole = {slot for _, (slot, _) in units}
    units += [(w[0], key) for key, w in weights.items() if key[0] not in whole]
    placed = lightest_first(units, n_shards)
    return [
        (version, slot, sub, n_sub[slot], placed[(slot, -1) if slot in whole else (slot, sub)], int(weights[slot, sub][0]), int(weights[slot, sub][1]))
        for slot, sub in sorted(weights)
    ]


def with_sub(records: DataFrame, n_sub: dict[int, int]) -> DataFrame:
    """Adds n_sub and the sub-slot, which is 0 in slots that aren't split."""
    table = records.sparkSession.createDataFrame(sorted(n_sub.items()), "vslot int, n_sub int")
    return records.join(F.broadcast(table), "vslot").withColumn("sub", F.pmod("spread", "n_sub").cast("int"))  # at most N_SLOTS rows


def rebalanced(current: list[tuple], n_shards: int, tolerance: float = 0.02) -> list[tuple]:
    """The next version of a map for ``n_shards``, moving few slots.

    Slots leave only shards above the new fair share (or shards that no
    longer exist) and go to the lightest shard.
    """
    total = sum(r[5] for r in current)
    fair = total / n_shards
    loads = [0] * n_shards
    kept, loose = [], []
    for row in sorted(current, key=lambda r: (-r[5], r[1], r[2])):
        shard = row[4]
        if shard < n_shards and loads[shard] + row[5] <= fair * (1 + tolerance):
            loads[shard] += row[5]
            kept.append(row)
        else:
            loose.append(row)
    heap = [(load, shard) for shard, load in enumerate(loads)]
    heapq.heapify(heap)
    for row in loose:
        load, shard = heapq.heappop(heap)
        kept.append((*row[:4], shard, *row[5:]))
        heapq.heappush(heap, (load + row[5], shard))
    version = max((r[0] for r in current), default=0) + 1
    return [(version, *row[1:]) for row in sorted(kept, key=lambda r: (r[1], r[2]))]


def store_map(spark: SparkSession, rows: list[tuple], path: str) -> DataFrame:
    """Append one version of the map to the table at ``path``."""
    table = spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1)
    table.write.mode("append").partitionBy("version").parquet(path)
    return spark.read.schema(MAP_SCHEMA).parquet(path)


def assign(records: DataFrame, slot_map: list[tuple]) -> DataFrame:
    """Puts each record in its shard with a gapless place there.

    The place is the rows of the shard's earlier slots plus the record's rank
    in its own sub-slot, so no task ever sorts a whole shard or a hot slot.
    """
    spark = records.sparkSession
    first, rows = {}, []
    for _, vslot, sub, _, shard, _, count in slot_map:
        rows.append((vslot, sub, shard, first.get(shard, 0)))
        first[shard] = first.get(shard, 0) + count
    table = spark.createDataFrame(rows, "vslot int, sub int, shard int, base long")
    place = Window.partitionBy("vslot", "sub").orderBy("doc_id", "text_crc32", "size")
    return (
        with_sub(records, {r[1]: r[3] for r in slot_map})
        .withColumn("place", F.row_number().over(place))
        .join(F.broadcast(table), ["vslot", "sub"])  # a few times N_SLOTS rows
        .select(
            "doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("place") - 1).alias("slot"),
            F.col("vslot").alias("virtual_slot"),
        )
    )


def shard_documents(docs: DataFrame, n_shards: int = 8, n_slots: int = N_SLOTS, map_path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, virtual_slot, map_version."""
    spark = docs.sparkSession
    records = materialize(slotted(docs, n_slots), "slotted")
    rows = build_map(records, n_shards)
    store_map(spark, rows, map_path or scratch_path(spark, "slot-map"))
    return assign(records, rows).withColumn("map_version", F.lit(1))


def op3_virtual_slot_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shard_documents(docs).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version",
    )
