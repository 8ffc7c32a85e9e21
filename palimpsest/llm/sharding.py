"""Operator 3: sharding through fixed virtual slots.

Records hash into a fixed number of virtual slots by their key and text. Bytes are summed for each slot, and a slot map, a small
versioned table (version, slot, shard, bytes), says which shard each slot lives in. Rebalancing edits the map and
writes a new version; records never hash anew. As the text is part of what is hashed, a key that very many rows share is
spread over the slots. Places are dealt out over parts of slots, a fixed number as well, so no task sorts a whole slot.

Defined cases: a null key and a null text hash like the empty string; a null text has no bytes and counts as `overhead`
bytes; very long texts are moved once and never split; rows equal in key and text share a slot, and each takes a place of
its own; an empty table gives an empty result and an all-zero map; extra columns stay, those named like a result column are replaced.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import scratch

SLOTS = 4096
#: Parts of a slot that are numbered apart.
PARTS = 16


def slot_and_part(key: Column, text: Column, slots: int = SLOTS) -> tuple[Column, Column]:
    """The virtual slot of a record, and its part of the slot: two stretches of the MD5 of its key and its text's XXH64."""
    whole = F.md5(F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("")), F.xxhash64(F.coalesce(text, F.lit(""))).cast("string")))
    number = lambda first: F.conv(F.substring(whole, first, 8), 16, 10).cast("long")
    return (number(1) % slots).cast("int"), (number(9) % PARTS).cast("int")


def slot_bytes(df: DataFrame, slot: Column, size: Column, slots: int = SLOTS) -> DataFrame:
    """Bytes and rows of every slot, empty slots included: (vslot, bytes, rows), as many rows as there are slots."""
    held = df.groupBy(slot.alias("vslot")).agg(F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("rows"))
    every = df.sparkSession.range(slots).select(F.col("id").cast("int").alias("vslot"))
    return every.join(held, "vslot", "left").select("vslot", F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"), F.coalesce("rows", F.lit(0)).cast("long").alias("rows"))


def balanced_map(sizes: DataFrame, shards: int) -> DataFrame:
    """Version 1 of a slot map: slots from large to small, each into the shard that is lightest so far (lowest number on ties).

    The slots are a fixed, small number, so they are folded as one array in one row.
    """
    largest_first = F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("neg"), F.col("vslot").alias("vslot"))))
    step = """
        aggregate(items,
          struct(array_repeat(0L, {n}) AS loads, cast(array() AS array<int>) AS took),
          (a, x) -> named_struct(
            'loads', transform(a.loads, (b, i) -> b + if(i = array_position(a.loads, array_min(a.loads)) - 1, -x.neg, 0L)),
            'took', array_append(a.took, cast(array_position(a.loads, array_min(a.loads)) - 1 AS int))),
          a -> a.took)
    """.format(n=shards)
    folded = sizes.agg(largest_first.alias("items")).select("items", F.expr(step).alias("took"))
    pairs = folded.select(F.explode(F.arrays_zip("items", "took")).alias("p"))
    return pairs.select(F.lit(1).alias("version"), F.col("p.items.vslot").alias("vslot"), F.col("p.took").alias("shard"), (-F.col("p.items.neg")).alias("bytes"))


def grown_map(slot_map: DataFrame, shards: int) -> DataFrame:
    """The next version with one more shard. Each old shard gives slots only while it stays at or above the new mean; all go to the new shard."""
    total = Window.partitionBy()
    per = Window.partitionBy("shard")
    mean = F.sum("bytes").over(total) / F.lit(shards + 1)
    given = F.sum("bytes").over(per.orderBy(F.desc("bytes"), "vslot").rowsBetween(Window.unboundedPreceding, 0))
    spare = F.sum("bytes").over(per) - mean
    return slot_map.select((F.col("version") + 1).alias("version"), "vslot", F.when(given <= spare, F.lit(shards)).otherwise(F.col("shard")).cast("int").alias("shard"), "bytes")


def save_map(slot_map: DataFrame, root: str) -> None:
    """Appends the map to the table of all versions; old versions stay readable."""
    slot_map.write.mode("append").partitionBy("version").parquet(root)


def load_map(spark: SparkSession, root: str, version: int) -> DataFrame:
    return spark.read.parquet(root).where(F.col("version") == version)


def shard(df: DataFrame, key: str, text: str, *, shards: int, slots: int = SLOTS, overhead: int = 8, root: str | None = None, carry: list[str] | None = None) -> DataFrame:
    """df with `size` (bytes), `vslot`, `shard` and `slot`, the place in the shard, gapless from 0.

    carry: the columns to keep (default: all). Places are dealt out by prefix sums over the parts of the slots of a shard,
    which are a fixed number, and a row number within one part. No task ever holds a whole shard or slot.
    """
    spark = df.sparkSession
    root = root or scratch(spark, "slot-map")
    size = (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + overhead).cast("long")
    slot, part = slot_and_part(F.col(key), F.col(text), slots)
    sized = df.withColumns({"size": size, "vslot": slot, "__part": part, "__t": F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0))})
    held = slot_bytes(sized, F.col("vslot"), F.col("size"), slots)
    save_map(balanced_map(held, shards), root)
    placed = load_map(spark, root, 1)
    keep = [c for c in (carry or df.columns) if c not in ("size", "vslot", "shard", "slot")]
    rows = sized.select(*dict.fromkeys([*keep, key]), "size", "vslot", "__part", "__t")
    first = Window.partitionBy("shard").orderBy("vslot", "__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("vslot", "__part").agg(F.count(F.lit(1)).alias("__n"))
    starts = placed.join(counts, "vslot").select("vslot", "__part", "shard", F.coalesce(F.sum("__n").over(first), F.lit(0)).alias("__first"))
    place = F.row_number().over(Window.partitionBy("vslot", "__part").orderBy(F.col(key).asc_nulls_first(), "__t", "size"))
    # The map has at most slots * PARTS rows, a constant: it is small enough to broadcast at any input size.
    numbered = rows.withColumn("__place", place).join(F.broadcast(starts), ["vslot", "__part"])
    return numbered.select(*keep, "size", "vslot", "shard", (F.col("__first") + F.col("__place") - 1).cast("long").alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """The shards as folders shard=N; each slot is one task's work, so a hot shard is written by many tasks."""
    sharded.repartition("shard", "vslot").write.partitionBy("shard").parquet(path)


def describe(slot_map: DataFrame) -> str:
    """A map's bytes by shard as JSON, for logs."""
    return json.dumps({r["shard"]: r["bytes"] for r in slot_map.groupBy("shard").agg(F.sum("bytes").alias("bytes")).orderBy("shard").collect()})


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into shards 0 to 23, by law `bytes`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = docs.withColumn("text_crc32", F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
    out = shard(docs, "doc_id", "text", shards=24, carry=["doc_id", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
