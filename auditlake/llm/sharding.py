"""Range shards of near equal size from sampled splitters; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.operators.durable import durable

#: Ranges per shard, sampled rows, and rows that are numbered in one task.
RANGES, SAMPLE, ROWS = 64, 1 << 16, 250_000
#: A range is overfull from this part of a shard on.
OVERFULL = 1 / 16


def range_of(key: Column, splitters: list) -> Column:
    """How many of the sorted splitters are at most the key: a binary search over a constant array."""
    if not splitters:
        return F.lit(0)
    ordered, steps = F.lit(splitters), [1 << b for b in reversed(range(len(splitters).bit_length()))]
    return F.aggregate(F.lit(steps), F.lit(0), lambda at, step: F.when(F.get(ordered, at + step - 1) <= key, at + step).otherwise(at))


def sample_splitters(rows: DataFrame, count: int, sample: int, total: int) -> list:
    """Keys that divide a size-weighted sample of (_key, _size, _tie) into ``count`` parts of equal size.

    A row is drawn with a chance in proportion to its size, by a hash of its values, and counts as
    what it stands for; rows larger than a sample's share are always drawn. About ``sample`` rows
    are drawn at any input size, and at most ``count`` keys come to the driver.
    """
    share = max(total / sample, 1e-9)
    chance = F.pmod(F.xxhash64("_tie", "_key", F.lit("draw")), F.lit(1 << 32)) / float(1 << 32)
    drawn = rows.where(chance < F.col("_size") / share).select("_key", F.greatest(F.col("_size").cast("double"), F.lit(share)).alias("w"))
    running = drawn.select("_key", "w", F.sum("w").over(Window.orderBy("_key").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.sum("w").over(Window.partitionBy()).alias("all"))
    part = F.floor((F.col("upto") - F.col("w")) * count / F.col("all"))
    least = running.groupBy(part.alias("part")).agg(F.min("_key").alias("key"))
    return sorted({r["key"] for r in least.where("part > 0").collect()})


def shard_by_size(rows: DataFrame, key: Column, size: Column, shards: int = 16, ranges: int = RANGES, sample: int = SAMPLE, overfull: float = OVERFULL, numbered: int = ROWS) -> DataFrame:
    """Put rows into ``shards`` ranges of ``key`` with near equal sums of ``size``.

    Splitters from a size-weighted sample cut the keys into ``shards * ranges`` ranges. Their exact
    sizes are then summed; a range over ``overfull`` of a shard (a key with many rows) or with more
    than ``numbered`` rows is divided further by a hash of the row. Runs of these parts become
    shards by the middle of each part, so a shard is off by at most a part on either side. Rows of
    equal key stay together unless their range was divided.

    Adds shard (int) and slot (long, gapless from 0 in each shard, in key order). Rows that repeat
    are placed one by one; null keys come first; sizes must be positive. An empty table gives no
    rows. Names that clash with the two new columns are replaced.
    """
    kept = [c for c in rows.columns if c not in ("shard", "slot")]
    base = durable(rows.select(*kept, F.coalesce(key, F.lit(-(1 << 63))).alias("_key"), size.cast("long").alias("_size")).withColumn("_tie", F.monotonically_increasing_id()))
    total, count = base.agg(F.sum("_size"), F.count("*")).first()
    splitters = sample_splitters(base, shards * ranges, sample, total) if count else []
    ranged = base.withColumn("_range", range_of(F.col("_key"), splitters))
    full = (total or 1) / shards
    parts = F.greatest(
        F.when(F.sum("_size") > full * overfull, F.ceil(F.sum("_size") * ranges / F.lit(full))).otherwise(1), F.ceil(F.count("*") / F.lit(numbered))
    )
    divided = ranged.join(F.broadcast(durable(ranged.groupBy("_range").agg(parts.alias("_parts")))), "_range").withColumn(
        "_part", F.pmod(F.xxhash64("_tie", F.lit("part")), "_parts")
    )
    held = divided.groupBy("_range", "_part").agg(F.sum("_size").alias("bytes"), F.count("*").alias("rows"))
    order = Window.orderBy("_range", "_part")
    upto = F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, 0))
    shard = F.least(F.floor((upto - F.col("bytes") / 2) * shards / F.lit(total or 1)), F.lit(shards - 1)).cast("int")
    before = F.sum("rows").over(Window.partitionBy("shard").orderBy("_range", "_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("rows")
    places = durable(held.withColumn("shard", shard).select("_range", "_part", "shard", before.alias("_before")))
    number = F.row_number().over(Window.partitionBy("_range", "_part").orderBy("_key", "_tie"))
    return (
        divided.join(F.broadcast(places), ["_range", "_part"])
        .select(*kept, "shard", (F.col("_before") + number - 1).cast("long").alias("slot"))
    )


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Shards of (doc_id, text) by UTF-8 bytes plus one: doc_id, size, text_crc32, shard, slot.

    The key is a hash of the text, so copies come together. A null text has no bytes.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    narrow = docs.select(F.col("doc_id").cast("long"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("_hash"))
    return shard_by_size(narrow, F.col("_hash"), F.col("size"), shards).drop("_hash")
