"""Weighted rendezvous hashing of record keys over shards.

Every shard draws a score from a hash of the key and its own number; the highest score takes the record. A record's
choice between two shards never depends on the others, so a new shard takes records only into itself, and a shard that
goes gives its records to the rest in proportion to their weights.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vakanta.llm.common import checkpointed, plain_text

SLOT_PARTS = 1024


def shard_score(key: Column, shard: int, weight: float) -> Column:
    """``weight / -ln(u)`` with ``u`` in (0, 1) from 53 bits of a hash of key and shard; null keys share one draw."""
    bits = F.shiftrightunsigned(F.xxhash64(key.cast("long"), F.lit(shard)), 11)
    return F.lit(float(weight)) / -F.log((bits.cast("double") + 0.5) / F.lit(float(2**53)))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard with the highest score, the lower number on a tie; shards of weight 0 take nothing."""
    draws = [F.struct(shard_score(key, s, w).alias("score"), F.lit(-s).alias("back")) for s, w in enumerate(weights) if w > 0]
    return -F.array_max(F.array(*draws))["back"]


def place(docs: DataFrame, weights: Sequence[float], key: str = "doc_id", text: str = "text", grow_by: float = 1.0) -> DataFrame:
    """Shard and slot of every row; ``grown_shard`` is its shard if one more of weight ``grow_by`` joined.

    Rows: key, size (UTF-8 bytes of the text, 0 for null, plus 8), text_crc32 (0 for null or empty), shard, slot
    (gapless from 0 in each shard), grown_shard. Repeated rows and keys keep a row each and share their shard; null keys
    form one key. Other columns are ignored. An empty table gives no rows.

    Slots need no task that sees a whole shard: rows are numbered inside ``SLOT_PARTS`` hash parts of each shard and
    moved up by the counts of the parts before, a table of shards x parts rows.
    """
    k = F.col(key).cast("long")
    best, grown = rendezvous(k, weights), rendezvous(k, [*weights, grow_by])
    crc = F.crc32(plain_text(text).cast("binary"))
    placed = docs.select(
        k.alias("key"),
        (F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)).cast("long") + 8).alias("size"),
        crc.alias("text_crc32"),
        best.cast("int").alias("shard"),
        grown.cast("int").alias("grown_shard"),
    ).withColumn("part", F.pmod(F.xxhash64("key", "text_crc32", "size"), F.lit(SLOT_PARTS)).cast("int"))
    placed = checkpointed(placed)
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = counts.select(
        "shard", "part", (F.sum("n").over(W.partitionBy("shard").orderBy("part")) - F.col("n")).alias("before")
    )
    order = W.partitionBy("shard", "part").orderBy("key", "text_crc32", "size")
    numbered = placed.withColumn("inside", F.row_number().over(order) - 1)
    return numbered.join(before, ["shard", "part"]).select(
        F.col("key").alias(key), "size", "text_crc32", "shard", (F.col("inside") + F.col("before")).alias("slot"), "grown_shard"
    )
