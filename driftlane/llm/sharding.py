"""Shards by weighted rendezvous hashing, in DataFrame functions only.

Each record key draws one number u in (0, 1] per shard from md5(key:shard); the
shard with the least -ln(u) / weight takes the record. So shares follow the
weights, key and shard list alone decide, and one more shard only takes
records into itself: the draws of the others don't change.

Slots number a shard's records without gaps. A shard is dealt into BUCKETS by
a hash of the key; each bucket is numbered on its own and starts where the
counts of those before it end, so no task holds a whole shard. The table of
counts has at most shards * BUCKETS rows whatever the input, so it is
broadcast.

Defined cases: a null doc_id is the key '' ; a null text has no bytes (crc32 of
the empty text); repeated rows go to one shard and get slots of their own; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARDS, BUCKETS = 40, 256
_HEX = 12


def _draw(key: Column, shard: int) -> Column:
    digest = F.md5(F.concat(key, F.lit(f":{shard}")).cast("binary"))
    return (F.conv(F.substring(digest, 1, _HEX), 16, 10).cast("double") + 1) / F.lit(float(16**_HEX))


def assign(key: Column, weights: list[float]) -> Column:
    """Number of the shard that takes the key; equal weights need no logarithm, as it keeps the order."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    if len(set(weights)) == 1:
        scored = [F.struct(F.substring(F.md5(F.concat(key, F.lit(f":{s}")).cast("binary")), 1, _HEX).alias("x"), F.lit(-s).alias("shard")) for s in range(len(weights))]
    else:
        scored = [F.struct((F.ln(_draw(key, s)) / F.lit(float(w))).alias("x"), F.lit(-s).alias("shard")) for s, w in enumerate(weights)]
    best = scored[0] if len(scored) == 1 else F.greatest(*scored)
    return (-best["shard"]).cast("int")


def shard(documents: DataFrame, weights: list[float] | None = None, grown_weight: float | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (with one more shard of grown_weight)."""
    weights = weights or [1.0] * SHARDS
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    data = F.coalesce("text", F.lit("")).cast("binary")
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(data) + 16).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"),
        assign(key, weights).alias("shard"),
        assign(key, [*weights, grown_weight or weights[-1]]).alias("grown_shard"),
        F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int").alias("bucket"),
    )
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32")
    numbered = rows.withColumn("rank", F.row_number().over(inside))
    return numbered.join(F.broadcast(starts), ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("rank") - 1).cast("long").alias("slot"), "grown_shard"
    )
