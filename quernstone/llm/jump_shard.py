"""Sharding by jump consistent hashing (Lamping and Veach, 2014).

A row's shard follows from its key and the number of shards alone: no ring table is kept, nothing is
looked up, and with one more shard a row either stays or moves into the new shard.

Defined cases: a null key is a key of its own; a null text has no bytes and checksum 0; repeated rows
share a shard and take separate slots; an empty table gives an empty result; further columns pass through, except that shard, slot and grown_shard are the results.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Multiplier of the 64-bit linear congruential generator in the published algorithm.
LCG = np.uint64(2862933555777941757)

#: Rows of the offset table up to which it may be broadcast; it has shards x buckets rows, whatever the input.
MAX_BROADCAST_OFFSETS = 1_000_000


def jump(keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Shard of each unsigned 64-bit key among `shards`, and among `shards + 1`."""
    key = keys.astype(np.uint64, copy=True)
    here, leap = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
    moving = np.arange(len(key))
    with np.errstate(over="ignore"):
        while len(moving):
            here[moving] = leap[moving]
            k = key[moving] * LCG + np.uint64(1)
            key[moving] = k
            leap[moving] = ((here[moving] + 1) * (float(1 << 31) / ((k >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
            moving = moving[leap[moving] < shards]
    return here, np.where(leap == shards, shards, here)


def assign(df: DataFrame, key: str, shards: int) -> DataFrame:
    """Add shard and grown_shard (the shard with one more). One pass, no shuffle."""

    @F.pandas_udf("shard int, grown_shard int")
    def placed(hashed: pd.Series) -> pd.DataFrame:
        now, grown = jump(hashed.to_numpy(np.int64).view(np.uint64), shards)
        return pd.DataFrame({"shard": now.astype(np.int32), "grown_shard": grown.astype(np.int32)})

    return df.withColumn("__p", placed(F.xxhash64(F.col(key)))).select(*[c for c in df.columns if c not in ("shard", "grown_shard")], "__p.shard", "__p.grown_shard")


def with_slots(df: DataFrame, key: str, shards: int, order: list[str], buckets: int = 1024) -> DataFrame:
    """Number each shard's rows from 0 without gaps.

    A shard is cut into hash buckets of the key. Rows are numbered inside a bucket, and a bucket starts
    where the rows of the lower ones end, so no task ever holds a shard. The bucket counts read the key
    column alone. `order` breaks ties inside a bucket.
    """
    bucket = F.pmod(F.xxhash64(F.col(key), F.lit("slot")), F.lit(buckets)).cast("int")
    counts = assign(df.select(key), key, shards).withColumn("__b", bucket).groupBy("shard", "__b").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("shard").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    if shards * buckets <= MAX_BROADCAST_OFFSETS:
        offsets = F.broadcast(offsets)
    inside = Window.partitionBy("shard", "__b").orderBy(*order)
    placed = assign(df, key, shards).withColumn("__b", bucket).withColumn("__i", F.row_number().over(inside) - 1)
    out = placed.join(offsets, ["shard", "__b"])
    return out.select(*[c for c in df.columns if c not in ("shard", "slot", "grown_shard")], "shard", (F.col("__off") + F.col("__i")).cast("long").alias("slot"), "grown_shard")


def shard(docs: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Shard table of documents under the law `key`: key, size, text_crc32, law, shard, slot, grown_shard."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(key, (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"))
    return with_slots(rows, key, shards, [key, "text_crc32", "size"])
