"""Rendezvous (highest-random-weight) sharding.  DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .shared import free_name, table

#: Rows of one shard that a single window task numbers, at most on average.
SLOT_ROWS = 50_000


def _score(key: Column, shard: Column, seed: int) -> Column:
    """A uniform draw in (0, 1), fixed by key and shard."""
    high = F.shiftrightunsigned(F.xxhash64(F.lit(seed), key, shard), 11).cast("double")
    return (high + 0.5) / F.lit(float(1 << 53))


def rendezvous(key: Column, weights: Sequence[float], seed: int = 0) -> Column:
    """Struct (score, shard) of the shard with the highest weighted score, ties to the smaller shard.

    A shard's score depends on the key, its number and its own weight alone, so adding a
    shard moves only the keys that the new shard wins, and changing one weight only moves
    keys into or out of that shard.  Expected shares follow the weights; a weight of 0 or
    less takes nothing.  A null key counts as the text "\\0null".
    """
    if not any(w > 0 for w in weights):
        raise ValueError("at least one shard needs a positive weight")
    key = F.coalesce(key.cast("string"), F.lit("\0null"))
    table = F.array(*[F.lit(float(w)) for w in weights])
    each = F.transform(
        table,
        lambda w, i: F.struct(
            F.when(w > 0, F.ln(_score(key, i, seed)) / F.when(w > 0, w)).otherwise(F.lit(-math.inf)).alias("score"),
            (-i).alias("minus"),
        ),
    )
    best = F.array_max(each)
    return F.struct(best["score"].alias("score"), (-best["minus"]).cast("int").alias("shard"))


def grown(best: Column, key: Column, shards: int, weight: float = 1.0, seed: int = 0) -> Column:
    """The shard after one more of the given weight: the new one if its score is higher, else the old one."""
    key = F.coalesce(key.cast("string"), F.lit("\0null"))
    new = F.ln(_score(key, F.lit(shards), seed)) / F.lit(float(weight))
    return F.when(new > best["score"], F.lit(shards)).otherwise(best["shard"]).cast("int")


def with_slots(frame: DataFrame, shard: str, order: Sequence[str], out: str = "slot", rows: int | None = None) -> DataFrame:
    """Number each shard's rows from 0 without gaps, in the order of (hash bucket, ``order``).

    A shard is cut into hash buckets of about SLOT_ROWS rows; each bucket is numbered on its
    own and starts after the buckets before it, so that no task holds a whole shard.  Rows
    equal in every order column may take each other's slots.
    """
    rows = frame.count() if rows is None else rows
    buckets = max(1, math.ceil(rows / SLOT_ROWS))  # even if one shard has all rows
    taken = {c.lower() for c in frame.columns}
    bucket, before = (free_name(x, taken) for x in ("bucket", "before"))
    cut = frame.withColumn(bucket, F.pmod(F.xxhash64(F.lit(7), *order), F.lit(buckets)).cast("int"))
    sizes = cut.groupBy(shard, bucket).agg(F.count(F.lit(1)).alias("n"))
    ahead = W.partitionBy(shard).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(F.col(shard).alias("at_shard"), F.col(bucket).alias("at_bucket"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias(before))
    numbered = cut.join(offsets, (cut[shard] == offsets["at_shard"]) & (cut[bucket] == offsets["at_bucket"])).drop("at_shard", "at_bucket")
    place = F.row_number().over(W.partitionBy(shard, bucket).orderBy(*[F.col(c).asc_nulls_first() for c in order]))
    return numbered.withColumn(out, (F.col(before) + place - 1).cast("long")).drop(bucket, before)


def shard_rows(frame: DataFrame, key: str = "doc_id", weights: Sequence[float] = (1.0,) * 40, seed: int = 0) -> DataFrame:
    """All rows of ``frame`` with ``shard`` and ``grown_shard`` (one more shard of weight 1) added.

    Columns of those names are replaced.  Null keys all go to one fixed shard; rows with
    equal keys share a shard, whatever their other columns; an empty table stays empty.
    """
    kept = frame.drop("shard", "grown_shard")
    name = free_name("__best", {c.lower() for c in kept.columns})
    best = F.col(name)
    return (
        kept.withColumn(name, rendezvous(F.col(key), weights, seed))
        .withColumn("shard", best["shard"])
        .withColumn("grown_shard", grown(best, F.col(key), len(weights), 1.0, seed))
        .drop(name)
    )


def op10_rendezvous_sharding(spark, sf_dir: str) -> DataFrame:
    """Documents over 40 equal shards by doc_id.  A null text has no bytes and the CRC-32 of no bytes, 0."""
    text = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"), F.lit("key").alias("law")
    )
    placed = with_slots(shard_rows(docs), "shard", ["doc_id", "text_crc32", "size"])
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
