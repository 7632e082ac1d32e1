"""Key generators, samples and mixes, as lazy DataFrames (key long)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.functions import hashing as H


def random_keys(spark: SparkSession, count: int, start: int = 0, seed: int = 0) -> DataFrame:
    """Mixed counters ``start .. start + count``: distinct, and the same on every run."""
    return H.murmur64(spark.range(start, start + count).toDF("__i"), "__i", "key", seed).select("key")


def rotated_keys(spark: SparkSession, count: int, rotation: int, start: int = 0) -> DataFrame:
    """Counters rotated left: sequential keys whose changing bits are anywhere in the word."""
    return spark.range(start, start + count).select(H.rotl64(F.col("id"), rotation).alias("key"))


def reversed_keys(spark: SparkSession, count: int, rotation: int, start: int = 0) -> DataFrame:
    """Rotated counters with their bits in reverse order."""
    return rotated_keys(spark, count, rotation, start).select(H.reverse_bits(F.col("key")).alias("key"))


def generate(spark: SparkSession, count: int, seed: int, start: int = 0) -> DataFrame:
    """The benchmark's choice: seeds 0 to 63 rotate, 64 to 127 reverse too, others mix."""
    if 0 <= seed < 64:
        return rotated_keys(spark, count, seed, start)
    return reversed_keys(spark, count, seed - 64, start) if seed < 128 else random_keys(spark, count, start, seed)


def sample(keys: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """k rows, every set of k as likely, the same for a seed: those with the smallest hashes (a top-k, so
    each task sends on k rows)."""
    hashed = H.murmur64(keys, "key", "__h", seed)
    return hashed.orderBy("__h", "key").limit(k).drop("__h")


def shuffled(keys: DataFrame, seed: int = 0) -> DataFrame:
    return H.murmur64(keys, "key", "__h", seed).orderBy("__h").drop("__h")


def mix(present: DataFrame, absent: DataFrame, count: int, hit_percent: int, seed: int = 0) -> DataFrame:
    """(key, hit_pct): ``count`` distinct probes of which that per cent are from ``present``."""
    hits = count * hit_percent // 100
    parts = [sample(present.distinct(), hits, seed), sample(absent.distinct().join(present, "key", "left_anti"), count - hits, seed + 1)]
    return parts[0].unionByName(parts[1]).withColumn("hit_pct", F.lit(hit_percent))


def probe_sets(present: DataFrame, absent: DataFrame, count: int, seed: int = 0) -> DataFrame:
    """The five mixes from 0 to 100 per cent."""
    out = mix(present, absent, count, 0, seed)
    for percent in (25, 50, 75, 100):
        out = out.unionByName(mix(present, absent, count, percent, seed))
    return out
