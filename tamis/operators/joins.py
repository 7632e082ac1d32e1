"""Exact joins that a filter makes cheaper, and the plan that decides on one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.plans import catalog


def prefiltered_semi_join(df: DataFrame, small: DataFrame, key: str, small_key: str, f: catalog.Filter) -> DataFrame:
    """Exactly ``left_semi``: the filter takes most rows out before they are exchanged, the join decides."""
    keys = small.select(F.col(small_key).alias("__small")).where("__small is not null").distinct()
    return f.semi_join(df, key).join(keys, F.col(key) == F.col("__small"), "left_semi")


def prefiltered_anti_join(df: DataFrame, small: DataFrame, key: str, small_key: str, f: catalog.Filter) -> DataFrame:
    """Exactly ``left_anti``, in one pass: rows that are surely absent, and null keys, meet no key, and are spread where sides are exchanged."""
    keys = small.select(F.col(small_key).alias("__small")).where("__small is not null").distinct().withColumn("__zero", F.lit(0))
    maybe = F.coalesce("__maybe", F.lit(False))
    # the hash is reduced before anything is added: it may be the largest integer
    spread = F.pmod(F.pmod(F.hash(key), F.lit(1 << 16)) + F.spark_partition_id() * 31, F.lit(1 << 16)) + 1
    marked = f.might_contain(df, key, "__maybe").withColumn("__part", F.when(maybe, 0).otherwise(spread).cast("int"))
    return marked.join(keys, (F.col(key) == F.col("__small")) & (F.col("__part") == F.col("__zero")), "left_anti").drop("__maybe", "__part")


def prefiltered_join(df: DataFrame, build_side: DataFrame, key: str, build_key: str, f: catalog.Filter, how: str = "inner") -> DataFrame:
    """An inner join with the probe side filtered, or a left join whose build side is filtered by the keys of ``df``
    (``f`` is then a filter of those)."""
    if how == "inner":
        return f.semi_join(df, key).join(build_side, F.col(key) == F.col(build_key))
    if how == "left":
        return df.join(f.semi_join(build_side, build_key), F.col(key) == F.col(build_key), "left")
    raise ValueError("inner or left")


def optimize_semi_join(df: DataFrame, small: DataFrame, key: str, small_key: str, broadcast_keys: int = 1_000_000, filter_keys: int = 2_000_000_000) -> DataFrame:
    """A semi join by the size of its keys: broadcast when they are few, a blocked Bloom filter first
    while that stays moderate, a plain join beyond."""
    keys = small.select(F.col(small_key).alias("__small")).where("__small is not null").distinct()
    n = keys.count()
    if n <= broadcast_keys:
        return df.join(F.broadcast(keys), F.col(key) == F.col("__small"), "left_semi")
    if n <= filter_keys:
        return catalog.build("bloom", keys, "__small", "block32", n).semi_join(df, key).join(keys, F.col(key) == F.col("__small"), "left_semi")
    return df.join(keys, F.col(key) == F.col("__small"), "left_semi")


def first_seen(df: DataFrame, key: str, order: str) -> DataFrame:
    """Exact deduplication: the row of each key that is first by ``order``, by an aggregation with map-side combining."""
    rest = [c for c in df.columns if c not in (key, order)]
    first = df.groupBy(key).agg(F.min(F.struct(order, *rest)).alias("__first"))
    return first.select(*(F.col(key) if c == key else F.col(f"__first.{c}").alias(c) for c in df.columns))


def surely_new(df: DataFrame, key: str, seen: catalog.Filter) -> DataFrame:
    """Approximate deduplication against a filter of seen keys: rows that are new for sure."""
    return seen.anti_join(df, key)
