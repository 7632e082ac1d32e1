"""Counting Bloom filters: positions with sums, so that keys can be removed and filters merged.

A filter is a DataFrame (pos long, count long) of the non-zero counters.  Counters are
whole longs, so none carries into a neighbour.  Kinds: ``counting`` (double hashing over
all counters), ``succinct`` (positions of the classic Bloom filter) and ``blocked`` (all of
a key's counters in one line of 512); ``blocked_rank`` encodes the same counts otherwise and
is the same filter here.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.functions import hashing as H
from tamis.functions import sizing as S
from tamis.operators.bloom import BROADCAST_BYTES
from tamis.operators.sharded import importable


@dataclass(frozen=True)
class CountingSpec:
    kind: str
    n: int
    counters: int
    probes: int
    bytes: int
    seed: int = 0

    @property
    def bits_per_item(self) -> float:
        return 8 * self.bytes / self.n


def spec(kind: str, n: int, bits_per_key: int = 10, seed: int = 0) -> CountingSpec:
    n, probes = max(n, 1), S.bloom_probes(bits_per_key)
    if kind == "counting":
        words = max(1, S.counting_words(n, bits_per_key))
        return CountingSpec(kind, n, words * 16, probes, words * 8, seed)
    if kind == "succinct":
        return CountingSpec(kind, n, S.bloom_words(n, bits_per_key) * 64, probes, S.succinct_bytes(n, bits_per_key), seed)
    if kind in ("blocked", "blocked_rank"):
        return CountingSpec(kind, n, max(1, n * bits_per_key // 512) * 512, probes, S.succinct_blocked_bytes(n, bits_per_key), seed)
    raise ValueError(f"unknown kind {kind}")


def _with_positions(df: DataFrame, s: CountingSpec) -> tuple[DataFrame, list[Column]]:
    """``df`` (with __h) with helper columns, and the position of each probe."""
    m, h, names = lambda x: F.lit(x).cast("long"), F.col("__h"), [f"__x{i}" for i in range(s.probes)]
    if s.kind == "counting":
        df = df.withColumns({x: H.low32(H.ushr(h, 32) + H.low32(h) * i) for i, x in enumerate(names)})
        return df, [H.reduce32(F.col(x), s.counters // 16) * 16 + F.col(x).bitwiseAND(m(15)) for x in names]
    if s.kind == "succinct":
        df = H.with_multiples(df.withColumn("__a", H.rotl64(h, 32)), "__a", "__h", names).drop("__a")
        return df, [H.fastrange64(F.col(x), s.counters // 64) * 64 + F.col(x).bitwiseAND(m(63)) for x in names]
    line = {"__line": H.reduce32(H.ushr(h, 32), s.counters // 512) * 512, "__a": h.bitwiseAND(m(0xFFFF)), "__b": H.ushr(h, 16).bitwiseAND(m(0xFFFF)).bitwiseOR(m(1))}
    return df.withColumns(line), [F.col("__line") + (F.col("__a") + F.col("__b") * i).bitwiseAND(m(511)) for i in range(s.probes)]


def _weighted(keys: DataFrame, key: str, s: CountingSpec, weight: Column) -> DataFrame:
    rows = H.murmur64(keys.select(F.col(key).alias("__key"), weight.cast("long").alias("__weight")).where("__key is not null"), "__key", "__h", s.seed)
    # equal keys are summed before their positions are written out
    rows = rows.groupBy("__h").agg(F.sum("__weight").alias("__weight"))
    rows, at = _with_positions(rows, s)
    return rows.select("__weight", F.explode(F.array(*at)).alias("pos")).withColumn("pos", H.never_null(F.col("pos")))


def build(keys: DataFrame, key: str, s: CountingSpec, weight: Column | None = None) -> DataFrame:
    """Counters of the non-null keys, each added ``weight`` times (once; a negative weight removes)."""
    weighted = _weighted(keys, key, s, F.lit(1) if weight is None else weight)
    return weighted.groupBy("pos").agg(F.sum("__weight").alias("count")).where("count <> 0")


def merge(*filters: DataFrame) -> DataFrame:
    every = filters[0]
    for f in filters[1:]:
        every = every.unionByName(f)
    return every.groupBy("pos").agg(F.sum("count").alias("count")).where("count <> 0")


def add(f: DataFrame, keys: DataFrame, key: str, s: CountingSpec) -> DataFrame:
    return merge(f, build(keys, key, s))


def remove(f: DataFrame, keys: DataFrame, key: str, s: CountingSpec) -> DataFrame:
    """Takes keys that were added out again; removing others breaks the filter, as with any of its kind."""
    return merge(f, build(keys, key, s, F.lit(-1)))


def np_positions(h: np.ndarray, s: CountingSpec) -> Iterator[np.ndarray]:
    """The position of each probe, as ``_with_positions``."""
    m, low, high = np.uint64(H.MASK32), h & np.uint64(H.MASK32), h >> np.uint64(32)
    line = H.np_reduce32(high, s.counters // 512) * 512
    for i in range(s.probes):
        if s.kind == "counting":
            x = high + low * np.uint64(i) & m
            yield H.np_reduce32(x, s.counters // 16) * 16 + (x & np.uint64(15)).astype(np.int64)
        elif s.kind == "succinct":
            x = H.np_rotl64(h, 32) + h * np.uint64(i)
            yield H.np_fastrange64(x, s.counters // 64) * 64 + (x & np.uint64(63)).astype(np.int64)
        else:
            a, b = h & np.uint64(0xFFFF), h >> np.uint64(16) & np.uint64(0xFFFF) | np.uint64(1)
            yield line + (a + b * np.uint64(i) & np.uint64(511)).astype(np.int64)


def _read(f: DataFrame, s: CountingSpec) -> Callable[[Column], Column]:
    """Reads counters, of a checked size, that are sent to all tasks: no exchange."""
    importable(f.sparkSession)
    told, full = f.select("pos", "count").toPandas(), np.zeros(s.counters, np.int64)
    full[told["pos"].to_numpy(np.int64)] = told["count"].to_numpy(np.int64)
    sent = f.sparkSession.sparkContext.broadcast(full)

    @F.pandas_udf("long")
    def least(keys: pd.Series) -> pd.Series:
        there = keys.notna()
        h = H.np_murmur64(keys[there].to_numpy(np.int64), s.seed)
        found = np.full(len(h), np.iinfo(np.int64).max)
        for at in np_positions(h, s):
            np.minimum(found, sent.value[at], out=found)
        return pd.Series(found, index=keys.index[there]).reindex(keys.index).astype("Int64")

    return least


def read_count(df: DataFrame, key: str, f: DataFrame, s: CountingSpec, out: str = "estimate", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with ``out``: the least of a key's counters, never less than how often it was added; null for null."""
    if 16 * s.counters <= broadcast_bytes:
        return df.withColumn(out, _read(f, s)(F.col(key).cast("long")))
    h = H.murmur64(df, key, "__h", s.seed)
    distinct, at = _with_positions(h.where(f"`{key}` is not null").select(H.never_null(F.col("__h")).alias("__h")).distinct(), s)
    each = distinct.select(F.col("__h").alias("__k"), F.explode(F.array(*at)).alias("__p"))
    side = f.select(F.col("pos").alias("__pos"), F.col("count").alias("__count"))
    least = each.join(side, F.col("__p") == F.col("__pos"), "left").groupBy("__k").agg(F.min(F.coalesce("__count", F.lit(0))).alias("__least"))
    h = h.withColumn("__h", H.never_null(F.col("__h")))
    return h.join(least, F.col("__h") == F.col("__k"), "left").select(*(df[c] for c in df.columns), F.when(df[key].isNotNull(), F.col("__least")).alias(out))


def might_contain(df: DataFrame, key: str, f: DataFrame, s: CountingSpec, out: str = "maybe") -> DataFrame:
    return read_count(df, key, f, s, "__estimate").withColumn(out, F.col("__estimate") > 0).drop("__estimate")
