"""Filters over streams: maintained in batches, kept by window, or held as state.

Mergeable kinds (OR and sums) are maintained with ``foreachBatch``: each batch is built on
its own and merged into a versioned table, one version a batch, so that a batch that runs
twice after a failure writes the same version again.  First-seen filtering holds a Bloom
filter in the state of each key shard.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tamis.functions import hashing as H
from tamis.functions import sizing as S
from tamis.operators import bloom, counting
from tamis.operators.sharded import importable

#: Versions of a maintained filter that stay readable.
KEEP_VERSIONS = 2


def _exists(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, at, fs.exists(at)


def versions(spark: SparkSession, path: str) -> list[int]:
    """Complete versions, ascending."""
    fs, at, there = _exists(spark, path)
    if not there:
        return []
    names = [x.getPath().getName() for x in fs.listStatus(at)]
    return sorted(int(n[2:]) for n in names if n.startswith("v=") and _exists(spark, f"{path}/{n}/_SUCCESS")[2])


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest version of a maintained filter."""
    found = versions(spark, path)
    return spark.read.parquet(f"{path}/v={found[-1]}") if found else None


def merging(path: str, build: Callable[[DataFrame], DataFrame], merge: Callable[..., DataFrame]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that merges each batch's filter into the table at ``path``."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = [v for v in versions(spark, path) if v < number]
        made = build(batch)
        if before:
            made = merge(spark.read.parquet(f"{path}/v={before[-1]}"), made)
        made.write.mode("overwrite").parquet(f"{path}/v={number}")
        for old in before[:-KEEP_VERSIONS]:
            fs, at, _ = _exists(spark, f"{path}/v={old}")
            fs.delete(at, True)

    return run


def maintain_bloom(stream: DataFrame, key: str, s: bloom.BloomSpec, path: str, checkpoint: str):
    """A writer, not yet started, that keeps a Bloom filter of all keys seen."""
    return stream.writeStream.foreachBatch(merging(path, lambda b: bloom.build(b, key, s), bloom.merge)).option("checkpointLocation", checkpoint)


def maintain_counting(stream: DataFrame, key: str, s: counting.CountingSpec, path: str, checkpoint: str, weight: str | None = None):
    """A writer that keeps counters; ``weight`` is a column of +1 (add) and -1 (remove)."""
    w = F.col(weight) if weight else None
    return stream.writeStream.foreachBatch(merging(path, lambda b: counting.build(b, key, s, w), counting.merge)).option("checkpointLocation", checkpoint)


def windowed_bloom(stream: DataFrame, time: str, key: str, s: bloom.BloomSpec, window: str, late: str) -> DataFrame:
    """A filter for each event-time window: (window, block, words); rows later than ``late`` are dropped.

    Only kinds with one block a key."""
    if s.kind in ("classic", "legacy"):
        raise ValueError("use a kind with one block a key")
    h = H.murmur64(stream.withWatermark(time, late), key, "__h", s.seed)
    rows = h.where(F.col(key).isNotNull()).select(F.window(time, window).alias("window"), bloom._block(F.col("__h"), s).alias("block"), *(m.alias(w) for w, m in zip(s.words, bloom._lanes(F.col("__h"), s), strict=True)))
    return rows.groupBy("window", "block").agg(*(F.bit_or(w).alias(w) for w in s.words))


def first_seen(stream: DataFrame, key: str, shards: int = 64, keys_per_shard: int = 100_000, bits_per_key: int = 16, idle: str | None = None) -> DataFrame:
    """Rows of a stream whose key was surely not seen before; a few new keys are lost at the filter's rate.

    Each shard's state is one Bloom filter of fixed size, however many keys pass; it is
    forgotten when nothing came for ``idle`` (a processing time), if that is told."""
    importable(stream.sparkSession)
    words, probes, columns = S.bloom_words(keys_per_shard, bits_per_key), S.bloom_probes(bits_per_key), stream.columns
    at = columns.index(key)

    def places(keys: np.ndarray) -> np.ndarray:
        h = H.np_murmur64(keys)
        a = H.np_rotl64(h, 32)
        x = a[:, None] + h[:, None] * np.arange(probes, dtype=np.uint64)[None, :]
        return H.np_fastrange64(x, words) * 64 + (x & np.uint64(63)).astype(np.int64)

    def run(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        bits = np.frombuffer(state.get[0], np.uint8).copy() if state.exists else np.zeros(words * 8, np.uint8)
        for rows in batches:
            rows = rows[columns]
            rows = rows[rows[key].notna()].drop_duplicates(key)
            p = places(rows.iloc[:, at].to_numpy(np.int64))
            old = ((bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1).all(1) if len(rows) else np.zeros(0, bool)
            np.bitwise_or.at(bits, (p >> 3).ravel(), (1 << (p & 7)).astype(np.uint8).ravel())
            yield rows[~old]
        state.update((bits.tobytes(),))
        if idle:
            state.setTimeoutDuration(idle)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    sharded_rows = stream.withColumn("__shard", F.pmod(F.xxhash64(key), F.lit(shards)).cast("int"))
    return sharded_rows.groupBy("__shard").applyInPandasWithState(run, stream.schema, "bits binary", "append", timeout)
