"""Sharded filters: keys are hashed to shards, and each shard is one kernel's filter.

A filter is a DataFrame, a row for each shard: (kind, shard, shards, n, seed, attempts,
bytes, params, payload).  It is stored, read and united like any table.  Building is one
exchange of the distinct keys by shard; a shard holds about ``SHARD_KEYS`` keys however many
there are in all, since shards are drawn by a hash and duplicates go first.

Probing broadcasts the payloads when their measured size is at most ``BROADCAST_BYTES``;
beyond it, distinct keys and payloads meet shard by shard.
"""

from __future__ import annotations

import json
import math
import os
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.functions import hashing as H
from tamis.operators import kernels as K

SHARD_KEYS = 65_536
#: Seed of the hash that draws shards; the kernels' seeds are others.
SHARD_SEED = 0x5AD
BROADCAST_BYTES = 64 << 20
#: Distinct probe keys of a group when payloads are not broadcast.
PROBE_KEYS = 500_000
SCHEMA = "kind string, shard int, shards int, n long, seed long, attempts int, bytes long, params string, payload binary"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
ROOT = str(Path(__file__).resolve().parents[2])


def importable(spark: SparkSession) -> None:
    """Lets the workers import this package from where the driver has it."""
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return H.np_fastrange64(H.np_murmur64(keys, SHARD_SEED), shards)


def _with_shard(keys: DataFrame, key: str, shards: int) -> DataFrame:
    h = H.murmur64(keys, key, "__s", SHARD_SEED)
    return h.withColumn("shard", H.fastrange64(F.col("__s"), shards).cast("int")).drop("__s")


def as_key(df: DataFrame, *columns: str, out: str = "key") -> DataFrame:
    """A 64-bit key of columns of any type; null where all are null."""
    some = F.coalesce(*(F.col(c).isNotNull().cast("int") for c in columns)) if len(columns) == 1 else F.greatest(*(F.col(c).isNotNull().cast("int") for c in columns))
    return df.withColumn(out, F.when(some == 1, F.xxhash64(*columns)))


def build(keys: DataFrame, key: str, kind: str, params: dict | None = None, seed: int = 0, shard_keys: int = SHARD_KEYS, values: str | None = None, n: int | None = None) -> DataFrame:
    """The filter of the distinct non-null keys; with ``values`` a static function of each key's smallest value.

    ``n`` reserves room for so many keys in all: dynamic kinds then take more keys by ``add``.
    """
    spark = keys.sparkSession
    importable(spark)
    params, told = dict(params or {}), json.dumps(params or {}, sort_keys=True)
    rows = keys.select(F.col(key).cast("long").alias("key"), *([F.col(values).cast("long").alias("value")] if values else [])).where("key is not null")
    distinct = rows.groupBy("key").agg(F.min("value").alias("value")) if values else rows.distinct()
    reserved = n is not None and kind in K.GROWS
    n = n if reserved else distinct.count()
    shards = max(1, math.ceil(n / shard_keys))
    if reserved:  # the keys of a shard vary by the root of their number
        params["capacity"] = math.ceil(n / shards + (4 * math.sqrt(n / shards) if shards > 1 else 0))

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        shard, rows = int(rows["shard"].iloc[0]), rows[rows["key"].notna()]
        more = {"values": rows["value"].to_numpy(np.int64)} if values else {}
        payload, used, attempts = K.build(kind, rows["key"].astype("int64").to_numpy(), seed, params, **more)
        return pd.DataFrame([(kind, shard, shards, len(rows), used, attempts, K.KERNELS[kind].bytes(payload), told, payload)], columns=COLUMNS)

    placed = _with_shard(distinct, "key", shards)
    if reserved:  # shards without a key yet are there too
        placed = placed.unionByName(spark.range(shards).select(F.lit(None).cast("long").alias("key"), F.col("id").cast("int").alias("shard")))
        # keys travel beside nulls as text: as doubles they would lose digits
        placed = placed.withColumn("key", F.col("key").cast("string"))
    return placed.groupBy("shard").applyInPandas(one, SCHEMA)


def _contains(kind: str, parts: dict[int, tuple[int, bytes]], shards: int, keys: np.ndarray) -> np.ndarray:
    found, of = np.zeros(len(keys), bool), shard_of(keys, shards)
    for shard in np.unique(of).tolist():
        if shard in parts:
            here = of == shard
            seed, payload = parts[shard]
            found[here] = K.KERNELS[kind].contains(payload, H.np_murmur64(keys[here], seed))
    return found


def size_bytes(f: DataFrame) -> int:
    """Bytes of all payloads as they are stored."""
    return f.agg(F.coalesce(F.sum(F.octet_length("payload")), F.lit(0))).first()[0]


@contextmanager
def _kept(f: DataFrame) -> Iterator[DataFrame]:
    """``f`` cached for some actions; a filter that its owner has cached is left as it is."""
    own = f.storageLevel == StorageLevel.NONE
    if own:
        f.persist()
    try:
        yield f
    finally:
        if own:
            f.unpersist()


def _sent(f: DataFrame, limit: int) -> list | None:
    """The rows of a filter of up to ``limit`` bytes."""
    with _kept(f):
        return f.select("kind", "shard", "shards", "seed", "payload").collect() if size_bytes(f) <= limit else None


def might_contain(df: DataFrame, key: str, f: DataFrame, out: str = "maybe", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with the boolean ``out``: false where the key was surely not added; null for a null key.

    A filter that is too large to broadcast is read when the result is; write or cache it first.
    """
    spark = df.sparkSession
    importable(spark)
    rows = _sent(f, broadcast_bytes)
    if rows is None:
        return _by_shard(df, key, f, out, "boolean", lambda kind, payload, h: K.KERNELS[kind].contains(payload, h), False)
    if not rows:
        return df.withColumn(out, F.when(F.col(key).isNotNull(), F.lit(False)))
    kind, shards = rows[0].kind, rows[0].shards
    sent = spark.sparkContext.broadcast({r.shard: (r.seed, bytes(r.payload)) for r in rows})

    @F.pandas_udf("boolean")
    def hit(keys: pd.Series) -> pd.Series:
        there = keys.notna()
        got = _contains(kind, sent.value, shards, keys[there].to_numpy(np.int64))
        return pd.Series(got, index=keys.index[there]).reindex(keys.index).astype("boolean")

    return df.withColumn(out, hit(F.col(key).cast("long")))


def _by_shard(df: DataFrame, key: str, f: DataFrame, out: str, kind_of: str, ask: Callable[[str, bytes, np.ndarray], np.ndarray], absent: object) -> DataFrame:
    """Distinct keys and payloads meet shard by shard; ``absent`` is what a key of a missing shard gets."""
    with _kept(f):
        shards = f.agg(F.max("shards")).first()[0] or 1
    keys = df.select(F.col(key).cast("long").alias("__key")).where("__key is not null").distinct()
    parts = max(1, math.ceil(keys.count() / shards / PROBE_KEYS))
    probes = _with_shard(keys, "__key", shards).withColumn("part", F.pmod(F.xxhash64("__key"), F.lit(parts)).cast("int"))
    payloads = f.select("kind", "shard", "seed", "payload", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))

    def one(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"__key": a["__key"], "__hit": [absent] * len(a)})
        r = b.iloc[0]
        got = ask(r["kind"], r["payload"], H.np_murmur64(a["__key"].to_numpy(np.int64), int(r["seed"])))
        return pd.DataFrame({"__key": a["__key"], "__hit": got})

    found = probes.groupBy("shard", "part").cogroup(payloads.groupBy("shard", "part")).applyInPandas(one, f"__key long, __hit {kind_of}")
    return df.join(found, F.col(key).cast("long") == F.col("__key"), "left").select(*(df[c] for c in df.columns if c != out), F.col("__hit").alias(out))


def lookup(df: DataFrame, key: str, f: DataFrame, out: str = "value", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with the static function's value of each key; without meaning for keys not built in, null for a null key."""
    spark = df.sparkSession
    importable(spark)
    rows = _sent(f, broadcast_bytes)
    if rows is None:
        return _by_shard(df, key, f, out, "long", lambda _, payload, h: K.ribbon_values(payload, h), 0)
    shards = rows[0].shards if rows else 1
    sent = spark.sparkContext.broadcast({r.shard: (r.seed, bytes(r.payload)) for r in rows})

    @F.pandas_udf("long")
    def value(keys: pd.Series) -> pd.Series:
        there = keys.notna()
        k = keys[there].to_numpy(np.int64)
        got, of = np.zeros(len(k), np.int64), shard_of(k, shards)
        for shard in np.unique(of).tolist():
            if shard in sent.value:
                seed, payload = sent.value[shard]
                got[of == shard] = K.ribbon_values(payload, H.np_murmur64(k[of == shard], seed))
        return pd.Series(got, index=keys.index[there]).reindex(keys.index).astype("Int64")

    return df.withColumn(out, value(F.col(key).cast("long")))


FULL = "not enough space"


def _update(f: DataFrame, keys: DataFrame, key: str, change: str, attempt: bool = False) -> DataFrame:
    """The filter after a change by the distinct keys; an attempt has a column ``status``, and leaves full shards as they were."""
    importable(f.sparkSession)
    with _kept(f):
        shards = f.agg(F.max("shards")).first()[0]
    rows = _with_shard(keys.select(F.col(key).cast("long").alias("key")).where("key is not null").distinct(), "key", shards)
    sign = 1 if change == "add" else -1

    def one(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a):
            raise ValueError("a shard of the filter is missing; build it with these keys, or reserve it by n")
        r, status = a.iloc[0].copy(), "ok"
        if len(b):
            kernel = K.KERNELS[r["kind"]]
            function = kernel.add if change == "add" else kernel.remove
            if function is None:
                raise ValueError(f"{r['kind']} cannot {change}")
            try:
                payload = function(r["payload"], np.sort(H.np_murmur64(b["key"].to_numpy(np.int64), int(r["seed"]))))
                r["payload"], r["n"], r["bytes"] = payload, r["n"] + sign * len(b), kernel.bytes(payload)
            except K.BuildFailed:
                if not attempt:
                    raise RuntimeError(FULL) from None
                status = FULL
        out = pd.DataFrame([r], columns=COLUMNS)
        return out.assign(status=status) if attempt else out

    return f.select(*COLUMNS).groupBy("shard").cogroup(rows.groupBy("shard")).applyInPandas(one, SCHEMA + ", status string" * attempt)


def add(f: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The filter with more distinct keys; dynamic kinds only. Raises when a shard is full."""
    return _update(f, keys, key, "add")


def add_attempt(f: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """As ``add``, with each shard's ``status``: "ok", or "not enough space" where none of its keys was added."""
    return _update(f, keys, key, "add", True)


def remove(f: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The filter without distinct keys that were added; dynamic kinds only."""
    return _update(f, keys, key, "remove")


def stats(f: DataFrame) -> DataFrame:
    """One row: keys, shards, bytes by the kind's layout, bits an item and attempts."""
    bits: Column = F.col("bytes") * 8 / F.col("n")
    return f.agg(F.max("kind").alias("kind"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("shards"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.max("attempts").alias("attempts")).withColumn("bits_per_item", bits)
