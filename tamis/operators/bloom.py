"""Bloom filters as aggregations: a filter is the bitwise OR of its keys' words.

Every kind maps a key's hash to a block and to masks of that block's lanes; building is
``groupBy(block).agg(bit_or(lane)...)``, with map-side combining, and union of two filters
is the same aggregation over both.  A filter is a DataFrame (block long, w0..wL-1 long) with
a ``BloomSpec``; empty blocks are absent.

Probing a filter whose words fit ``BROADCAST_BYTES`` takes no exchange: kinds with one block
a key join it by broadcast, and the classic kinds, which spread a key over all words, look
their words up in the array of them.  Beyond that both sides are exchanged by block, and
the classic kinds' probes are grouped again by key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.functions import hashing as H
from tamis.functions import sizing as S
from tamis.operators.sharded import importable

#: Filters up to this size (computed from the spec, not guessed) are broadcast.
BROADCAST_BYTES = 64 << 20
#: Multipliers of the register-blocked kinds' lanes.
SALTS = (0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31)
#: Fixed value: the multiplier that remixes the hash inside a line.
GOLDEN32 = 0x9E3779B9


@dataclass(frozen=True)
class BloomSpec:
    """kind: classic, simple, simple_upper, block32, block32_pow2, block64, lanes16, bytes16, line, legacy or legacy_line."""

    kind: str
    n: int
    blocks: int
    bits_per_key: int = 10
    probes: int = 1
    seed: int = 0

    @property
    def lanes(self) -> int:
        return {"block32": 8, "block32_pow2": 8, "block64": 8, "lanes16": 8, "bytes16": 16, "line": 8, "legacy_line": 8}.get(self.kind, 1)

    @property
    def lane_bits(self) -> int:
        return {"block32": 32, "block32_pow2": 32, "lanes16": 16, "bytes16": 8}.get(self.kind, 64)

    @property
    def bytes(self) -> int:
        return self.blocks * self.lanes * self.lane_bits // 8

    @property
    def bits_per_item(self) -> float:
        return 8 * self.bytes / self.n if self.n else float("nan")

    @property
    def words(self) -> list[str]:
        return [f"w{i}" for i in range(self.lanes)]

    def info(self) -> dict:
        return {"kind": self.kind, "n": self.n, "blocks": self.blocks, "probes": self.probes, "bytes": self.bytes, "bits_per_item": self.bits_per_item}


def spec(kind: str, n: int, bits_per_key: int = 10, seed: int = 0) -> BloomSpec:
    """The size of an empty filter for n keys."""
    n = max(n, 1)
    if kind == "classic":
        return BloomSpec(kind, n, max(1, S.bloom_words(n, bits_per_key)), bits_per_key, S.bloom_probes(bits_per_key), seed)
    if kind in ("simple", "simple_upper"):
        return BloomSpec(kind, n, S.simple_block_words(n), 10, 2, seed)
    if kind == "block32_pow2":
        return BloomSpec(kind, n, 1 << max(1, (n * bits_per_key).bit_length() - 8), bits_per_key, 8, seed)
    per = {"block32": 24, "block64": 50, "lanes16": 10, "bytes16": 10}
    if kind in per:
        return BloomSpec(kind, n, S.blocked_buckets(n, per[kind]), 10, 8, seed)
    if kind in ("line", "legacy_line"):
        return BloomSpec(kind, n, max(1, -(-n * bits_per_key // 512)), bits_per_key, S.local_probes(1000 * bits_per_key), seed)
    if kind == "legacy":
        return BloomSpec(kind, n, max(1, -(-n * bits_per_key // 64)), bits_per_key, S.bloom_probes(bits_per_key), seed)
    raise ValueError(f"unknown kind {kind}")


def _shl(bit: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), bit.cast("int"))


def _with_positions(df: DataFrame, s: BloomSpec) -> tuple[DataFrame, list[tuple[Column, Column]]]:
    """``df`` (with __h) with helper columns, and (word, bit) of each probe, for kinds that spread over the whole filter."""
    names = [f"__x{i}" for i in range(s.probes)]
    if s.kind == "classic":
        df = H.with_multiples(df.withColumn("__a", H.rotl64(F.col("__h"), 32)), "__a", "__h", names).drop("__a")
        return df, [(H.fastrange64(F.col(x), s.blocks), F.col(x).bitwiseAND(F.lit(63).cast("long"))) for x in names]
    # 32-bit double hashing modulo the number of bits
    low, high, bits = H.low32(F.col("__h")), H.ushr(F.col("__h"), 32), F.lit(s.blocks * 64).cast("long")
    df = df.withColumns({x: H.low32(low + high * i) % bits for i, x in enumerate(names)})
    return df, [(H.ushr(F.col(x), 6), F.col(x).bitwiseAND(F.lit(63).cast("long"))) for x in names]


def _block(h: Column, s: BloomSpec) -> Column:
    if s.kind == "simple":
        return H.fastrange64(H.rotl64(h, 32), s.blocks)
    if s.kind == "simple_upper":
        return H.fastrange64(h, s.blocks)
    if s.kind == "block32_pow2":
        return h.bitwiseAND(F.lit(s.blocks - 1).cast("long"))
    if s.kind in ("line", "legacy_line"):
        return H.reduce32(h, s.blocks)
    return H.reduce32(H.rotl64(h, 32), s.blocks)


def _lanes(h: Column, s: BloomSpec) -> list[Column]:
    """Masks of the lanes of a key's block."""
    if s.kind in ("simple", "simple_upper"):
        return [_shl(h.bitwiseAND(F.lit(63).cast("long"))).bitwiseOR(_shl(H.ushr(h, 8).bitwiseAND(F.lit(63).cast("long"))))]
    if s.kind in ("line", "legacy_line"):
        x, masks = H.low32(H.ushr(h, 32)), [F.lit(0).cast("long")] * 8
        step = H.ushr(x, 17).bitwiseOR(H.low32(F.shiftleft(x, 15)))
        for i in range(s.probes):
            # each probe takes nine bits of a remixed hash, or of a double hash in the older layout
            at = H.ushr(H.power_low(x, GOLDEN32, i + 1) if s.kind == "line" else H.low32(x + step * i), 23)
            masks = [m.bitwiseOR(F.when(H.ushr(at, 6) == lane, _shl(at.bitwiseAND(F.lit(63).cast("long")))).otherwise(F.lit(0).cast("long"))) for lane, m in enumerate(masks)]
        return masks
    x = H.low32(H.ushr(h, H.floor_log2(s.blocks)) if s.kind == "block32_pow2" else h)
    if s.kind == "bytes16":
        # sixteen lanes of a byte; a key sets one bit in each of the eight lanes of one half
        half = H.ushr(x, 31)
        out = []
        for i in range(16):
            bit = H.ushr(H.mul_low(x, SALTS[i % 8]), 29)
            out.append(F.when(half == i // 8, _shl(bit)).otherwise(F.lit(0).cast("long")))
        return out
    top = {"block32": 27, "block32_pow2": 27, "block64": 26, "lanes16": 28}[s.kind]
    return [_shl(H.ushr(H.mul_low(x, salt), top)) for salt in SALTS]


def hashed(keys: DataFrame, key: str, s: BloomSpec, out: str = "__h") -> DataFrame:
    return H.murmur64(keys, key, out, s.seed)


def build(keys: DataFrame, key: str, s: BloomSpec) -> DataFrame:
    """The words of a filter of the non-null ``key`` values; duplicates change nothing."""
    h = hashed(keys.select(F.col(key).alias("__key")).where("__key is not null"), "__key", s)
    if s.kind in ("classic", "legacy"):
        h, at = _with_positions(h, s)
        probes = F.array(*(F.struct(H.never_null(w).alias("block"), _shl(b).alias("w0")) for w, b in at))
        rows = h.select(F.explode(probes).alias("p")).select(H.never_null(F.col("p.block")).alias("block"), "p.w0")
    else:
        rows = h.select(H.never_null(_block(F.col("__h"), s)).alias("block"), *(m.alias(w) for w, m in zip(s.words, _lanes(F.col("__h"), s), strict=True)))
    return rows.groupBy("block").agg(*(F.bit_or(w).alias(w) for w in s.words))


def merge(first: DataFrame, *others: DataFrame) -> DataFrame:
    """The filter of all keys of filters with one spec."""
    every = reduce(DataFrame.unionByName, others, first)
    words = [c for c in first.columns if c != "block"]
    return every.groupBy("block").agg(*(F.bit_or(w).alias(w) for w in words))


def dense(words: DataFrame, s: BloomSpec) -> DataFrame:
    """With the empty blocks too."""
    blocks = words.sparkSession.range(s.blocks).select(F.col("id").alias("block"))
    return blocks.join(words, "block", "left").select("block", *(F.coalesce(w, F.lit(0).cast("long")).alias(w) for w in s.words))


def _side(words: DataFrame, s: BloomSpec, limit: int) -> DataFrame:
    side = words.select(F.col("block").alias("__block"), *(F.col(w).alias(f"__{w}") for w in s.words))
    # one row that no key meets: were the filter empty, the planner would drop the join and write
    # the whole derivation of a key's masks out as a filter on the scan
    none = words.sparkSession.range(1).select(F.lit(-1).cast("long").alias("__block"), *(F.lit(0).cast("long").alias(f"__{w}") for w in s.words))
    side = side.union(none)
    return F.broadcast(side) if s.bytes <= limit else side


def np_positions(h: np.ndarray, s: BloomSpec) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word, bit) of each probe, as ``_with_positions``."""
    for i in range(s.probes):
        if s.kind == "classic":
            x = H.np_rotl64(h, 32) + h * np.uint64(i)
            yield H.np_fastrange64(x, s.blocks), x & np.uint64(63)
        else:
            x = ((h & np.uint64(H.MASK32)) + (h >> np.uint64(32)) * np.uint64(i) & np.uint64(H.MASK32)) % np.uint64(s.blocks * 64)
            yield (x >> np.uint64(6)).astype(np.int64), x & np.uint64(63)


def _probe(words: DataFrame, s: BloomSpec) -> Callable[[Column], Column]:
    """A probe of a filter whose words, of a checked size, are sent to all tasks: no exchange."""
    importable(words.sparkSession)
    told, full = words.select("block", "w0").toPandas(), np.zeros(s.blocks, np.int64)
    full[told["block"].to_numpy(np.int64)] = told["w0"].to_numpy(np.int64)
    sent = words.sparkSession.sparkContext.broadcast(full.view(np.uint64))

    @F.pandas_udf("boolean")
    def hit(keys: pd.Series) -> pd.Series:
        there = keys.notna()
        h = H.np_murmur64(keys[there].to_numpy(np.int64), s.seed)
        found, alive = np.zeros(len(h), bool), np.arange(len(h))
        for word, bit in np_positions(h, s):  # keys leave at their first clear bit
            alive = alive[(sent.value[word[alive]] >> bit[alive] & np.uint64(1)).astype(bool)]
        found[alive] = True
        return pd.Series(found, index=keys.index[there]).reindex(keys.index).astype("boolean")

    return hit


def might_contain(df: DataFrame, key: str, words: DataFrame, s: BloomSpec, out: str = "maybe", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with the boolean ``out``: false where the key was surely not added; null for a null key."""
    h = hashed(df, key, s)
    side = _side(words, s, broadcast_bytes)
    if s.kind not in ("classic", "legacy"):
        h = h.withColumn("__b", _block(F.col("__h"), s))
        for w, m in zip(s.words, _lanes(F.col("__h"), s), strict=True):
            h = h.withColumn(f"__m{w}", m)
        tests = [F.coalesce(F.col(f"__{w}"), F.lit(0).cast("long")).bitwiseAND(F.col(f"__m{w}")) == F.col(f"__m{w}") for w in s.words]
        found = h.join(side, F.col("__b") == F.col("__block"), "left")
        hit = reduce(lambda a, b: a & b, tests)
        return found.select(*(df[c] for c in df.columns), F.when(df[key].isNotNull(), hit).alias(out))
    if s.bytes <= broadcast_bytes:
        return df.withColumn(out, _probe(words, s)(F.col(key).cast("long")))
    # distinct hashes, one row a probe, grouped back
    distinct, at = _with_positions(h.where(f"`{key}` is not null").select(H.never_null(F.col("__h")).alias("__h")).distinct(), s)
    probes = F.array(*(F.struct(w.alias("b"), _shl(b).alias("m")) for w, b in at))
    each = distinct.select(F.col("__h").alias("__k"), F.explode(probes).alias("p"))
    tested = each.join(side, F.col("p.b") == F.col("__block"), "left")
    hit = F.coalesce(F.col("__w0"), F.lit(0).cast("long")).bitwiseAND(F.col("p.m")) != 0
    verdict = tested.groupBy("__k").agg(F.bool_and(hit).alias("__hit"))
    h = h.withColumn("__h", H.never_null(F.col("__h")))
    return h.join(verdict, F.col("__h") == F.col("__k"), "left").select(*(df[c] for c in df.columns), F.when(df[key].isNotNull(), F.col("__hit")).alias(out))


def semi_join(df: DataFrame, key: str, words: DataFrame, s: BloomSpec) -> DataFrame:
    """Rows whose key may have been added."""
    return might_contain(df, key, words, s, "__maybe").where("__maybe").drop("__maybe")


def anti_join(df: DataFrame, key: str, words: DataFrame, s: BloomSpec) -> DataFrame:
    """Rows whose key was surely not added: each of them is right. Null keys are not among them."""
    return might_contain(df, key, words, s, "__maybe").where(~F.col("__maybe")).drop("__maybe")


def resized(s: BloomSpec, n: int) -> BloomSpec:
    return replace(spec(s.kind, n, s.bits_per_key, s.seed))
