"""Golomb-coded sets and prefix filters: order-independent contents, so native window plans.

A Golomb-coded set keeps the sorted distinct values ``bucket * 2^f + fingerprint``; chunks
of buckets are sorted and coded each for itself, so no window spans all rows.  A prefix
filter keeps in each bin the 25 smallest (quotient, remainder) codes; what is over goes to
a spare filter, which is asked only for codes beyond the largest of a bin that overflowed.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tamis.functions import hashing as H
from tamis.functions import sizing as S
from tamis.operators.bloom import BROADCAST_BYTES

#: Buckets of 16 keys that are coded together.
CHUNK_BUCKETS = 1024


@dataclass(frozen=True)
class GcsSpec:
    n: int
    buckets: int
    bits: int = 8
    seed: int = 0

    @property
    def fingerprint_bits(self) -> int:
        return self.bits + 4

    @property
    def shift(self) -> int:
        """Low bits of a delta that are written plainly."""
        return self.bits - 1


def gcs_spec(n: int, bits: int = 8, seed: int = 0) -> GcsSpec:
    return GcsSpec(n, S.gcs_buckets(n), bits, seed)


def gcs_value(h: Column, s: GcsSpec) -> Column:
    bucket = H.reduce32(H.ushr(h, 32), s.buckets)
    return F.shiftleft(bucket, s.fingerprint_bits).bitwiseOR(h.bitwiseAND(F.lit((1 << s.fingerprint_bits) - 1).cast("long")))


def gcs_build(keys: DataFrame, key: str, s: GcsSpec) -> DataFrame:
    """(chunk, value, delta, code_bits): sorted distinct values in chunks, deltas and their code lengths."""
    h = H.murmur64(keys.select(F.col(key).alias("__key")).where("__key is not null"), "__key", "__h", s.seed)
    values = h.select(H.never_null(gcs_value(F.col("__h"), s)).alias("value")).distinct()
    span = CHUNK_BUCKETS << s.fingerprint_bits
    chunked = values.withColumn("chunk", F.floor(F.col("value") / span).cast("long"))
    before = F.lag("value").over(W.partitionBy("chunk").orderBy("value"))
    delta = F.col("value") - F.coalesce(before, F.col("chunk") * span)
    return chunked.select("chunk", "value", delta.alias("delta")).withColumn("code_bits", H.ushr(F.col("delta"), s.shift) + 1 + s.shift)


def gcs_might_contain(df: DataFrame, key: str, f: DataFrame, s: GcsSpec, out: str = "maybe", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    side = f.select(F.col("value").alias("__value"), F.lit(True).alias("__hit"))
    side = F.broadcast(side) if 16 * s.n <= broadcast_bytes else side
    h = H.murmur64(df, key, "__h", s.seed).withColumn("__v", gcs_value(F.col("__h"), s))
    return h.join(side, F.col("__v") == F.col("__value"), "left").select(*(df[c] for c in df.columns), F.when(df[key].isNotNull(), F.coalesce("__hit", F.lit(False))).alias(out))


def rice_encode(deltas: np.ndarray, shift: int) -> bytes:
    """Golomb-Rice codes: the quotient in unary (ones, then a zero), then ``shift`` low bits."""
    high = (deltas >> shift).astype(np.int64)
    ends = np.cumsum(high + 1 + shift)
    bits = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    starts = ends - (high + 1 + shift)
    fill = np.repeat(starts, high) + (np.arange(high.sum()) - np.repeat(np.cumsum(high) - high, high))
    bits[fill] = 1
    for k in range(shift):
        bits[starts + high + 1 + k] = deltas >> (shift - 1 - k) & 1
    return np.packbits(bits).tobytes()


def rice_decode(data: bytes, count: int, shift: int) -> np.ndarray:
    bits, at, out = np.unpackbits(np.frombuffer(data, np.uint8)), 0, np.zeros(count, np.int64)
    zeros = np.flatnonzero(bits == 0)
    for i in range(count):
        end = int(zeros[np.searchsorted(zeros, at)])
        low = 0
        for b in bits[end + 1 : end + 1 + shift]:
            low = low << 1 | int(b)
        out[i] = (end - at) << shift | low
        at = end + 1 + shift
    return out


def gcs_encode(f: DataFrame, s: GcsSpec) -> DataFrame:
    """(chunk, n, payload): the stored form, a row for each chunk of about 16 thousand keys."""

    def encode(rows: pd.DataFrame) -> pd.DataFrame:
        d = rows.sort_values("value")["delta"].to_numpy(np.int64)
        return pd.DataFrame({"chunk": [rows["chunk"].iloc[0]], "n": [len(d)], "payload": [rice_encode(d, s.shift)]})

    return f.groupBy("chunk").applyInPandas(encode, "chunk long, n long, payload binary")


@dataclass(frozen=True)
class PrefixSpec:
    n: int
    bins: int
    seed: int = 0

    #: Quotients times remainders of a bin's dictionary, and its places.
    codes: int = 25 * 256
    places: int = 25


def prefix_spec(n: int, seed: int = 0) -> PrefixSpec:
    return PrefixSpec(n, S.prefix_bins(max(n, 1)), seed)


def prefix_codes(h: Column, s: PrefixSpec) -> tuple[Column, Column]:
    """Bin, and the code in it: quotient * 256 + remainder."""
    return H.reduce32(H.ushr(h, 32), s.bins), H.reduce32(H.low32(h), s.codes)


def prefix_build(keys: DataFrame, key: str, s: PrefixSpec) -> tuple[DataFrame, DataFrame]:
    """The first level (bin, codes, overflow, largest) and the overflowing keys (key), for the spare.

    A bin's keys are hash-uniform and distinct, so a window over a bin is small."""
    h = H.murmur64(keys.select(F.col(key).cast("long").alias("key")).where("key is not null").distinct(), "key", "__h", s.seed)
    bin_, code = prefix_codes(F.col("__h"), s)
    ranked = h.select("key", H.never_null(bin_).alias("bin"), code.alias("code")).withColumn("__r", F.row_number().over(W.partitionBy("bin").orderBy("code", "key")))
    first = ranked.groupBy("bin").agg(
        F.array_sort(F.collect_list(F.when(F.col("__r") <= s.places, F.col("code")))).alias("codes"),
        (F.max("__r") > s.places).alias("overflow"),
        F.max(F.when(F.col("__r") <= s.places, F.col("code"))).alias("largest"),
    )
    return first, ranked.where(F.col("__r") > s.places).select("key")


def prefix_overflow(s: PrefixSpec) -> int:
    """Keys that a filter of ``s.n`` keys hands to its spare, with room for chance: a bin's keys follow the Poisson law."""
    load = s.n / s.bins
    chance, over = math.exp(-load), 0.0
    for k in range(1, 4 * s.places + int(4 * load)):
        chance *= load / k
        over += max(0, k - s.places) * chance
    return math.ceil(s.bins * over * 1.1 + 64)


def prefix_add(first: DataFrame, keys: DataFrame, key: str, s: PrefixSpec) -> tuple[DataFrame, DataFrame]:
    """The first level with more keys, and those that overflow. ``largest`` becomes the least code that the spare is asked for."""
    h = H.murmur64(keys.select(F.col(key).cast("long").alias("key")).where("key is not null").distinct(), "key", "__h", s.seed)
    bin_, code = prefix_codes(F.col("__h"), s)
    new = h.select(H.never_null(F.col("key")).alias("key"), H.never_null(bin_).alias("bin"), H.never_null(code).alias("code")).join(first.select("bin", F.col("codes").alias("held")), "bin", "left")
    new = new.where(~F.coalesce(F.array_contains("held", F.col("code")), F.lit(False)))
    fits = F.row_number().over(W.partitionBy("bin").orderBy("code", "key")) + F.coalesce(F.size("held"), F.lit(0)) <= s.places
    ranked = new.withColumn("fits", fits)
    change = ranked.groupBy("bin").agg(F.collect_list(F.when(F.col("fits"), F.col("code"))).alias("more"), F.min(F.when(~F.col("fits"), F.col("code"))).alias("least"))
    none = F.array().cast(first.schema["codes"].dataType)
    codes = F.array_sort(F.concat(F.coalesce("codes", none), F.coalesce(F.col("more").cast(first.schema["codes"].dataType), none)))
    over = F.coalesce("overflow", F.lit(False))
    asked = F.when(over | F.col("least").isNotNull(), F.least(F.when(over, F.col("largest")), F.col("least"))).otherwise(F.array_max(codes))
    joined = first.join(change, "bin", "full").select(H.never_null(F.col("bin")).alias("bin"), codes.alias("codes"), (over | F.col("least").isNotNull()).alias("overflow"), asked.alias("largest"))
    return joined, ranked.where(~F.col("fits")).select("key")


def prefix_might_contain(df: DataFrame, key: str, first: DataFrame, s: PrefixSpec, spare: Callable[[DataFrame, str, str], DataFrame], out: str = "maybe", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``spare(df, key, out)`` adds the spare filter's answer."""
    side = first.select(F.col("bin").alias("__bin"), F.col("codes").alias("__codes"), F.col("overflow").alias("__over"), F.col("largest").alias("__top"))
    side = F.broadcast(side) if 256 * s.bins <= broadcast_bytes else side
    h = H.murmur64(spare(df, key, "__spare"), key, "__h", s.seed)
    bin_, code = prefix_codes(F.col("__h"), s)
    joined = h.withColumn("__b", bin_).withColumn("__c", code).join(side, F.col("__b") == F.col("__bin"), "left")
    # a code equal to the largest may have been the first one to overflow
    hit = F.coalesce(F.array_contains("__codes", F.col("__c")), F.lit(False)) | (F.coalesce(F.col("__over") & (F.col("__c") >= F.col("__top")), F.lit(False)) & F.col("__spare"))
    return joined.select(*(df[c] for c in df.columns), F.when(df[key].isNotNull(), hit).alias(out))
