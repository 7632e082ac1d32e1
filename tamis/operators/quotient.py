"""Counting quotient filters: a multiset of (hash, value, count).

The slots' layout is an encoding; what a quotient filter answers is decided by the masked
hashes it holds, and those are rows here.  Every operation is an aggregation or a join on
(hash, value), with map-side combining where rows repeat.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tamis.functions import hashing as H
from tamis.functions import sizing as S

#: Status codes of operations.
OK, NO_SPACE, COULD_NOT_LOCK, DOES_NOT_EXIST = 0, -1, -2, -3
FULL = 0.95
KEY = ["hash", "value"]


@dataclass(frozen=True)
class QuotientSpec:
    """``mode``: default (masked mix), invertible (the whole mix, so answers are exact) or none (the key is the hash)."""

    quotient_bits: int
    remainder_bits: int = 8
    value_bits: int = 0
    mode: str = "default"
    seed: int = 0

    @property
    def slots(self) -> int:
        return 1 << self.quotient_bits

    @property
    def key_bits(self) -> int:
        return 64 if self.mode == "invertible" else self.quotient_bits + self.remainder_bits

    @property
    def bytes(self) -> int:
        """Remainders and values, 2.125 bits of metadata a slot."""
        return int(self.slots * (self.remainder_bits + self.value_bits + 2.125) / 8)


def spec(n: int, remainder_bits: int = 8, value_bits: int = 0, mode: str = "default", seed: int = 0) -> QuotientSpec:
    return QuotientSpec(S.quotient_bits(max(n, 1)), remainder_bits, value_bits, mode, seed)


def with_hash(df: DataFrame, key: str, s: QuotientSpec, out: str = "hash") -> DataFrame:
    if s.mode == "none":
        return df.withColumn(out, F.col(key).cast("long").bitwiseAND(H.lit64((1 << s.key_bits) - 1)))
    df = H.murmur64(df, key, out, s.seed)
    return df if s.mode == "invertible" else df.withColumn(out, F.col(out).bitwiseAND(F.lit((1 << s.key_bits) - 1).cast("long")))


def with_original_key(f: DataFrame, s: QuotientSpec, out: str = "key") -> DataFrame:
    """An invertible filter's pairs with the keys of their hashes."""
    if s.mode != "invertible":
        raise ValueError("only invertible hashes have a key")
    return H.unmurmur64(f, "hash", out, s.seed)


def build(df: DataFrame, key: str, s: QuotientSpec, value: Column | None = None, count: Column | None = None) -> DataFrame:
    """The multiset of the non-null keys with their values (0) and counts (1)."""
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("__key"), (F.lit(0) if value is None else value).cast("long").alias("value"), (F.lit(1) if count is None else count).cast("long").alias("count"))
    rows = with_hash(rows, "__key", s).withColumns({c: H.never_null(F.col(c)) for c in KEY})
    return rows.groupBy(*KEY).agg(F.sum("count").alias("count"))


def merge(*filters: DataFrame) -> DataFrame:
    """The sum of multisets (two or many)."""
    every = filters[0]
    for f in filters[1:]:
        every = every.unionByName(f)
    return every.groupBy(*KEY).agg(F.sum("count").alias("count")).where("count > 0")


def insert(f: DataFrame, more: DataFrame) -> DataFrame:
    return merge(f, more)


def set_count(f: DataFrame, to: DataFrame) -> DataFrame:
    """The counts of ``to`` replace those of its (hash, value) pairs; 0 takes a pair out."""
    return f.join(to, KEY, "left_anti").unionByName(to.select(*KEY, "count")).where("count > 0")


def remove(f: DataFrame, less: DataFrame) -> DataFrame:
    """Takes counts off, down to none."""
    signed = f.unionByName(less.select(*KEY, (-F.col("count")).alias("count")))
    return signed.groupBy(*KEY).agg(F.sum("count").alias("count")).where("count > 0")


def delete(f: DataFrame, pairs: DataFrame) -> DataFrame:
    return f.join(pairs, KEY, "left_anti")


def count_key_value(df: DataFrame, key: str, f: DataFrame, s: QuotientSpec, value: Column | None = None, out: str = "count") -> DataFrame:
    """``df`` with how often (key, value) is in the filter; null for a null key."""
    rows = with_hash(df, key, s, "__hash").withColumn("__value", (F.lit(0) if value is None else value).cast("long"))
    side = f.select(F.col("hash").alias("__fh"), F.col("value").alias("__fv"), F.col("count").alias("__fc"))
    joined = rows.join(side, (F.col("__hash") == F.col("__fh")) & (F.col("__value") == F.col("__fv")), "left")
    return joined.select(*(df[c] for c in df.columns), F.when(df[key].isNotNull(), F.coalesce("__fc", F.lit(0).cast("long"))).alias(out))


def query(df: DataFrame, key: str, f: DataFrame, s: QuotientSpec) -> DataFrame:
    """``df`` with the smallest value of its key, that value's count (0: absent) and a status."""
    first = f.groupBy("hash").agg(F.min(F.struct("value", "count")).alias("v")).select(F.col("hash").alias("__fh"), F.col("v.value").alias("value"), F.col("v.count").alias("count"))
    joined = with_hash(df, key, s, "__hash").join(first, F.col("__hash") == F.col("__fh"), "left")
    return joined.select(*(df[c] for c in df.columns), "value", F.coalesce("count", F.lit(0).cast("long")).alias("count"), F.when(F.col("value").isNull(), DOES_NOT_EXIST).otherwise(OK).alias("status"))


def might_contain(df: DataFrame, key: str, f: DataFrame, s: QuotientSpec, out: str = "maybe") -> DataFrame:
    return count_key_value(df, key, f.groupBy("hash").agg(F.min("value").alias("value"), F.sum("count").alias("count")).withColumn("value", F.lit(0).cast("long")), s, None, "__count").withColumn(out, F.col("__count") > 0).drop("__count")


def ordered(f: DataFrame) -> DataFrame:
    """The iterator: pairs in the order of unsigned hash, then value, range-partitioned."""
    return f.orderBy(F.col("hash").bitwiseXOR(H.lit64(1 << 63)), "value")


def from_position(f: DataFrame, hash_: int, value: int = 0) -> DataFrame:
    """The iterator from the first pair at or after (hash, value)."""
    top = H.lit64(1 << 63)
    at = F.col("hash").bitwiseXOR(top)
    start = H.lit64(hash_ ^ (1 << 63))
    return ordered(f.where((at > start) | ((at == start) & (F.col("value") >= value))))


def unique_index(f: DataFrame, s: QuotientSpec) -> DataFrame:
    """Each pair's rank among the pairs of its quotient, and its quotient: together an index of its own."""
    quotient = H.ushr(F.col("hash"), s.key_bits - s.quotient_bits)
    place = W.partitionBy("quotient").orderBy(F.col("hash").bitwiseXOR(H.lit64(1 << 63)), "value")
    return f.withColumn("quotient", quotient).withColumn("rank", F.row_number().over(place) - 1)


def stats(f: DataFrame, s: QuotientSpec) -> DataFrame:
    """Metadata: slots, bits, sizes, distinct pairs, sum of counts, load and whether it is full."""
    got = f.agg(F.count("*").alias("distinct_pairs"), F.coalesce(F.sum("count"), F.lit(0)).alias("sum_of_counts"))
    fixed = {"slots": s.slots, "key_bits": s.key_bits, "value_bits": s.value_bits, "remainder_bits": s.key_bits - s.quotient_bits, "bytes": s.bytes}
    got = got.select("*", *(F.lit(v).cast("long").alias(k) for k, v in fixed.items()), F.lit(s.mode).alias("hash_mode"), F.lit(s.seed).cast("long").alias("seed"))
    return got.withColumn("load", F.col("distinct_pairs") / F.col("slots")).withColumn("status", F.when(F.col("load") > FULL, NO_SPACE).otherwise(OK))


def inner_product(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: the sum over common pairs of the product of their counts."""
    joined = a.select(*KEY, F.col("count").alias("x")).join(b.select(*KEY, F.col("count").alias("y")), KEY)
    return joined.agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0)).cast("long").alias("inner_product"))


def magnitude(f: DataFrame) -> DataFrame:
    """One row: the root of the filter's product with itself."""
    return f.agg(F.sqrt(F.coalesce(F.sum(F.col("count") * F.col("count")), F.lit(0)).cast("double")).alias("magnitude"))


def intersect(a: DataFrame, b: DataFrame, a_bytes: int = 0, b_bytes: int = 0) -> DataFrame:
    """Pairs in both, with the counts of the filter of more bytes (of one size: the second's)."""
    small, large = (b, a) if a_bytes > b_bytes else (a, b)
    return large.join(small.select(*KEY), KEY, "left_semi")


def resize(f: DataFrame, s: QuotientSpec, quotient_bits: int) -> tuple[DataFrame, QuotientSpec]:
    """The same hashes over another number of slots: remainder bits move to the quotient, or back.

    The answers do not change; growth needs a remainder bit for each doubling."""
    moved = s.remainder_bits - (quotient_bits - s.quotient_bits)
    if s.mode != "invertible" and moved < 1:
        raise ValueError("no remainder bits are left")
    return f, QuotientSpec(quotient_bits, max(moved, 1), s.value_bits, s.mode, s.seed)
