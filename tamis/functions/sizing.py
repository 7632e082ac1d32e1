"""Sizes and expected rates of every kind of filter: pure arithmetic, and as columns where sweeps need it."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def bloom_probes(bits_per_key: int) -> int:
    return int(bits_per_key * math.log(2) + 0.5)


def bloom_words(n: int, bits_per_key: int) -> int:
    return -(-n * bits_per_key // 64)


def bloom_rate(keys: float, bits: float, probes: int) -> float:
    """Standard Bloom filter, all probes independent."""
    return (1 - math.exp(-probes * keys / bits)) ** probes if bits else 0.0


def cache_local_rate(keys: float, bits: float, probes: int, line_bits: int = 512) -> float:
    """All probes in one line: the mean of a line one standard deviation fuller and one emptier."""
    per_line = keys * line_bits / bits
    spread = math.sqrt(per_line)
    crowded, sparse = bloom_rate(per_line + spread, line_bits, probes), bloom_rate(max(0.0, per_line - spread), line_bits, probes)
    return (crowded + sparse) / 2


def fingerprint_rate(keys: float, fingerprint_bits: int) -> float:
    """A query is compared with ``keys`` fingerprints."""
    inverse = 2.0 ** -fingerprint_bits
    p = -math.expm1(-keys * inverse)
    return p if p > 0 else keys * inverse


def independent_sum(rate1: float, rate2: float) -> float:
    return rate1 + rate2 - rate1 * rate2


#: Thousandths of bits a key from which one more probe pays in a line-local filter.
PROBE_STEPS = ((2080, 1), (3580, 2), (5100, 3), (6640, 4), (8300, 5), (10070, 6), (11720, 7), (14001, 8), (16050, 9), (18300, 10), (22001, 11), (25501, 12))


def local_probes(millibits_per_key: int) -> int:
    """Probes of a line-local Bloom filter."""
    for below, probes in PROBE_STEPS:
        if millibits_per_key <= below:
            return probes
    return 24 if millibits_per_key > 50000 else (millibits_per_key - 1) // 2000 - 1


def local_probes_column(millibits: Column) -> Column:
    chain = F.when(millibits <= PROBE_STEPS[0][0], PROBE_STEPS[0][1])
    for below, probes in PROBE_STEPS[1:]:
        chain = chain.when(millibits <= below, probes)
    return chain.when(millibits > 50000, 24).otherwise(F.floor((millibits - 1) / 2000) - 1).cast("int")


def simple_block_words(n: int) -> int:
    return n * 10 // 64 + 8


def blocked_buckets(n: int, keys_per_bucket: int = 24) -> int:
    return max(1, n // keys_per_bucket)


def counting_words(n: int, bits_per_key: int = 10) -> int:
    """64-bit words of four-bit counters, one counter for each Bloom bit."""
    return 4 * n * bits_per_key // 64


def succinct_bytes(n: int, bits_per_key: int = 10) -> int:
    words = -(-n * bits_per_key // 64)
    return 16 * words + 8 * (100 + words * 12 // 100)


def succinct_blocked_bytes(n: int, bits_per_key: int = 10) -> int:
    buckets = max(1, n * bits_per_key // 512)
    return 128 * buckets + 8 * (100 + buckets * 36 // 100)


def cuckoo_buckets(n: int, load: float = 0.94) -> int:
    """Power-of-two table of four slots a bucket."""
    buckets = 1 << max(0, (max(1, -(-n // 4)) - 1).bit_length())
    return buckets * 2 if n / (4 * buckets) > load else buckets


def cuckoo_stable_buckets(n: int, load: float = 0.94) -> int:
    return int(10 + n / load / 4) // 2 * 2


def cuckoo_bytes(buckets: int, tag_bits: int, packed: bool = False) -> int:
    """Semi-sorted (packed) tables save one bit a tag."""
    bits = 4 * (tag_bits - 4) + 12 if packed else 4 * tag_bits
    return -(-buckets * bits // 8)


def cuckoo_rate(tag_bits: int, load: float = 0.94) -> float:
    return 8 * load / 2.0**tag_bits


CUCKOO_FUSE_SEGMENT = 1 << 14


def cuckoo_fuse_slots(n: int, load: float = 0.80, segment: int = CUCKOO_FUSE_SEGMENT) -> int:
    return (int(n / load) // segment + 3) * segment


def quotient_bits(n: int) -> int:
    """log2 of the slots of a counting quotient filter filled to nine tenths."""
    q = 1
    while 0.9 * (1 << q) < n:
        q += 1
    return q


def xor_slots(n: int) -> int:
    """Three equal blocks of 32 + 1.23 n slots together."""
    return int(32 + 1.23 * n) // 3 * 3


def fuse_segment(n: int, arity: int) -> int:
    n = max(n, 2)
    exponent = math.floor(math.log(n) / math.log(3.33) + 2.25) if arity == 3 else math.floor(math.log(n) / math.log(2.91) - 0.5)
    return 1 << max(2, min(18, exponent))


def fuse_factor(n: int, arity: int) -> float:
    n = max(n, 2)
    if arity == 3:
        return max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n))
    return max(1.075, 0.77 + 0.305 * math.log(6e5) / math.log(n))


def fuse_layout(n: int, arity: int) -> tuple[int, int]:
    """Segment length and the number of segments that a key can start in."""
    segment = fuse_segment(n, arity)
    count = -(-round(n * fuse_factor(n, arity)) // segment)
    return segment, max(1, count - (arity - 1))


def fuse_slots(n: int, arity: int) -> int:
    segment, starts = fuse_layout(n, arity)
    return (starts + arity - 1) * segment


def fuse_segment_column(n: Column, arity: int) -> Column:
    x = F.log(F.greatest(n, F.lit(2)))
    exponent = F.floor(x / math.log(3.33) + 2.25) if arity == 3 else F.floor(x / math.log(2.91) - 0.5)
    return F.pow(F.lit(2.0), F.greatest(F.lit(2), F.least(F.lit(18), exponent))).cast("long")


def fuse_factor_column(n: Column, arity: int) -> Column:
    x = F.log(F.greatest(n, F.lit(2)))
    return F.greatest(F.lit(1.125), 0.875 + 0.25 * math.log(1e6) / x) if arity == 3 else F.greatest(F.lit(1.075), 0.77 + 0.305 * math.log(6e5) / x)


def gcs_buckets(n: int) -> int:
    return max(1, -(-n // 16))


def gcs_data_bits(n: int, bits: int = 8) -> float:
    """Golomb-Rice codes of n sorted values below 2^(bits+4) * n / 16 with ``bits - 1`` low bits, on average."""
    return n * (bits - 1 + 1 + 2.0)


def homog_ribbon_slots(n: int, columns: float, width: int = 64) -> int:
    slots = round((1 + (4 + columns / 4) / width) * n)
    return -(-max(slots, width) // width) * width


def standard_ribbon_slots(n: int, width: int = 64, min_pad: float = 0.0) -> int:
    a, b = (-0.0251, 0.0083) if width == 64 else (-0.0176, 0.0038)
    overhead = max(a + b * math.log2(max(n, 2)), min_pad)
    return -(-max(int(n * (1 + overhead)), width) // width) * width


def ribbon_rate(columns: float) -> float:
    """Of a fractional number of columns, slots share between the two whole ones."""
    low = math.floor(columns)
    upper = columns - low
    return (1 - upper) * 2.0**-low + upper * 2.0 ** -(low + 1) if upper else 2.0**-low


def vqf_blocks(n: int) -> int:
    return max(2, int(n / 0.93 + 48) // 48)


def two_choice_bins(n: int, load: float = 0.935) -> int:
    bins = -(-n // int(48 * load)) if n else 2
    return max(2, bins + bins % 2)


def prefix_bins(n: int, load: float = 0.95) -> int:
    return max(1, math.ceil(n / (25 * load)))


#: Slots and fingerprint bits of the block presets, with published bits an item at load 0.95.
MORTON_PRESETS = {
    "1_8": (1, 8, 11.7), "3_8": (3, 8, 11.7), "7_8": (7, 8, 9.98), "15_8": (15, 8, 9.98),
    "3_6": (3, 6, 8.84), "7_6": (7, 6, 8.17), "15_6": (15, 6, 8.84),
    "3_12": (3, 12, 15.0), "7_12": (7, 12, 13.5), "15_12": (15, 12, 15.0),
    "3_16": (3, 16, 20.0), "7_16": (7, 16, 19.2), "15_16": (15, 16, 18.6),
    "3_18": (3, 18, 22.5), "7_18": (7, 18, 21.6), "15_18": (15, 18, 20.7),
}


def optimal_bits(rate: float) -> float:
    """Bits a key that any filter of this false-positive rate needs."""
    return math.log2(1 / rate) if rate > 0 else math.inf


def wasted_percent(bits_per_key: float, rate: float) -> float:
    return 100 * (bits_per_key / optimal_bits(rate) - 1)
