import numpy as np
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tamis.functions import hashing as H
from tamis.functions import sizing as S

EDGES = [0, 1, -1, 2**63 - 1, -(2**63), 0x123456789ABCDEF, 42, -42]


def mix(x):
    for c in (H.MIX_1, H.MIX_2):
        x = (x ^ x >> 33) * c % 2**64
    return x ^ x >> 33


def test_columns_equal_integers(spark):
    keys = EDGES + [int(x) for x in np.random.default_rng(0).integers(-(2**63), 2**63 - 1, 200)]
    df = spark.createDataFrame([(k,) for k in keys] + [(None,)], "key long")
    c = 0xFEDCBA9876543211
    rows = H.murmur64(df, "key", "h", 99).select(
        "key", "h", H.mul64(F.col("key"), c).alias("m"), H.rotl64(F.col("key"), 21).alias("r"), H.fastrange64(F.col("h"), 12345).alias("f"), H.reduce32(F.col("h"), 12345).alias("d"),
        H.reverse_bits(F.col("key")).alias("v"), H.add64(F.col("key"), H.lit64(c)).alias("a"), H.multiply_shift(F.col("key"), 3, c, 5, 7).alias("s"), H.mul_small(F.col("key"), 16).alias("t"),
    ).collect()
    for r in rows:
        if r.key is None:
            assert r.h is None
            continue
        k, u = r.key % 2**64, lambda x: x % 2**64
        h = mix((k + 99) % 2**64)
        assert u(r.h) == h and u(r.m) == k * c % 2**64 and u(r.r) == (k << 21 | k >> 43) % 2**64 and u(r.a) == (k + c) % 2**64 and u(r.t) == k * 16 % 2**64
        assert r.f == h * 12345 >> 64 and r.d == (h % 2**32) * 12345 >> 32 and u(r.v) == int(f"{k:064b}"[::-1], 2)
        assert u(r.s) == ((((3 << 64) + c) * k + (5 << 64) + 7) >> 64) % 2**64


@given(st.lists(st.integers(-(2**63), 2**63 - 1), min_size=1, max_size=20))
def test_numpy_equals_integers(keys):
    h = H.np_murmur64(np.array(keys, np.int64), 7)
    assert h.tolist() == [mix((k + 7) % 2**64) for k in keys]
    assert H.np_fastrange64(h, 99991).tolist() == [x * 99991 >> 64 for x in h.tolist()]
    assert H.np_reverse_bits(h).tolist() == [int(f"{x:064b}"[::-1], 2) for x in h.tolist()]


def test_splitmix_is_the_published_sequence():
    state, out = 0, []
    for _ in range(3):
        state, x = H.splitmix64(state)
        out.append(x)
    assert out == [0xE220A8397B1DCDAF, 0x6E789E6AA1B965F4, 0x06C45D188009454F]


def test_sizes():
    assert S.bloom_probes(8) == 6 and S.bloom_probes(12) == 8 and S.bloom_probes(16) == 11 and S.bloom_probes(10) == 7
    n = 10_000_000
    assert abs(8 * S.xor_slots(n) / n - 9.84) < 0.01
    assert abs(8 * S.cuckoo_bytes(S.cuckoo_stable_buckets(n), 12) / n - 12.77) < 0.01
    assert abs(8 * S.cuckoo_bytes(S.cuckoo_stable_buckets(n), 13, True) / n - 12.77) < 0.01
    assert S.quotient_bits(n) == 24
    assert abs(S.bloom_rate(1, 8, 6) - 0.0216) < 2e-4 and abs(S.bloom_rate(1, 12, 8) - 0.0031) < 1e-4


def test_hashes_lead_back_to_their_keys(spark):
    keys = EDGES + [int(x) for x in np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 200)] + [None]
    for seed in (0, 9):
        hashed = H.murmur64(spark.createDataFrame([(k,) for k in keys], "key long"), "key", "h", seed)
        assert all(r.key == r.back for r in H.unmurmur64(hashed, "h", "back", seed).collect())
