import numpy as np
import pytest

from tamis.functions import hashing as H
from tamis.operators import kernels as K
from tamis.operators import sorted_sets

#: Kind, parameters, largest rate, bits an item at 40,000 keys.
KINDS = [
    ("xor", {"bits": 8}, 0.0045, 9.85), ("xor", {"bits": 16}, 1e-4, 19.7), ("xor", {"bits": 8, "plus": True}, 0.0045, 9.5),
    ("fuse", {"bits": 8, "arity": 3}, 0.0045, 9.9), ("fuse", {"bits": 16, "arity": 4}, 1e-4, 18.7),
    ("ribbon", {"columns": 8, "variant": "homogeneous"}, 0.0045, 8.8), ("ribbon", {"columns": 7.7, "variant": "standard"}, 0.006, 8.6), ("ribbon", {"columns": 8, "variant": "standard", "smash": True}, 0.0045, 8.9),
    ("ribbon", {"columns": 8, "variant": "balanced"}, 0.0045, 8.6),
    ("cuckoo", {"bits": 12}, 0.0025, 12.8), ("cuckoo", {"bits": 8, "stable": False}, 0.03, 17.1), ("cuckoo", {"bits": 13, "packed": True}, 0.0015, 12.8),
    ("cuckoo_fuse", {"bits": 8}, 0.03, 15), ("morton", {"preset": "3_8"}, 0.005, 11.8), ("morton", {"preset": "7_12"}, 0.0015, 14.3),
    ("two_choice", {}, 0.006, 11.8), ("two_choice", {"vector": True}, 0.006, 12.3),
]


@pytest.mark.parametrize(("kind", "params", "rate", "bits"), KINDS)
def test_contract(kind, params, rate, bits):
    r = np.random.default_rng(1)
    for n in (1, 2, 17, 40_000):
        keys, absent = r.integers(0, 2**63 - 1, n), r.integers(-(2**63), -1, 50_000)
        payload, seed, _ = K.build(kind, keys, 7, params)
        contains = lambda k: K.KERNELS[kind].contains(payload, H.np_murmur64(k, seed))  # noqa: B023, E731
        assert contains(keys).all()
        assert K.build(kind, keys[::-1], 7, params)[0] == payload  # whatever the order of the rows
    assert contains(absent).mean() <= rate
    assert 8 * K.KERNELS[kind].bytes(payload) / n <= bits


@pytest.mark.parametrize(("kind", "params"), [(k, p) for k, p, *_ in KINDS if K.KERNELS[k].remove])
def test_remove_and_add(kind, params):
    keys = np.arange(1000)
    payload, seed, _ = K.build(kind, keys, 1, params)
    h = H.np_murmur64(keys, seed)
    half = K.KERNELS[kind].remove(payload, h[:500])
    assert K.KERNELS[kind].contains(half, h[500:]).all()
    assert not K.KERNELS[kind].contains(K.KERNELS[kind].remove(half, h[500:]), h).any()
    if K.KERNELS[kind].add:
        assert K.KERNELS[kind].contains(K.KERNELS[kind].add(half, h[:500]), h).all()


def test_static_function():
    keys = np.arange(5000)
    values = keys * 37 % 200
    payload, seed, _ = K.build("ribbon", keys, 3, {"columns": 8, "variant": "standard", "min_pad": 0.1}, values=values)
    assert (K.ribbon_values(payload, H.np_murmur64(keys, seed)) == values).all()


def test_failed_builds_raise():
    with pytest.raises(RuntimeError):
        K.build("xor", np.zeros(10, np.int64), 0, {"bits": 8})  # equal keys never peel


def test_rice_codes_round_trip():
    deltas = np.array([0, 1, 127, 128, 1000, 5000, 3])
    assert (sorted_sets.rice_decode(sorted_sets.rice_encode(deltas, 7), len(deltas), 7) == deltas).all()
    assert len(sorted_sets.rice_encode(deltas, 7)) == -(-sum((d >> 7) + 8 for d in deltas.tolist()) // 8)


def test_presets_fit_a_block():
    for preset in K.S.MORTON_PRESETS:
        slots, bits, held, buckets = K.morton_layout(preset)
        assert held * bits + buckets * slots.bit_length() + 16 <= 512 and buckets * slots >= 2 * held


def test_morton_of_unlucky_buckets_takes_what_it_has_room_for():
    h = H.np_murmur64(np.arange(10_000) + 174 * 10**7, 251)  # one tag's walk ends without a place
    payload = K.add_morton(K.build_morton(np.sort(h[:2000]), capacity=len(h)), np.sort(h[2000:]))
    assert K.in_morton(payload, h).all() and len(K.load(payload)[1]["spare"]) == 1
    again = K.add_morton(K.remove_morton(payload, np.sort(h[5000:])), np.sort(h[5000:]))
    assert K.in_morton(again, h).all()
    assert not K.in_morton(K.remove_morton(payload, h), h).any()
    with pytest.raises(K.BuildFailed):
        K.add_morton(payload, H.np_murmur64(np.arange(5000), 1))  # and not more than that


@pytest.mark.parametrize("vector", [False, True])
def test_two_full_bins_do_not_end_an_add_with_room(vector):
    spared = 0
    for seed in range(3):
        h = H.np_murmur64(np.arange(65_536), seed)
        empty = K.build_two_choice(h[:0], vector=vector, capacity=len(h))
        payload = K.add_two_choice(K.add_two_choice(empty, np.sort(h[:13_000])), np.sort(h[13_000:]))
        spare = K.load(payload)[1].get("spare", [])
        spared += len(spare)
        assert K.in_two_choice(payload, h).all() and K.KERNELS["two_choice"].bytes(payload) == K.KERNELS["two_choice"].bytes(empty) + 8 * len(spare)
    assert spared > 0
    less = K.remove_two_choice(payload, np.asarray(spare, np.uint64))
    assert "spare" not in K.load(less)[1] and K.in_two_choice(less, h[~np.isin(h, spare)]).all()
    with pytest.raises(K.BuildFailed):
        K.add_two_choice(payload, H.np_murmur64(np.arange(65_536, 80_000), seed))


@pytest.mark.parametrize("columns", [5, 7])
def test_a_collapsed_ribbon_is_built_again(columns):
    r = np.random.default_rng(4)  # keys that crowd in one part of the slots
    keys, absent = r.integers(0, 2**63 - 1, 20_000), r.integers(-(2**63), -1, 200_000)
    payload, seed, attempts = K.build("ribbon", keys, 0, {"columns": columns, "variant": "homogeneous"})
    hit, rate = K.in_ribbon(payload, H.np_murmur64(absent, seed)).mean(), 2.0**-columns
    assert K.in_ribbon(payload, H.np_murmur64(keys, seed)).all()
    assert abs(hit - rate) < 5 * np.sqrt(rate / len(absent))
    solution = K.load(payload)[1]["solution"]
    assert attempts > 1 and K.homogeneous_rate(solution, columns) <= K.COLLAPSED
    worse = solution.copy()
    worse[5000:5500] = 0
    assert K.homogeneous_rate(worse, columns) > 400 / len(solution)


@pytest.mark.parametrize("n", [0, 1, 59, 118, 300])
def test_small_homogeneous_ribbons_keep_their_rate(n):
    keys, absent = np.arange(n), np.arange(10**6, 10**6 + 100_000)
    payload, seed, _ = K.build("ribbon", keys, 0, {"columns": 8, "variant": "homogeneous"})
    assert K.in_ribbon(payload, H.np_murmur64(keys, seed)).all()
    assert K.in_ribbon(payload, H.np_murmur64(absent, seed)).mean() < 0.0055
