"""One shard of each order-dependent or static filter, with numpy.

A kernel builds a payload from distinct hashes, answers hashes, and, where its kind is
dynamic, adds and removes them.  Peeling works in rounds over whole arrays; displacement
and elimination go key by key, in order of hash, so a shard does not depend on how its
rows arrived.
"""

from __future__ import annotations

import json
import math
import random
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from tamis.functions import hashing as H
from tamis.functions import sizing as S

#: Attempts with other seeds before a build gives up.
MAX_ATTEMPTS = 100
U = np.uint64
#: Multipliers that derive a tag's other place, and a ribbon's coefficients.
TAG_MIX = 0x5BD1E995
TAG_MIX_64 = 0xC4CEB9FE1A85EC53
RIBBON_MIX = 0xC28F82822B650BED


class BuildFailed(Exception):
    """This seed does not work; another may."""


def store(meta: dict, **arrays: np.ndarray) -> bytes:
    head = json.dumps([meta, [(k, a.dtype.str, list(a.shape)) for k, a in arrays.items()]]).encode()
    return b"".join([len(head).to_bytes(4, "little"), head, *(np.ascontiguousarray(a).tobytes() for a in arrays.values())])


def load(payload: bytes) -> tuple[dict, dict[str, np.ndarray]]:
    n = int.from_bytes(payload[:4], "little")
    (meta, told), at, arrays = json.loads(payload[4 : 4 + n]), 4 + n, {}
    for name, kind, shape in told:
        count = math.prod(shape)
        arrays[name] = np.frombuffer(payload, kind, count, at).reshape(shape)
        at += count * np.dtype(kind).itemsize
    return meta, arrays


def uint_for(bits: int) -> type:
    return np.uint8 if bits <= 8 else np.uint16 if bits <= 16 else np.uint32


def spare_places(slots: int, share: int = 512) -> int:
    """Keys beyond a table's own places that it may still take by ``add``.

    A build tries other seeds, but a table that has keys is of its seed: without a spare, one key of unlucky places
    would be refused by a table that has room for it."""
    return 32 + slots // share


def _fingerprint(h: np.ndarray, bits: int) -> np.ndarray:
    return (h ^ h >> U(32)) & U((1 << bits) - 1)


# --- peeled filters ------------------------------------------------------------------------


def peel(places: np.ndarray, slots: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rounds of (rows, the slot that each has for itself); BuildFailed if rows are left over."""
    n, arity = places.shape
    flat = places.ravel()
    degree = np.bincount(flat, minlength=slots)
    # the sum of the rows in a slot names the row once one is left
    names = np.bincount(flat, weights=np.repeat(np.arange(n, dtype=np.float64), arity), minlength=slots).astype(np.int64)
    rounds, left, open_ = [], n, np.flatnonzero(degree == 1)
    while len(open_):
        rows, first = np.unique(names[open_], return_index=True)
        rounds.append((rows, open_[first]))
        left -= len(rows)
        gone = places[rows].ravel()
        np.subtract.at(degree, gone, 1)
        np.subtract.at(names, gone, np.repeat(rows, arity))
        touched = np.unique(gone)
        open_ = touched[degree[touched] == 1]
    if left:
        raise BuildFailed
    return rounds


def assign(places: np.ndarray, prints: np.ndarray, slots: int, rounds: list[tuple[np.ndarray, np.ndarray]], kind: type) -> np.ndarray:
    """Slot values whose xor over a row's places is its fingerprint."""
    table = np.zeros(slots, np.uint64)
    for rows, own in reversed(rounds):
        table[own] = 0
        table[own] = prints[rows] ^ np.bitwise_xor.reduce(table[places[rows]], axis=1)
    return table.astype(kind)


def xor_places(h: np.ndarray, block: int) -> np.ndarray:
    return np.stack([H.np_reduce32(H.np_rotl64(h, 21 * i), block) + i * block for i in range(3)], 1)


def fuse_places(h: np.ndarray, segment: int, starts: int, arity: int) -> np.ndarray:
    base = H.np_fastrange64(h, starts * segment)
    out = [base]
    for i in range(1, arity):
        offset = (h >> U(18 * (arity - 1 - i)) & U(segment - 1)).astype(np.int64)
        out.append((base + i * segment) ^ offset)
    return np.stack(out, 1)


def build_xor(h: np.ndarray, bits: int = 8, plus: bool = False) -> bytes:
    slots = S.xor_slots(len(h))
    places = xor_places(h, slots // 3)
    table = assign(places, _fingerprint(h, bits), slots, peel(places, slots), uint_for(bits))
    if not plus:
        return store({"bits": bits, "plus": False}, table=table)
    third = table[slots // 3 * 2 :]
    return store({"bits": bits, "plus": True}, table=table[: slots // 3 * 2], filled=np.packbits(third != 0), rest=third[third != 0], size=np.array([slots]))


def _xor_table(meta: dict, a: dict) -> np.ndarray:
    if not meta["plus"]:
        return a["table"]
    block = int(a["size"][0]) // 3
    third = np.zeros(block, a["table"].dtype)
    third[np.unpackbits(a["filled"])[:block] == 1] = a["rest"]
    return np.concatenate([a["table"], third])


def in_xor(payload: bytes, h: np.ndarray) -> np.ndarray:
    meta, a = load(payload)
    table = _xor_table(meta, a)
    return np.bitwise_xor.reduce(table[xor_places(h, len(table) // 3)], axis=1) == _fingerprint(h, meta["bits"])


def build_fuse(h: np.ndarray, bits: int = 8, arity: int = 3) -> bytes:
    segment, starts = S.fuse_layout(len(h), arity)
    slots = (starts + arity - 1) * segment
    places = fuse_places(h, segment, starts, arity)
    table = assign(places, _fingerprint(h, bits), slots, peel(places, slots), uint_for(bits))
    return store({"bits": bits, "arity": arity, "segment": segment, "starts": starts}, table=table)


def in_fuse(payload: bytes, h: np.ndarray) -> np.ndarray:
    meta, a = load(payload)
    places = fuse_places(h, meta["segment"], meta["starts"], meta["arity"])
    return np.bitwise_xor.reduce(a["table"][places], axis=1) == _fingerprint(h, meta["bits"])


# --- ribbons -------------------------------------------------------------------------------

WIDTH = 64


def _ribbon_rows(h: np.ndarray, slots: int, smash: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, coefficients (lowest bit set) and result bits of each hash."""
    starts = slots - WIDTH + 1
    if smash:
        start = np.clip(H.np_fastrange64(h, starts + WIDTH) - WIDTH // 2, 0, starts - 1)
    else:
        start = H.np_fastrange64(h, starts)
    mixed = h * U(RIBBON_MIX)
    return start, mixed | U(1), (mixed ^ H.np_rotl64(h, 32)).byteswap()


def _columns(columns: float, slots: int, start: np.ndarray) -> np.ndarray:
    """Of a fractional number, the columns that a key with this start is compared in."""
    low = math.floor(columns)
    return np.where(start >= slots * (1 - (columns - low)), low + 1, low) if columns > low else np.full(len(start), low)


def _mask(bits: np.ndarray, columns: np.ndarray) -> np.ndarray:
    return bits & ((U(1) << columns.astype(np.uint64)) - U(1))


class Band:
    """Gaussian elimination on the fly in a band of ``WIDTH`` columns."""

    def __init__(self, slots: int):
        self.rows, self.results = [0] * slots, [0] * slots

    def add(self, i: int, c: int, r: int) -> int:
        """The slot taken, -1 for a redundant equation; BuildFailed for a contradiction."""
        rows, results = self.rows, self.results
        while True:
            own = rows[i]
            if not own:
                rows[i], results[i] = c, r
                return i
            c ^= own
            r ^= results[i]
            if not c:
                if r:
                    raise BuildFailed
                return -1
            skip = (c & -c).bit_length() - 1
            i += skip
            c >>= skip

    def clear(self, slots: list[int]) -> None:
        for i in slots:
            self.rows[i] = self.results[i] = 0

    def solve(self, columns: int, free: random.Random | None) -> np.ndarray:
        """Values of all slots; those without an equation are 0, or random (homogeneous)."""
        n, out = len(self.rows), np.zeros(len(self.rows), np.uint64)
        values = [0] * (n + WIDTH)
        for i in range(n - 1, -1, -1):
            c, v = self.rows[i], self.results[i]
            if not c:
                values[i] = free.getrandbits(columns) if free else 0
                continue
            c >>= 1
            j = i + 1
            while c:
                skip = (c & -c).bit_length()
                j += skip
                v ^= values[j - 1]
                c >>= skip
            values[i] = v
        out[:] = values[:n]
        return out


#: Share by which a homogeneous ribbon's rate may exceed that of its columns.
COLLAPSED = 0.001


def homogeneous_rate(solution: np.ndarray, columns: float) -> float:
    """Over what its columns give, the rate of a homogeneous ribbon by the rank of each start's slots.

    Where starts crowd, equations leave no slot free for long; the slots there run out of other solutions
    than zero, which every key with such a start agrees with."""
    starts, rows = len(solution) - WIDTH + 1, []
    for j in range(math.ceil(columns)):
        word, width = (solution.astype(np.uint64) >> U(j)) & U(1), 1
        while width < WIDTH:  # the column's bits of the slots from each start on
            word, width = word[:-width] | word[width:] << U(width), 2 * width
        rows.append(word)
    rank = np.zeros(starts, np.int64)
    for j, row in enumerate(rows):
        lowest = row & (~row + U(1))
        rank += row != 0
        for k in range(j + 1, len(rows)):
            rows[k] = np.where(rows[k] & lowest != 0, rows[k] ^ row, rows[k])
    wanted = _columns(columns, len(solution), np.arange(starts))
    return float((2.0 ** -np.minimum(rank, wanted)).mean() / (2.0**-wanted).mean()) - 1


def build_ribbon(h: np.ndarray, columns: float = 8, variant: str = "homogeneous", min_pad: float = 0.0, smash: bool = False, values: np.ndarray | None = None, room: float = 1.0) -> bytes:
    """variant: homogeneous (``room``: times its usual slots), standard or balanced; with ``values`` a static function of ``columns`` bits."""
    whole = math.ceil(columns)
    if variant == "balanced":
        return _build_bumped(h, columns)
    slots = S.homog_ribbon_slots(math.ceil(len(h) * room), columns) if variant == "homogeneous" else S.standard_ribbon_slots(len(h), WIDTH, min_pad)
    start, coefficients, results = _ribbon_rows(h, slots, smash)
    results = np.zeros(len(h), np.uint64) if variant == "homogeneous" else values.astype(np.uint64) if values is not None else _mask(results, _columns(columns, slots, start))
    band = Band(slots)
    for i, c, r in zip(start.tolist(), coefficients.tolist(), results.tolist(), strict=True):
        band.add(i, c, r)
    solution = band.solve(whole, random.Random(slots) if variant == "homogeneous" else None)
    if variant == "homogeneous" and homogeneous_rate(solution, columns) > COLLAPSED:
        raise BuildFailed
    return store({"columns": columns, "variant": variant, "smash": smash, "static": values is not None}, solution=solution.astype(uint_for(whole)))


BUMP_GROUPS = 256


def _build_bumped(h: np.ndarray, columns: float) -> bytes:
    """A slightly overfull ribbon; groups of starts that contradict are bumped, all their keys, to a level of their own."""
    slots = -(-max(WIDTH, int(len(h) * 1.005)) // WIDTH) * WIDTH
    start, coefficients, results = _ribbon_rows(h, slots, False)
    results = _mask(results, _columns(columns, slots, start))
    group = start * BUMP_GROUPS // slots
    band, bumped, order = Band(slots), np.zeros(BUMP_GROUPS, bool), np.argsort(group, kind="stable")
    for rows in np.split(order, np.searchsorted(group[order], np.arange(1, BUMP_GROUPS))):
        taken = []
        try:
            for i, c, r in zip(start[rows].tolist(), coefficients[rows].tolist(), results[rows].tolist(), strict=True):
                taken.append(band.add(i, c, r))
        except BuildFailed:
            band.clear([t for t in taken if t >= 0])
            bumped[group[rows[0]]] = True
    rest = H.np_murmur64(h[bumped[group]])  # hashed again: bumped keys share their starts
    below = build_ribbon(rest, columns, "standard", 0.2) if len(rest) else b""
    return store({"columns": columns, "variant": "balanced", "smash": False, "static": False}, solution=band.solve(math.ceil(columns), None).astype(uint_for(math.ceil(columns))), bumped=bumped, below=np.frombuffer(below, np.uint8))


def ribbon_values(payload: bytes, h: np.ndarray) -> np.ndarray:
    """The static function's value of each hash; without meaning for keys not built in."""
    meta, a = load(payload)
    start, coefficients, _ = _ribbon_rows(h, len(a["solution"]), meta["smash"])
    solution, out = a["solution"], np.zeros(len(h), a["solution"].dtype)
    for j in range(WIDTH):
        out ^= np.where(coefficients >> U(j) & U(1) == 1, solution[start + j], 0).astype(out.dtype)
    return out


def in_ribbon(payload: bytes, h: np.ndarray) -> np.ndarray:
    meta, a = load(payload)
    slots = len(a["solution"])
    start, _, results = _ribbon_rows(h, slots, meta["smash"])
    columns = _columns(meta["columns"], slots, start)
    wanted = np.zeros(len(h), np.uint64) if meta["variant"] == "homogeneous" else _mask(results, columns)
    found = _mask(ribbon_values(payload, h).astype(np.uint64), columns) == wanted
    if meta["variant"] == "balanced":
        away = a["bumped"][start * BUMP_GROUPS // slots]
        if away.any():
            found[away] = in_ribbon(a["below"].tobytes(), H.np_murmur64(h[away])) if len(a["below"]) else False
    return found


# --- cuckoo tables -------------------------------------------------------------------------

SLOTS = 4
KICKS = 500


def _tags(h: np.ndarray, bits: int) -> np.ndarray:
    """1 to 2^bits - 1; 0 is an empty slot."""
    t = h & U((1 << bits) - 1)
    return (t + (t == 0)).astype(np.int64)


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return H.np_reduce32(h >> U(32), buckets)


def _other(bucket: int, tag: int, buckets: int, stable: bool) -> int:
    if not stable:
        return (bucket ^ tag * TAG_MIX) & buckets - 1
    y = (tag * TAG_MIX_64 & H.MASK64) % buckets | 1
    return (buckets - bucket - y) % buckets


def _others(bucket: np.ndarray, tag: np.ndarray, buckets: int, stable: bool) -> np.ndarray:
    if not stable:
        return (bucket ^ tag * TAG_MIX) & buckets - 1
    y = (tag.astype(np.uint64) * U(TAG_MIX_64) % U(buckets)).astype(np.int64) | 1
    return (buckets - bucket - y) % buckets


def _cuckoo_insert(rows: list[list[int]], bucket: np.ndarray, tag: np.ndarray, stable: bool, seed: int) -> None:
    draw, buckets = random.Random(seed), len(rows)
    for b, t in zip(bucket.tolist(), tag.tolist(), strict=True):
        if len(rows[b]) < SLOTS:
            rows[b].append(t)
            continue
        b = _other(b, t, buckets, stable)
        for _ in range(KICKS):
            row = rows[b]
            if len(row) < SLOTS:
                row.append(t)
                break
            k = draw.randrange(SLOTS)
            row[k], t = t, row[k]
            b = _other(b, t, buckets, stable)
        else:
            raise BuildFailed


def _cuckoo_store(meta: dict, rows: list[list[int]]) -> bytes:
    table = np.zeros((len(rows), SLOTS), uint_for(meta["bits"]))
    for b, row in enumerate(rows):
        if row:
            # slots of a bucket have no order: sorted, a table does not depend on the order of insertion more than it must
            table[b, : len(row)] = sorted(row)
    return store(meta, table=table)


def build_cuckoo(h: np.ndarray, bits: int = 12, stable: bool = True, packed: bool = False, capacity: int | None = None) -> bytes:
    n = max(capacity or len(h), 1)
    buckets = max(2, S.cuckoo_stable_buckets(n) if stable else S.cuckoo_buckets(n))
    rows: list[list[int]] = [[] for _ in range(buckets)]
    _cuckoo_insert(rows, _bucket(h, buckets), _tags(h, bits), stable, buckets)
    return _cuckoo_store({"bits": bits, "stable": stable, "packed": packed}, rows)


def _cuckoo_rows(a: dict) -> list[list[int]]:
    return [[t for t in row if t] for row in a["table"].tolist()]


def add_cuckoo(payload: bytes, h: np.ndarray) -> bytes:
    meta, a = load(payload)
    rows = _cuckoo_rows(a)
    _cuckoo_insert(rows, _bucket(h, len(rows)), _tags(h, meta["bits"]), meta["stable"], len(rows))
    return _cuckoo_store(meta, rows)


def remove_cuckoo(payload: bytes, h: np.ndarray) -> bytes:
    meta, a = load(payload)
    rows = _cuckoo_rows(a)
    for b, t in zip(_bucket(h, len(rows)).tolist(), _tags(h, meta["bits"]).tolist(), strict=True):
        for at in (b, _other(b, t, len(rows), meta["stable"])):
            if t in rows[at]:
                rows[at].remove(t)
                break
    return _cuckoo_store(meta, rows)


def in_cuckoo(payload: bytes, h: np.ndarray) -> np.ndarray:
    meta, a = load(payload)
    table = a["table"]
    b, t = _bucket(h, len(table)), _tags(h, meta["bits"])
    return (table[b] == t[:, None]).any(1) | (table[_others(b, t, len(table), meta["stable"])] == t[:, None]).any(1)


FUSE_KICKS = 200_000


def _spread(tag: np.ndarray, k: int, segment: int) -> np.ndarray:
    """What a tag's offset differs by from segment 0 to segment k."""
    return (tag.astype(np.uint64) * U((TAG_MIX_64 * k) & H.MASK64) >> U(40)).astype(np.int64) & segment - 1


def _fuse_home(h: np.ndarray, segments: int, segment: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First segment, offset in it, tag of bits - 2."""
    return H.np_reduce32(h >> U(32), segments - 2), (h >> U(16)).astype(np.int64) & segment - 1, _tags(h, bits - 2)


def _fuse_insert(table: list[int], segment: int, bits: int, h: np.ndarray) -> None:
    first, offset, tag = _fuse_home(h, len(table) // segment, segment, bits)
    spreads = [_spread(np.arange(1 << bits - 2), k, segment).tolist() for k in range(3)]
    draw, kicks = random.Random(len(table)), 0
    for s, o, t in zip(first.tolist(), offset.tolist(), tag.tolist(), strict=True):
        k = -1
        while True:
            spot = next((p for p in (((s + i) * segment + (o ^ spreads[i][t])) * 4 + i for i in range(3) if i != k) if not table[p >> 2]), None)
            if spot is not None:
                table[spot >> 2] = t << 2 | (spot & 3)
                break
            i = draw.choice([i for i in range(3) if i != k])
            at = (s + i) * segment + (o ^ spreads[i][t])
            old, table[at] = table[at], t << 2 | i
            t, k = old >> 2, old & 3
            s, o = at // segment - k, at % segment ^ spreads[k][t]
            kicks += 1
            if kicks > FUSE_KICKS:
                raise BuildFailed


def build_cuckoo_fuse(h: np.ndarray, bits: int = 8, capacity: int | None = None) -> bytes:
    n = max(capacity or 0, len(h))
    segment = min(S.CUCKOO_FUSE_SEGMENT, max(64, 1 << max(0, n.bit_length() - 3)))
    table = [0] * S.cuckoo_fuse_slots(n, segment=segment)
    _fuse_insert(table, segment, bits, h)
    return store({"bits": bits, "segment": segment}, table=np.array(table, uint_for(bits)))


def add_cuckoo_fuse(payload: bytes, h: np.ndarray) -> bytes:
    meta, a = load(payload)
    table = a["table"].tolist()
    _fuse_insert(table, meta["segment"], meta["bits"], h)
    return store(meta, table=np.array(table, a["table"].dtype))


def _fuse_spots(meta: dict, slots: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    segment = meta["segment"]
    first, offset, tag = _fuse_home(h, slots // segment, segment, meta["bits"])
    return np.stack([(first + k) * segment + (offset ^ _spread(tag, k, segment)) for k in range(3)], 1), tag[:, None] << 2 | np.arange(3)


def in_cuckoo_fuse(payload: bytes, h: np.ndarray) -> np.ndarray:
    meta, a = load(payload)
    spots, wanted = _fuse_spots(meta, len(a["table"]), h)
    return (a["table"][spots] == wanted).any(1)


def remove_cuckoo_fuse(payload: bytes, h: np.ndarray) -> bytes:
    meta, a = load(payload)
    table = a["table"].copy()
    for spots, wanted in zip(*_fuse_spots(meta, len(table), h), strict=True):
        hit = np.flatnonzero(table[spots] == wanted)
        if len(hit):
            table[spots[hit[0]]] = 0
    return store(meta, table=table)


# --- block filters -------------------------------------------------------------------------


def morton_layout(preset: str) -> tuple[int, int, int, int]:
    """Slots of a bucket, fingerprint bits, fingerprints and buckets of a 512-bit block with 16 overflow bits.

    Fingerprints follow from the published bits an item, and buckets from the bits they leave
    for counters; where these leave buckets under twice the fingerprints, fewer are held.
    """
    slots, bits, per_item = S.MORTON_PRESETS[preset]
    held = round(512 / (0.95 * per_item))
    while (buckets := (496 - held * bits) // slots.bit_length() // 2 * 2) * slots < 2 * held:
        held -= 1
    return slots, bits, held, buckets


def _morton_other(b: int, t: int, total: int) -> int:
    off = (t * TAG_MIX % max(1, total // 2)) | 1
    return (b + off if b % 2 == 0 else b - off) % total


def _morton_spare(b: np.ndarray, t: np.ndarray, other: np.ndarray) -> np.ndarray:
    """A tag and its buckets, the same from either of them."""
    return np.minimum(b, other).astype(np.int64) << 32 | t


def _morton_insert(rows: list[list[int]], held: list[int], over: np.ndarray, bucket: np.ndarray, tag: np.ndarray, layout: tuple[int, int, int, int], room: int = 0) -> list[int]:
    """Fills the rows; up to ``room`` tags that found no place are returned."""
    slots, _, most, per = layout
    total, draw, spare = len(rows), random.Random(len(rows)), []

    def place(b: int, t: int) -> bool:
        if len(rows[b]) < slots and held[b // per] < most:
            rows[b].append(t)
            held[b // per] += 1
            return True
        return False

    for home, t in zip(bucket.tolist(), tag.tolist(), strict=True):
        if place(home, t):
            continue
        b = home
        for _ in range(KICKS):
            # what leaves a bucket, or finds it full, sets the block's overflow bit: the other bucket must then be read
            over[b // per, b % 16] = True
            b = _morton_other(b, t, total)
            if place(b, t):
                break
            block = b // per
            row = rows[b] if rows[b] else next(rows[x] for x in draw.sample(range(block * per, (block + 1) * per), per) if rows[x])
            if row is not rows[b]:
                # the block is full but the bucket is empty: another bucket of the block gives one up
                x = next(i for i in range(block * per, (block + 1) * per) if rows[i] is row)
                old = row.pop(draw.randrange(len(row)))
                rows[b].append(t)
                t, b = old, x
                continue
            k = draw.randrange(len(row))
            row[k], t = t, row[k]
        else:
            if len(spare) >= room:
                raise BuildFailed
            spare.append(min(b, _morton_other(b, t, total)) << 32 | t)
    return spare


def build_morton(h: np.ndarray, preset: str = "3_8", capacity: int | None = None) -> bytes:
    layout = morton_layout(preset)
    slots, bits, most, per = layout
    blocks = max(2, -(-int(max(capacity or len(h), 1) / 0.95 + 64) // most))
    rows, held, over = [[] for _ in range(blocks * per)], [0] * blocks, np.zeros((blocks, 16), bool)
    _morton_insert(rows, held, over, _bucket(h, len(rows)), _tags(h, bits), layout)
    return _morton_store({"preset": preset}, rows, over, layout)


def _morton_store(meta: dict, rows: list[list[int]], over: np.ndarray, layout: tuple[int, int, int, int], spare: list[int] | None = None) -> bytes:
    table = np.zeros((len(rows), layout[0]), uint_for(min(layout[1], 32)))
    for b, row in enumerate(rows):
        table[b, : len(row)] = sorted(row)
    return store(meta, table=table, over=over, **({"spare": np.array(sorted(spare), np.int64)} if spare else {}))


def _morton_home(meta: dict, a: dict, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    total = len(a["table"])
    b, t = _bucket(h, total), _tags(h, morton_layout(meta["preset"])[1])
    off = (t * TAG_MIX % max(1, total // 2)) | 1
    return b, t, np.where(b % 2 == 0, b + off, b - off) % total


def in_morton(payload: bytes, h: np.ndarray) -> np.ndarray:
    meta, a = load(payload)
    per = morton_layout(meta["preset"])[3]
    b, t, other = _morton_home(meta, a, h)
    first = (a["table"][b] == t[:, None]).any(1)
    found = first | (a["over"][b // per, b % 16] & (a["table"][other] == t[:, None]).any(1))
    return found | np.isin(_morton_spare(b, t, other), a["spare"]) if "spare" in a else found


def add_morton(payload: bytes, h: np.ndarray) -> bytes:
    meta, a = load(payload)
    layout = morton_layout(meta["preset"])
    rows, over = [[t for t in r if t] for r in a["table"].tolist()], a["over"].copy()
    held = [sum(map(len, rows[i : i + layout[3]])) for i in range(0, len(rows), layout[3])]
    b, t, _ = _morton_home(meta, a, h)
    spare = a["spare"].tolist() if "spare" in a else []
    spare += _morton_insert(rows, held, over, b, t, layout, spare_places(len(rows) * layout[0]) - len(spare))
    return _morton_store(meta, rows, over, layout, spare)


def remove_morton(payload: bytes, h: np.ndarray) -> bytes:
    meta, a = load(payload)
    rows = [[t for t in r if t] for r in a["table"].tolist()]
    spare = a["spare"].tolist() if "spare" in a else []
    for b, t, other in zip(*(x.tolist() for x in _morton_home(meta, a, h)), strict=True):
        for at in (b, other):
            if t in rows[at]:
                rows[at].remove(t)
                break
        else:
            if (code := min(b, other) << 32 | t) in spare:
                spare.remove(code)
    return _morton_store(meta, rows, a["over"], morton_layout(meta["preset"]), spare)


#: Tags of a block, and the small buckets that a tag can belong to.
PLACES, SMALL_BUCKETS = 48, 80
EMPTY = 0xFFFF
#: Tags up to which the first of two bins is taken unseen.
SHORTCUT = 34


def _two_blocks(h: np.ndarray, blocks: int, independent: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First block, second block, and code (small bucket, 8-bit tag)."""
    code = ((h >> U(8) & U(0xFFFF)) * U(SMALL_BUCKETS) >> U(16)).astype(np.int64) << 8 | (h & U(255)).astype(np.int64)
    first = H.np_reduce32(h >> U(32), blocks)
    if independent:
        second = H.np_reduce32(H.np_murmur64(h) >> U(32), blocks)
    else:
        y = code * TAG_MIX % blocks | 1
        second = (blocks - first - y) % blocks
    return first, second, code


def build_two_choice(h: np.ndarray, vector: bool = False, shortcut: bool = True, capacity: int | None = None) -> bytes:
    """Bins of 48 places; ``vector`` derives the second bin from the tag and always takes the emptier one."""
    n = max(capacity or len(h), 1)
    blocks = S.vqf_blocks(n) // 2 * 2 + 2 if vector else S.two_choice_bins(n)
    meta = {"vector": vector, "shortcut": shortcut}
    return _two_insert(meta, np.full((blocks, PLACES), EMPTY, np.uint16), h, [])


def _two_store(meta: dict, table: np.ndarray, spare: list[int]) -> bytes:
    table.sort(axis=1)
    return store(meta, table=table, **({"spare": np.array(sorted(spare), np.uint64)} if spare else {}))


def _two_insert(meta: dict, table: np.ndarray, h: np.ndarray, spare: list[int], room: int = 0) -> bytes:
    """Up to ``room`` keys whose bins are both full go to the spare, as hashes."""
    table, blocks, places = table.copy(), len(table), []
    first, second, code = _two_blocks(h, blocks, not meta["vector"])
    used, spare, shortcut = (table != EMPTY).sum(1).tolist(), list(spare), meta["shortcut"] and not meta["vector"]
    for a, b, c, x in zip(first.tolist(), second.tolist(), code.tolist(), h.tolist(), strict=True):
        if not (shortcut and used[a] < SHORTCUT) and used[b] < used[a]:
            a = b
        if used[a] < PLACES:
            used[a] += 1
            places.append((a, c))
        elif len(spare) < room:
            spare.append(x)
        else:
            raise BuildFailed
    for a, c in places:
        table[a, int(np.argmax(table[a] == EMPTY))] = c
    return _two_store(meta, table, spare)


def _two_spare(a: dict) -> list[int]:
    return a["spare"].tolist() if "spare" in a else []


def in_two_choice(payload: bytes, h: np.ndarray) -> np.ndarray:
    meta, a = load(payload)
    first, second, code = _two_blocks(h, len(a["table"]), not meta["vector"])
    found = (a["table"][first] == code[:, None]).any(1) | (a["table"][second] == code[:, None]).any(1)
    return found | np.isin(h, a["spare"]) if "spare" in a else found


def add_two_choice(payload: bytes, h: np.ndarray) -> bytes:
    meta, a = load(payload)
    return _two_insert(meta, a["table"], h, _two_spare(a), spare_places(a["table"].size, 128 if meta["vector"] else 512))


def remove_two_choice(payload: bytes, h: np.ndarray) -> bytes:
    meta, a = load(payload)
    table, spare = a["table"].copy(), _two_spare(a)
    for x, y, c, own in zip(*_two_blocks(h, len(table), not meta["vector"]), h.tolist(), strict=True):
        if spare and own in spare:
            spare.remove(own)
            continue
        for b in (x, y):
            at = np.flatnonzero(table[b] == c)
            if len(at):
                table[b, at[0]] = EMPTY
                break
    return _two_store(meta, table, spare)


# --- the table of kernels ------------------------------------------------------------------


def _content_bytes(payload: bytes) -> int:
    return sum(a.nbytes for a in load(payload)[1].values())


def _cuckoo_bytes(payload: bytes) -> int:
    meta, a = load(payload)
    return S.cuckoo_bytes(len(a["table"]), meta["bits"], meta["packed"])


def _ribbon_bytes(payload: bytes) -> int:
    """The columns' bits, bump marks and the level below."""
    meta, a = load(payload)
    own = int(len(a["solution"]) * meta["columns"] / 8)
    if meta["variant"] != "balanced":
        return own
    return own + BUMP_GROUPS // 8 + (_ribbon_bytes(a["below"].tobytes()) if len(a["below"]) else 0)


def _morton_bytes(payload: bytes) -> int:
    meta, a = load(payload)
    return 64 * (len(a["table"]) // morton_layout(meta["preset"])[3]) + (a["spare"].nbytes if "spare" in a else 0)


def _two_bytes(payload: bytes) -> int:
    a = load(payload)[1]
    return 64 * len(a["table"]) + (a["spare"].nbytes if "spare" in a else 0)


@dataclass(frozen=True)
class Kernel:
    build: Callable[..., bytes]
    contains: Callable[[bytes, np.ndarray], np.ndarray]
    bytes: Callable[[bytes], int] = _content_bytes
    add: Callable[[bytes, np.ndarray], bytes] | None = None
    remove: Callable[[bytes, np.ndarray], bytes] | None = None


KERNELS = {
    "xor": Kernel(build_xor, in_xor),
    "fuse": Kernel(build_fuse, in_fuse),
    "ribbon": Kernel(build_ribbon, in_ribbon, _ribbon_bytes),
    "cuckoo": Kernel(build_cuckoo, in_cuckoo, _cuckoo_bytes, add_cuckoo, remove_cuckoo),
    "cuckoo_fuse": Kernel(build_cuckoo_fuse, in_cuckoo_fuse, add=add_cuckoo_fuse, remove=remove_cuckoo_fuse),
    "morton": Kernel(build_morton, in_morton, _morton_bytes, add_morton, remove_morton),
    "two_choice": Kernel(build_two_choice, in_two_choice, _two_bytes, add_two_choice, remove_two_choice),
}


#: Kinds whose build takes a capacity.
GROWS = ("cuckoo", "cuckoo_fuse", "morton", "two_choice")


def build(kind: str, keys: np.ndarray, seed: int, params: dict, **more: np.ndarray) -> tuple[bytes, int, int]:
    """Payload, the seed that worked and the attempts made, for distinct keys in any order."""
    for attempt in range(MAX_ATTEMPTS):
        now = H.reseed(seed, attempt)
        h = H.np_murmur64(keys, now)
        order = np.argsort(h)
        try:
            # a table that seeds alone do not fit gets a hundredth more room with each attempt
            more_room = 1 + 0.01 * max(0, attempt - 9)
            room = {"capacity": int(max(len(keys), params.get("capacity") or 0) * more_room)} if kind in GROWS and attempt >= 10 else {}
            if kind == "ribbon" and params.get("variant", "homogeneous") == "homogeneous":
                room = {"room": more_room}
            return KERNELS[kind].build(h[order], **(params | room), **{k: v[order] for k, v in more.items()}), H.signed(now), attempt + 1
        except BuildFailed:
            continue
    raise RuntimeError(f"no seed in {MAX_ATTEMPTS} builds a {kind} of {len(keys)} keys")
