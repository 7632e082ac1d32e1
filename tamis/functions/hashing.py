"""64-bit hashing and range reduction, as column expressions, with numpy, and as DuckDB SQL.

Keys and hashes are 64-bit patterns in signed longs.  Under ANSI arithmetic a product of
longs may not overflow, so columns multiply by limbs: sums stay under 2^52 and only shifts
and masks wrap.  All three forms give the same bits.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

MASK32 = 0xFFFFFFFF
MASK64 = 0xFFFFFFFFFFFFFFFF
#: The two multipliers of the 64-bit finaliser.
MIX_1 = 0xFF51AFD7ED558CCD
MIX_2 = 0xC4CEB9FE1A85EC53
#: Increment and multipliers of the splitmix generator.
SPLIT_GAMMA = 0x9E3779B97F4A7C15
SPLIT_1 = 0xBF58476D1CE4E5B9
SPLIT_2 = 0x94D049BB133111EB


def signed(x: int) -> int:
    """The long with the bits of an unsigned 64-bit integer."""
    x &= MASK64
    return x - (1 << 64) if x >> 63 else x


def lit64(x: int) -> Column:
    return F.lit(signed(x)).cast("long")


def ushr(x: Column, n: int) -> Column:
    return F.shiftrightunsigned(x, n)


def low32(x: Column) -> Column:
    return x.bitwiseAND(F.lit(MASK32).cast("long"))


def add64(x: Column, y: Column) -> Column:
    """x + y modulo 2^64."""
    low = low32(x) + low32(y)
    high = low32(ushr(x, 32) + ushr(y, 32) + ushr(low, 32))
    return F.shiftleft(high, 32).bitwiseOR(low32(low))


def mul64(x: Column, c: int) -> Column:
    """x * c modulo 2^64, for a constant c: 16-bit limbs of x, 32-bit halves of c."""
    c &= MASK64
    ch, cl = F.lit(c >> 32).cast("long"), F.lit(c & MASK32).cast("long")
    m16 = F.lit(0xFFFF).cast("long")
    limb = [(ushr(x, 16 * i) if i else x).bitwiseAND(m16) for i in range(4)]
    p = [v * cl for v in limb]
    low = low32(p[0]) + F.shiftleft(p[1].bitwiseAND(m16), 16)
    high = (
        ushr(p[0], 32) + ushr(p[1], 16) + p[2] + F.shiftleft(p[3].bitwiseAND(m16), 16)
        + limb[0] * ch + F.shiftleft((limb[1] * ch).bitwiseAND(m16), 16) + ushr(low, 32)
    )
    return F.shiftleft(low32(high), 32).bitwiseOR(low32(low))


def mul_small(x: Column, c: int) -> Column:
    """x * c modulo 2^64 for 0 <= c < 2^31."""
    k = F.lit(c).cast("long")
    low = low32(x) * k
    high = low32(low32(ushr(x, 32)) * k + ushr(low, 32))
    return F.shiftleft(high, 32).bitwiseOR(low32(low))


def mul_low(x: Column, c: int) -> Column:
    """Low 32 bits of x * c, for x and c under 2^32: c in halves, so that no product passes 2^48."""
    m16 = F.lit(0xFFFF).cast("long")
    return low32(x * F.lit(c & 0xFFFF).cast("long") + F.shiftleft((x * F.lit(c >> 16).cast("long")).bitwiseAND(m16), 16))


def power_low(x: Column, c: int, n: int) -> Column:
    """Low 32 bits of x * c^n."""
    return mul_low(x, pow(c, n, 1 << 32))


def ushr_by(x: Column, n: Column) -> Column:
    """x >>> n for a column n."""
    return F.call_function("shiftrightunsigned", x, n.cast("int"))


def never_null(x: Column) -> Column:
    """x, declared without nulls, for keys of joins and groups after nulls were filtered.

    The planner filters nullable join keys at their source and would write the whole
    derivation of the key out as a filter there."""
    return F.coalesce(x, F.lit(0).cast("long"))


def rotl64(x: Column, n: int) -> Column:
    n %= 64
    return F.shiftleft(x, n).bitwiseOR(ushr(x, 64 - n)) if n else x


def _xorshift(x: Column, n: int) -> Column:
    return x.bitwiseXOR(ushr(x, n))


def _with_product(df, t: str, c: int):
    """``df`` with its column ``t`` times c modulo 2^64, in steps, so that no part is written out twice."""
    m16, ch, cl = F.lit(0xFFFF).cast("long"), F.lit(c >> 32).cast("long"), F.lit(c & MASK32).cast("long")
    names = [f"{t}_{i}" for i in range(8)]
    a, b, x, y, p0, p1, high, low = names
    col = F.col
    df = df.withColumns({a: col(t).bitwiseAND(m16), b: ushr(col(t), 16).bitwiseAND(m16), x: ushr(col(t), 32).bitwiseAND(m16), y: ushr(col(t), 48)})
    df = df.withColumns({
        p0: col(a) * cl, p1: col(b) * cl,
        high: col(x) * cl + F.shiftleft((col(y) * cl).bitwiseAND(m16), 16) + col(a) * ch + F.shiftleft((col(b) * ch).bitwiseAND(m16), 16),
    })
    df = df.withColumn(low, low32(col(p0)) + F.shiftleft(col(p1).bitwiseAND(m16), 16))
    high_sum = ushr(col(p0), 32) + ushr(col(p1), 16) + col(high) + ushr(col(low), 32)
    return df.withColumn(t, F.shiftleft(high_sum, 32).bitwiseOR(low32(col(low)))).drop(*names)


def murmur64(df, key: str, out: str, seed: int = 0):
    """``df`` with the column ``out``: the 64-bit finaliser of ``key + seed``; null for null.

    The steps are columns of their own: expressions that name a step twice would write out
    all before it twice, and compiled code has a size limit.
    """
    t = f"__{out}"
    df = df.withColumn(t, F.col(key).cast("long"))
    if seed:
        df = df.withColumn(t, add64(F.col(t), lit64(seed)))
    for c in (MIX_1, MIX_2):
        df = _with_product(df.withColumn(t, _xorshift(F.col(t), 33)), t, c)
    return df.withColumn(out, _xorshift(F.col(t), 33)).drop(t)


def unmurmur64(df, h: str, out: str, seed: int = 0):
    """``df`` with the column ``out``: the key that ``murmur64`` makes ``h`` of; in steps for the same reason."""
    t = f"__{out}"
    df = df.withColumn(t, F.col(h))
    for c in (MIX_2, MIX_1):
        # the shift is over half the width, so it undoes itself
        df = _with_product(df.withColumn(t, _xorshift(F.col(t), 33)), t, pow(c, -1, 1 << 64))
    df = df.withColumn(t, _xorshift(F.col(t), 33))
    return df.withColumn(out, add64(F.col(t), lit64(-seed)) if seed else F.col(t)).drop(t)


def with_multiples(df, base: str, step: str, names: list[str]):
    """``df`` with columns ``base + i * step`` modulo 2^64, for i from 0, in steps."""
    low, high = [f"{n}_l" for n in names], [f"{n}_h" for n in names]
    lo, hi = low32(F.col(step)), ushr(F.col(step), 32)
    df = df.withColumns({n: low32(F.col(base)) + lo * i for i, n in enumerate(low)} | {n: ushr(F.col(base), 32) + hi * i for i, n in enumerate(high)})
    # the low sum may pass 2^36, and what passes 2^32 goes over to the high one, whose upper bits the shift drops
    return df.withColumns({n: F.shiftleft(F.col(h) + ushr(F.col(x), 32), 32).bitwiseOR(low32(F.col(x))) for n, x, h in zip(names, low, high, strict=True)}).drop(*low, *high)


def reduce32(h: Column, n: Column | int) -> Column:
    """(low 32 bits of h * n) >> 32: a number from 0 to n - 1, for n < 2^31."""
    n = F.lit(n).cast("long") if isinstance(n, int) else n
    return ushr(low32(h) * n, 32)


def fastrange64(h: Column, n: Column | int) -> Column:
    """(h * n) >> 64 for n < 2^31."""
    n = F.lit(n).cast("long") if isinstance(n, int) else n
    return ushr(low32(ushr(h, 32)) * n + ushr(low32(h) * n, 32), 32)


mulhi = fastrange64


def multiply_shift(h: Column, mul_high: int, mul_low: int, add_high: int, add_low: int) -> Column:
    """The high half of ``add + mul * h`` in 128 bits, for a 128-bit multiplier and addend."""
    # mul * h = (mul_high * h << 64) + mul_low * h; its high half is mul_high * h + hi(mul_low * h), plus the carry of the low halves
    low = mul64(h, mul_low)
    total = add64(low, lit64(add_low))
    carry = F.when(_less_unsigned(total, lit64(add_low)), 1).otherwise(0).cast("long")
    return add64(add64(mul64(h, mul_high), _mulhi_constant(h, mul_low)), add64(lit64(add_high), carry))


def _less_unsigned(x: Column, y: Column) -> Column:
    top = lit64(1 << 63)
    return x.bitwiseXOR(top) < y.bitwiseXOR(top)


def _mulhi_constant(x: Column, c: int) -> Column:
    """High 64 bits of x * c, by 32-bit halves whose products are split again."""
    def product(a: Column, b: int) -> tuple[Column, Column]:
        """High and low 32 bits of a 32-bit column times a 32-bit constant."""
        m16 = F.lit(0xFFFF).cast("long")
        p0, p1 = a.bitwiseAND(m16) * F.lit(b).cast("long"), ushr(a, 16) * F.lit(b).cast("long")
        low = low32(p0) + F.shiftleft(p1.bitwiseAND(m16), 16)
        return ushr(p0, 32) + ushr(p1, 16) + ushr(low, 32), low32(low)

    xh, xl, ch, cl = low32(ushr(x, 32)), low32(x), c >> 32 & MASK32, c & MASK32
    (hh_h, hh_l), (hl_h, hl_l), (lh_h, lh_l), (ll_h, _) = product(xh, ch), product(xh, cl), product(xl, ch), product(xl, cl)
    middle = hl_l + lh_l + ll_h
    low = hh_l + hl_h + lh_h + ushr(middle, 32)
    high = low32(hh_h + ushr(low, 32))
    return F.shiftleft(high, 32).bitwiseOR(low32(low))


# --- numpy ---------------------------------------------------------------------------------


def np_u64(x) -> np.ndarray:
    x = np.asarray(x)
    return x.view(np.uint64) if x.dtype == np.int64 else x.astype(np.uint64)


def np_murmur64(keys: np.ndarray, seed: int = 0) -> np.ndarray:
    h = np_u64(keys) + np.uint64(seed & MASK64)
    for c in (MIX_1, MIX_2):
        h = (h ^ h >> np.uint64(33)) * np.uint64(c)
    return h ^ h >> np.uint64(33)


def np_rotl64(h: np.ndarray, n: int) -> np.ndarray:
    n %= 64
    return h << np.uint64(n) | h >> np.uint64(64 - n) if n else h


def np_reduce32(h: np.ndarray, n: int) -> np.ndarray:
    return ((h & np.uint64(MASK32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def np_fastrange64(h: np.ndarray, n: int) -> np.ndarray:
    """(h * n) >> 64 for n < 2^32."""
    n = np.uint64(n)
    return ((h >> np.uint64(32)) * n + ((h & np.uint64(MASK32)) * n >> np.uint64(32)) >> np.uint64(32)).astype(np.int64)


def splitmix64(state: int) -> tuple[int, int]:
    """The next state and output of the generator that reseeds failed builds."""
    state = (state + SPLIT_GAMMA) & MASK64
    z = state
    z = (z ^ z >> 30) * SPLIT_1 & MASK64
    z = (z ^ z >> 27) * SPLIT_2 & MASK64
    return state, z ^ z >> 31


def reseed(seed: int, attempt: int) -> int:
    """The seed of a build's attempt; the first keeps the seed."""
    state, value = seed & MASK64, seed & MASK64
    for _ in range(attempt):
        state, value = splitmix64(state)
    return value


def np_reverse_bits(x: np.ndarray) -> np.ndarray:
    x = np_u64(x).copy()
    for shift, mask in ((1, 0x5555555555555555), (2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F)):
        s, m = np.uint64(shift), np.uint64(mask)
        x = (x >> s & m) | (x & m) << s
    return x.byteswap()


def reverse_bits(x: Column) -> Column:
    """The 64 bits of x in reverse order."""
    for shift, mask in ((1, 0x5555555555555555), (2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF)):
        x = ushr(x, shift).bitwiseAND(lit64(mask)).bitwiseOR(F.shiftleft(x.bitwiseAND(lit64(mask)), shift))
    return F.shiftleft(x, 32).bitwiseOR(ushr(x, 32))


def mix32(h: np.ndarray) -> np.ndarray:
    return (h ^ h >> np.uint64(32)) & np.uint64(MASK32)


def parity(x: Column) -> Column:
    return F.bit_count(x) % 2


def floor_log2(n: int) -> int:
    return n.bit_length() - 1


# --- DuckDB --------------------------------------------------------------------------------

_TWO64 = "18446744073709551616::UHUGEINT"


def sql_u64(x: str) -> str:
    """A BIGINT expression as the UBIGINT of the same bits."""
    return f"((({x})::HUGEINT + 18446744073709551616::HUGEINT) % 18446744073709551616::HUGEINT)::UBIGINT"


def sql_i64(x: str) -> str:
    """A UBIGINT expression as the BIGINT of the same bits."""
    return f"(CASE WHEN ({x}) > 9223372036854775807::UBIGINT THEN (({x})::HUGEINT - 18446744073709551616::HUGEINT)::BIGINT ELSE ({x})::BIGINT END)"


def sql_mul(x: str, c: int) -> str:
    return f"((({x})::UHUGEINT * {c}::UHUGEINT) % {_TWO64})::UBIGINT"


def sql_add(x: str, y: str) -> str:
    return f"((({x})::UHUGEINT + ({y})::UHUGEINT) % {_TWO64})::UBIGINT"


def sql_rotl(x: str, n: int) -> str:
    return f"(((({x})::UHUGEINT * {1 << n}::UHUGEINT) % {_TWO64})::UBIGINT | (({x}) >> {64 - n}))"


def sql_range64(x: str, n: int | str) -> str:
    return f"((({x})::UHUGEINT * ({n})::UHUGEINT) >> 64)::BIGINT"


def sql_reduce32(x: str, n: int | str) -> str:
    return f"((({x} & {MASK32}::UBIGINT)::UHUGEINT * ({n})::UHUGEINT) >> 32)::BIGINT"


def sql_hashes(keys: str, seed: int = 0, name: str = "h") -> str:
    """CTEs that end in ``name`` (all columns of the query ``keys``, which has a column key, and h UBIGINT)."""
    return f"""{name}_0 AS ({keys}),
{name}_1 AS (SELECT *, {sql_add(sql_u64("key"), f"{seed & MASK64}::UBIGINT")} AS h0 FROM {name}_0),
{name}_2 AS (SELECT * EXCLUDE (h0), {sql_mul("xor(h0, h0 >> 33)", MIX_1)} AS h1 FROM {name}_1),
{name}_3 AS (SELECT * EXCLUDE (h1), {sql_mul("xor(h1, h1 >> 33)", MIX_2)} AS h2 FROM {name}_2),
{name} AS (SELECT * EXCLUDE (h2), xor(h2, h2 >> 33) AS h FROM {name}_3)"""
