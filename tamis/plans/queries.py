"""Queries over the test tables, each with DuckDB SQL for the same rows.

Positions, words, counts and false-positive sets are computed again in SQL from the same
hash.  Kinds built by Python workers are asked for what is exact by contract: every added
key is found, the size follows the formula, the rate stays under a bound, and prefiltered
joins equal plain ones.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.functions import hashing as H
from tamis.functions import sizing as S
from tamis.operators import bloom, counting, joins, quotient, sharded, sorted_sets
from tamis.plans import benchmark, catalog
from tamis.sources import keys as source
from tamis.streaming import queries as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
#: Added to keys for probes that are surely absent.
AWAY = 10_000_000


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return put


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def urgent(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("key"))


def order_keys(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("key"))


URGENT = "SELECT o_orderkey AS key FROM orders WHERE o_orderpriority = '1-URGENT'"
FAR = f"SELECT o_orderkey + {AWAY} AS key FROM orders"
N = f"(SELECT greatest(count(DISTINCT key), 1) FROM ({URGENT}))"


def distinct_count(df: DataFrame) -> int:
    return max(1, df.distinct().count())


# --- hashing -------------------------------------------------------------------------------


@query("hash_murmur64", f"WITH {H.sql_hashes('SELECT o_orderkey AS key FROM orders', 17)} SELECT key, {H.sql_i64('h')} AS h FROM h")
def _(spark: SparkSession, d: str) -> DataFrame:
    return H.murmur64(order_keys(spark, d), "key", "h", 17)


MS = (0x0123456789ABCDEF, 0xFEDCBA9876543211, 0x1111111122222222, 0xF000000000000003)
_low = f"((h::UHUGEINT * {MS[1]}::UHUGEINT) % 18446744073709551616::UHUGEINT + {MS[3]}::UHUGEINT)"
_ms = H.sql_add(H.sql_add(H.sql_mul("h", MS[0]), f"((h::UHUGEINT * {MS[1]}::UHUGEINT) >> 64)"), f"({MS[2]}::UHUGEINT + ({_low} >> 64))")


@query(
    "hash_ranges",
    f"""WITH {H.sql_hashes('SELECT o_orderkey AS key FROM orders')}
SELECT key, {H.sql_i64(H.sql_rotl('h', 21))} AS rotated, {H.sql_reduce32('h', 1000003)} AS reduced, {H.sql_range64('h', 1000003)} AS ranged,
       bit_count(h)::INT AS ones, (bit_count(h) % 2)::INT AS odd, {H.sql_i64(_ms)} AS shifted,
       {H.sql_i64("list_reduce(list_transform(range(64), lambda i: (((h >> i::UBIGINT) & 1)::UBIGINT << (63 - i)::UBIGINT)), lambda a, b: a | b)::UBIGINT")} AS reversed
FROM h""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    h = F.col("h")
    return H.murmur64(order_keys(spark, d), "key", "h").select(
        "key", H.rotl64(h, 21).alias("rotated"), H.reduce32(h, 1000003).alias("reduced"), H.fastrange64(h, 1000003).alias("ranged"),
        F.bit_count(h).alias("ones"), H.parity(h).alias("odd"), H.multiply_shift(h, *MS).alias("shifted"), H.reverse_bits(h).alias("reversed"),
    )


# --- Bloom family --------------------------------------------------------------------------

M = H.MASK32


def _bit(b: str) -> str:
    return f"(1::UBIGINT << ({b})::UBIGINT)"


def bloom_sql(kind: str, bits: int, keys: str, name: str) -> tuple[str, str, int]:
    """CTEs ``{name}`` (key, block, w0..) of the probes of ``keys``, the filter's block count as SQL, and the lanes."""
    s = bloom.spec(kind, 1000, bits)
    blocks = {
        "classic": f"greatest((n * {bits} + 63) // 64, 1)", "legacy": f"greatest((n * {bits} + 63) // 64, 1)",
        "simple": "(n * 10) // 64 + 8", "block32": "greatest(n // 24, 1)", "block64": "greatest(n // 50, 1)", "lanes16": "greatest(n // 10, 1)", "bytes16": "greatest(n // 10, 1)",
        "line": f"greatest((n * {bits} + 511) // 512, 1)", "legacy_line": f"greatest((n * {bits} + 511) // 512, 1)",
        "block32_pow2": f"(1::BIGINT << greatest(1, length(bin(n * {bits})) - 8)::BIGINT)",
    }[kind]
    head = f"{H.sql_hashes(keys, 0, name + '_h')},\n{name}_s AS (SELECT {blocks} AS blocks FROM (SELECT {N} AS n))"
    zero = "0::UBIGINT"
    if kind in ("classic", "legacy"):
        if kind == "classic":
            at = H.sql_add(H.sql_rotl("h", 32), "((h::UHUGEINT * i::UHUGEINT) % 18446744073709551616::UHUGEINT)")
            block, bit = H.sql_range64("x", "blocks"), "x & 63"
        else:
            at = f"(((h & {M}) + (h >> 32) * i::UBIGINT) & {M}) % (blocks * 64)::UBIGINT"
            block, bit = "(x >> 6)::BIGINT", "x & 63"
        return f"{head},\n{name}_x AS (SELECT key, blocks, {at} AS x FROM {name}_h, {name}_s, range({s.probes}) AS r(i)),\n{name} AS (SELECT key, {block} AS block, {_bit(bit)} AS w0 FROM {name}_x)", blocks, 1
    rot = "h >> 32"
    block = {
        "simple": H.sql_range64(H.sql_rotl("h", 32), "blocks"),
        "block32_pow2": "(h & (blocks - 1)::UBIGINT)::BIGINT",
        "line": H.sql_reduce32("h", "blocks"), "legacy_line": H.sql_reduce32("h", "blocks"),
    }.get(kind, f"(((({rot}) & {M})::UHUGEINT * blocks::UHUGEINT) >> 32)::BIGINT")
    if kind == "simple":
        lanes = [f"({_bit('h & 63')} | {_bit('(h >> 8) & 63')})"]
    elif kind in ("line", "legacy_line"):
        at = [f"((((h >> 32) * {pow(bloom.GOLDEN32, i + 1, 1 << 32)}::UBIGINT) & {M}) >> 23)" if kind == "line" else f"((((h >> 32) + ((h >> 49) | (((h >> 32) * 32768::UBIGINT) & {M})) * {i}::UBIGINT) & {M}) >> 23)" for i in range(s.probes)]
        lanes = [" | ".join(f"(CASE WHEN ({a} >> 6) = {lane} THEN {_bit(f'{a} & 63')} ELSE {zero} END)" for a in at) for lane in range(8)]
    else:
        x = f"((h >> (length(bin(blocks)) - 1)::UBIGINT) & {M})" if kind == "block32_pow2" else f"(h & {M})"
        top = {"block32": 27, "block32_pow2": 27, "block64": 26, "lanes16": 28, "bytes16": 29}[kind]
        one = [_bit(f"(({x} * {salt}::UBIGINT) & {M}) >> {top}") for salt in bloom.SALTS]
        lanes = [f"(CASE WHEN ({x} >> 31) = {i // 8} THEN {one[i % 8]} ELSE {zero} END)" for i in range(16)] if kind == "bytes16" else one
    columns = ", ".join(f"{lane} AS w{i}" for i, lane in enumerate(lanes))
    return f"{head},\n{name} AS (SELECT key, {block} AS block, {columns} FROM {name}_h, {name}_s)", blocks, len(lanes)


BLOOMS = [("classic", 8), ("classic", 12), ("classic", 16), ("simple", 10), ("block32", 10), ("block32_pow2", 10), ("block64", 10), ("lanes16", 10), ("bytes16", 10), ("line", 10), ("legacy", 10), ("legacy_line", 10)]


def _bloom(spark: SparkSession, d: str, kind: str, bits: int) -> tuple[DataFrame, bloom.BloomSpec]:
    keys = urgent(spark, d)
    s = bloom.spec(kind, distinct_count(keys), bits)
    return bloom.build(keys, "key", s), s


def _words(spark: SparkSession, d: str, kind: str, bits: int) -> DataFrame:
    return _bloom(spark, d, kind, bits)[0]


def _false_positives(spark: SparkSession, d: str, kind: str, bits: int) -> DataFrame:
    f, s = _bloom(spark, d, kind, bits)
    return bloom.semi_join(order_keys(spark, d).select((F.col("key") + AWAY).alias("key")), "key", f, s)


for _kind, _bits in BLOOMS:
    _cte, _, _lanes = bloom_sql(_kind, _bits, URGENT, "a")
    _agg = ", ".join(f"bit_or(w{i}) AS w{i}" for i in range(_lanes))
    _out = ", ".join(f"{H.sql_i64(f'w{i}')} AS w{i}" for i in range(_lanes))
    _name = f"{_kind}{_bits}" if _kind == "classic" else _kind
    query(f"bloom_words_{_name}", f"WITH {_cte}, f AS (SELECT block, {_agg} FROM a GROUP BY block) SELECT block, {_out} FROM f")(partial(_words, kind=_kind, bits=_bits))
    _far, _, _ = bloom_sql(_kind, _bits, FAR, "p")
    _hit = " AND ".join(f"(coalesce(f.w{i}, 0) & p.w{i}) = p.w{i}" for i in range(_lanes))
    query(
        f"bloom_false_positives_{_name}",
        f"WITH {_cte}, f AS (SELECT block, {_agg} FROM a GROUP BY block),\n{_far}\nSELECT key FROM p LEFT JOIN f USING (block) GROUP BY key HAVING bool_and({_hit})",
    )(partial(_false_positives, kind=_kind, bits=_bits))


@query("bloom_merge", ORACLE_SQL["bloom_words_block32"])
def _(spark: SparkSession, d: str) -> DataFrame:
    keys = urgent(spark, d)
    s = bloom.spec("block32", distinct_count(keys))
    return bloom.merge(*(bloom.build(keys.where(F.col("key") % 3 == i), "key", s) for i in range(3)))


@query("bloom_probe_array", ORACLE_SQL["bloom_false_positives_classic12"])
def _(spark: SparkSession, d: str) -> DataFrame:
    f, s = _bloom(spark, d, "classic", 12)
    probes = order_keys(spark, d).select((F.col("key") + AWAY).alias("key"))
    return bloom.might_contain(probes, "key", f, s).where("maybe").select("key")


_cte12 = bloom_sql("classic", 12, URGENT, "a")[0]


@query(
    "bloom_rate",
    f"""WITH {_cte12}, f AS (SELECT block, bit_or(w0) AS w0 FROM a GROUP BY block),
{bloom_sql("classic", 12, FAR, "p")[0]},
m AS (SELECT key, bool_and((coalesce(f.w0, 0) & p.w0) = p.w0) AS maybe FROM p LEFT JOIN f USING (block) GROUP BY key)
SELECT count(*) AS negatives, coalesce(sum(maybe::BIGINT), 0)::BIGINT AS found, coalesce(sum(maybe::BIGINT), 0)::DOUBLE / count(*) AS rate FROM m""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    f = catalog.ALGORITHMS[41].build(urgent(spark, d), "key")
    return benchmark.false_positive_rate(f, order_keys(spark, d).select((F.col("key") + AWAY).alias("key")), urgent(spark, d))


# --- joins ---------------------------------------------------------------------------------

SEMI = f"SELECT l_returnflag, count(*) AS lines, round(sum(l_extendedprice), 2) AS price FROM lineitem WHERE l_orderkey IN ({URGENT}) GROUP BY l_returnflag"


def _lines(df: DataFrame) -> DataFrame:
    return df.groupBy("l_returnflag").agg(F.count("*").alias("lines"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


@query("semi_join_bloom12", SEMI)
def flagship(spark: SparkSession, d: str) -> DataFrame:
    f = catalog.ALGORITHMS[44].build(urgent(spark, d), "key")
    return _lines(joins.prefiltered_semi_join(read(spark, d, "lineitem"), urgent(spark, d), "l_orderkey", "key", f))


def _semi(spark: SparkSession, d: str, number: int) -> DataFrame:
    f = catalog.ALGORITHMS[number].build(urgent(spark, d), "key")
    return _lines(joins.prefiltered_semi_join(read(spark, d, "lineitem"), urgent(spark, d), "l_orderkey", "key", f))


for _number in (0, 12, 20, 36, 51, 60, 116, 1086, 3086):
    query(f"semi_join_alg{_number}", SEMI)(partial(_semi, number=_number))


@query("anti_join", f"SELECT count(*) AS lines, round(sum(l_extendedprice), 2) AS price FROM lineitem WHERE l_orderkey NOT IN ({URGENT})")
def _(spark: SparkSession, d: str) -> DataFrame:
    f = catalog.ALGORITHMS[51].build(urgent(spark, d), "key")
    out = joins.prefiltered_anti_join(read(spark, d, "lineitem"), urgent(spark, d), "l_orderkey", "key", f)
    return out.agg(F.count("*").alias("lines"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


@query(
    "inner_join",
    "SELECT o_orderpriority, count(*) AS lines, round(sum(l_quantity), 2) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT' GROUP BY o_orderpriority",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    orders = read(spark, d, "orders").where("o_orderpriority = '1-URGENT'")
    f = catalog.ALGORITHMS[51].build(urgent(spark, d), "key")
    return joins.prefiltered_join(read(spark, d, "lineitem"), orders, "l_orderkey", "o_orderkey", f).groupBy("o_orderpriority").agg(F.count("*").alias("lines"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("left_join", f"SELECT count(*) AS rows, count(l_orderkey) AS matched, round(sum(l_quantity), 2) AS quantity FROM ({URGENT}) LEFT JOIN lineitem ON key = l_orderkey")
def _(spark: SparkSession, d: str) -> DataFrame:
    f = catalog.ALGORITHMS[51].build(urgent(spark, d), "key")
    out = joins.prefiltered_join(urgent(spark, d), read(spark, d, "lineitem"), "key", "l_orderkey", f, "left")
    return out.agg(F.count("*").alias("rows"), F.count("l_orderkey").alias("matched"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("optimized_semi_join", SEMI)
def _(spark: SparkSession, d: str) -> DataFrame:
    return _lines(joins.optimize_semi_join(read(spark, d, "lineitem"), urgent(spark, d), "l_orderkey", "key", broadcast_keys=100))


@query("first_seen", "SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id")
def _(spark: SparkSession, d: str) -> DataFrame:
    return joins.first_seen(read(spark, d, "events").select("user_id", "event_id"), "user_id", "event_id")


@query("string_keys", "SELECT count(*) AS pages FROM pages WHERE url IS NOT NULL")
def _(spark: SparkSession, d: str) -> DataFrame:
    pages = sharded.as_key(read(spark, d, "pages"), "url")
    f = catalog.ALGORITHMS[116].build(pages, "key")
    return f.semi_join(pages, "key").agg(F.count("*").alias("pages"))


# --- counting ------------------------------------------------------------------------------

SUPP = "SELECT l_suppkey AS key FROM lineitem"
COUNTING_N = f"(SELECT greatest(count(DISTINCT key), 1) FROM ({SUPP}))"


def counting_sql(kind: str, keys: str, name: str, weight: str = "1") -> str:
    """CTEs that end in ``{name}`` (key, weight, pos): the counters of each key, written out."""
    k = S.bloom_probes(10)
    size = {"counting": "greatest(4 * n * 10 // 64, 1)", "succinct": "(n * 10 + 63) // 64", "blocked": "greatest(n * 10 // 512, 1)"}[kind]
    if kind == "counting":
        x = f"(((h >> 32) + (h & {M}) * i::UBIGINT) & {M})"
        pos = f"({H.sql_reduce32('x', 'size')} * 16 + (x & 15)::BIGINT)"
    elif kind == "succinct":
        x = H.sql_add(H.sql_rotl("h", 32), "((h::UHUGEINT * i::UHUGEINT) % 18446744073709551616::UHUGEINT)")
        pos = f"({H.sql_range64('x', 'size')} * 64 + (x & 63)::BIGINT)"
    else:
        x = "(((h & 65535) + (((h >> 16) & 65535) | 1) * i::UBIGINT) & 511)"
        pos = "((((h >> 32)::UHUGEINT * size::UHUGEINT) >> 32)::BIGINT * 512 + x::BIGINT)"
    return f"""{H.sql_hashes(keys, 0, name + "_h")}, {name}_s AS (SELECT {size} AS size FROM (SELECT {COUNTING_N} AS n)),
{name}_x AS (SELECT key, h, size, {x} AS x FROM {name}_h, {name}_s, range({k}) AS r(i)),
{name} AS (SELECT key, {weight} AS weight, {pos} AS pos FROM {name}_x)"""


def _supp(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").select(F.col("l_suppkey").alias("key"))


def _counts(spark: SparkSession, d: str, kind: str) -> tuple[DataFrame, counting.CountingSpec]:
    s = counting.spec(kind, distinct_count(_supp(spark, d)))
    return counting.build(_supp(spark, d), "key", s), s


def _counters(spark: SparkSession, d: str, kind: str) -> DataFrame:
    return _counts(spark, d, kind)[0]


def _removed(spark: SparkSession, d: str, kind: str) -> DataFrame:
    f, s = _counts(spark, d, kind)
    gone = read(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("key"))
    return counting.remove(f, gone, "key", s)


def _estimates(spark: SparkSession, d: str, kind: str) -> DataFrame:
    f, s = _counts(spark, d, kind)
    probes = read(spark, d, "supplier").select(F.col("s_suppkey").alias("key"))
    return counting.read_count(probes.unionByName(probes.select((F.col("key") + AWAY).alias("key"))), "key", f, s)


def _emptied(spark: SparkSession, d: str, kind: str) -> DataFrame:
    f, s = _counts(spark, d, kind)
    return counting.remove(f, _supp(spark, d), "key", s).agg(F.count("*").alias("counters"))


for _kind in ("counting", "succinct", "blocked", "blocked_rank"):
    _sql_kind = "blocked" if _kind == "blocked_rank" else _kind
    _built = f"{counting_sql(_sql_kind, SUPP, 'a')}, f AS (SELECT pos, sum(weight)::BIGINT AS count FROM a GROUP BY pos)"
    query(f"counting_counters_{_kind}", f"WITH {_built} SELECT pos, count FROM f")(partial(_counters, kind=_kind))
    _less = counting_sql(_sql_kind, "SELECT l_suppkey AS key FROM lineitem WHERE l_returnflag = 'R'", "b", "-1")
    query(f"counting_remove_{_kind}", f"WITH {_built}, {_less} SELECT pos, sum(weight)::BIGINT AS count FROM (SELECT pos, weight FROM a UNION ALL SELECT pos, weight FROM b) GROUP BY pos HAVING sum(weight) <> 0")(partial(_removed, kind=_kind))
    _probe = counting_sql(_sql_kind, f"SELECT s_suppkey AS key FROM supplier UNION ALL SELECT s_suppkey + {AWAY} FROM supplier", "p")
    query(f"counting_read_{_kind}", f"WITH {_built}, {_probe} SELECT key, min(coalesce(f.count, 0))::BIGINT AS estimate FROM p LEFT JOIN f USING (pos) GROUP BY key")(partial(_estimates, kind=_kind))
    query(f"counting_remove_all_{_kind}", "SELECT 0::BIGINT AS counters")(partial(_emptied, kind=_kind))


# --- counting quotient filter --------------------------------------------------------------

def _cqf(spark: SparkSession, d: str, **more) -> quotient.QuotientSpec:
    """A size for the table's distinct users."""
    return quotient.spec(distinct_count(read(spark, d, "events").select("user_id").dropna()), **more)


#: The same in SQL: log2 of the slots, and the mask of a hash.
QBITS = "(SELECT min(q) FROM range(1, 50) r(q), (SELECT greatest(count(DISTINCT user_id), 1) AS n FROM events) WHERE 0.9 * (1::BIGINT << q) >= n)"
MASK = f"((1::BIGINT << ({QBITS} + 8)) - 1)"


def _qf(spark: SparkSession, d: str, where: str = "true", s: quotient.QuotientSpec | None = None) -> DataFrame:
    return quotient.build(read(spark, d, "events").where(where), "user_id", s or _cqf(spark, d))


def _qfs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two filters with one spec; together they have all events."""
    s = _cqf(spark, d)
    return _qf(spark, d, A, s), _qf(spark, d, B, s)


def qf_sql(where: str, name: str, mask: bool = True) -> str:
    h = f"(h & {MASK}::UBIGINT)::BIGINT" if mask else H.sql_i64("h")
    return f"{H.sql_hashes(f'SELECT user_id AS key FROM events WHERE {where}', 0, name + '_h')}, {name} AS (SELECT {h} AS hash, 0::BIGINT AS value, count(*) AS count FROM {name}_h GROUP BY 1)"


TYPES = ("click", "error", "purchase", "signup", "view")
A, B = "event_type IN ('click', 'error', 'purchase')", "coalesce(event_type, '') NOT IN ('click', 'error')"
AB = f"{qf_sql(A, 'a')}, {qf_sql(B, 'b')}"


@query("cqf_build", f"WITH {qf_sql('true', 'a')} SELECT hash, value, count FROM a")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _qf(spark, d)


@query("cqf_build_invertible", "SELECT user_id AS key, count(*) AS count FROM events GROUP BY user_id")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = _cqf(spark, d, mode="invertible", seed=9)
    f = quotient.build(read(spark, d, "events"), "user_id", s)
    return quotient.with_original_key(f, s).select("key", "count")


@query("cqf_build_none", f"SELECT (user_id & {MASK}) AS hash, 0::BIGINT AS value, count(*) AS count FROM events GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return quotient.build(read(spark, d, "events"), "user_id", _cqf(spark, d, mode="none"))


@query("cqf_values", f"WITH {H.sql_hashes('SELECT user_id AS key, length(event_type) AS v, event_id FROM events')} SELECT (h & {MASK}::UBIGINT)::BIGINT AS hash, v::BIGINT AS value, sum(event_id % 5 + 1)::BIGINT AS count FROM h GROUP BY 1, 2")
def _(spark: SparkSession, d: str) -> DataFrame:
    return quotient.build(read(spark, d, "events"), "user_id", _cqf(spark, d), F.length("event_type"), F.col("event_id") % 5 + 1)


@query("cqf_merge", f"WITH {AB} SELECT hash, value, sum(count)::BIGINT AS count FROM (FROM a UNION ALL FROM b) GROUP BY ALL")
def _(spark: SparkSession, d: str) -> DataFrame:
    return quotient.merge(*_qfs(spark, d))


@query("cqf_multi_merge", f"WITH {qf_sql('true', 'a')} SELECT hash, value, count FROM a")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = _cqf(spark, d)
    others = _qf(spark, d, f"event_type IS NULL OR event_type NOT IN {TYPES}", s)
    return quotient.merge(*(_qf(spark, d, f"event_type = '{t}'", s) for t in TYPES), others)


@query("cqf_insert", f"WITH {AB} SELECT hash, value, sum(count)::BIGINT AS count FROM (FROM a UNION ALL FROM b) GROUP BY ALL")
def _(spark: SparkSession, d: str) -> DataFrame:
    return quotient.insert(*_qfs(spark, d))


@query("cqf_set_count", f"WITH {AB} SELECT hash, value, coalesce(b.count, a.count) AS count FROM a FULL JOIN b USING (hash, value)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return quotient.set_count(*_qfs(spark, d))


@query("cqf_remove", f"WITH {AB} SELECT hash, value, a.count - coalesce(b.count, 0) AS count FROM a LEFT JOIN b USING (hash, value) WHERE a.count > coalesce(b.count, 0)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return quotient.remove(*_qfs(spark, d))


LEFT = "SELECT c_custkey AS key FROM customer WHERE c_mktsegment = 'BUILDING'"


@query("cqf_delete", f"WITH {qf_sql('true', 'a')}, {H.sql_hashes(LEFT, 0, 'p')}, b AS (SELECT (h & {MASK}::UBIGINT)::BIGINT AS hash, 0::BIGINT AS value FROM p) SELECT hash, value, count FROM a ANTI JOIN b USING (hash, value)")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = _cqf(spark, d)
    left = read(spark, d, "customer").where("c_mktsegment = 'BUILDING'")
    return quotient.delete(_qf(spark, d, s=s), quotient.build(left, "c_custkey", s))


@query("cqf_count", f"WITH {qf_sql('true', 'a')}, {H.sql_hashes('SELECT c_custkey AS key FROM customer', 0, 'p')} SELECT key, coalesce(count, 0) AS count FROM p LEFT JOIN a ON hash = (h & {MASK}::UBIGINT)::BIGINT")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = _cqf(spark, d)
    return quotient.count_key_value(read(spark, d, "customer").select(F.col("c_custkey").alias("key")), "key", _qf(spark, d, s=s), s)


@query("cqf_query", f"WITH {qf_sql('true', 'a')}, {H.sql_hashes('SELECT c_custkey AS key FROM customer', 0, 'p')} SELECT key, value, coalesce(count, 0) AS count, CASE WHEN value IS NULL THEN -3 ELSE 0 END::INT AS status FROM p LEFT JOIN a ON hash = (h & {MASK}::UBIGINT)::BIGINT")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = _cqf(spark, d)
    return quotient.query(read(spark, d, "customer").select(F.col("c_custkey").alias("key")), "key", _qf(spark, d, s=s), s)


@query("cqf_unique_index", f"WITH {qf_sql('true', 'a')} SELECT hash, value, count, hash >> 8 AS quotient, (row_number() OVER (PARTITION BY hash >> 8 ORDER BY hash, value) - 1)::INT AS rank FROM a")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = _cqf(spark, d)
    return quotient.unique_index(_qf(spark, d, s=s), s)


@query("cqf_iterate", f"WITH {qf_sql('true', 'a')} SELECT hash, value, count FROM a WHERE hash >= 1::BIGINT << ({QBITS} + 7) ORDER BY hash, value")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = _cqf(spark, d)
    return quotient.from_position(_qf(spark, d, s=s), 1 << (s.key_bits - 1))


@query(
    "cqf_stats",
    f"""WITH {qf_sql('true', 'a')}, z AS (SELECT {QBITS} AS q), t AS (SELECT count(*) AS pairs, sum(count)::BIGINT AS total FROM a)
SELECT pairs AS distinct_pairs, coalesce(total, 0) AS sum_of_counts, 1::BIGINT << q AS slots, (q + 8)::BIGINT AS key_bits, 0::BIGINT AS value_bits, 8::BIGINT AS remainder_bits, floor((1::BIGINT << q) * 10.125 / 8)::BIGINT AS bytes,
'default' AS hash_mode, 0::BIGINT AS seed, pairs::DOUBLE / (1::BIGINT << q) AS load, CASE WHEN pairs::DOUBLE / (1::BIGINT << q) > 0.95 THEN -1 ELSE 0 END::INT AS status FROM t, z""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    s = _cqf(spark, d)
    return quotient.stats(_qf(spark, d, s=s), s)


@query("cqf_inner_product", f"WITH {AB} SELECT coalesce(sum(a.count * b.count), 0)::BIGINT AS inner_product FROM a JOIN b USING (hash, value)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return quotient.inner_product(*_qfs(spark, d))


@query("cqf_magnitude", f"WITH {qf_sql('true', 'a')} SELECT sqrt(sum(count * count)::DOUBLE) AS magnitude FROM a")
def _(spark: SparkSession, d: str) -> DataFrame:
    return quotient.magnitude(_qf(spark, d))


@query("cqf_intersect", f"WITH {AB} SELECT hash, value, count FROM b SEMI JOIN a USING (hash, value)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return quotient.intersect(*_qfs(spark, d))


@query("cqf_resize", f"WITH {qf_sql('true', 'a')} SELECT hash, value, count, 1::BIGINT << ({QBITS} + 1) AS slots FROM a")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = _cqf(spark, d)
    f, s = quotient.resize(_qf(spark, d, s=s), s, s.quotient_bits + 1)
    return f.withColumn("slots", F.lit(s.slots).cast("long"))


# --- Golomb-coded sets and prefix filters --------------------------------------------------

GCS_VALUES = f"""{H.sql_hashes(URGENT)}, s AS (SELECT greatest((n + 15) // 16, 1) AS buckets FROM (SELECT {N} AS n)),
v AS (SELECT DISTINCT (((h >> 32)::UHUGEINT * buckets::UHUGEINT) >> 32)::BIGINT * 4096 + (h & 4095)::BIGINT AS value FROM h, s)"""


@query(
    "gcs_build",
    f"WITH {GCS_VALUES}, c AS (SELECT value, value // {1024 * 4096} AS chunk FROM v), l AS (SELECT chunk, value, value - coalesce(lag(value) OVER (PARTITION BY chunk ORDER BY value), chunk * {1024 * 4096}) AS delta FROM c) SELECT chunk, value, delta, (delta >> 7) + 8 AS code_bits FROM l",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    keys = urgent(spark, d)
    return sorted_sets.gcs_build(keys, "key", sorted_sets.gcs_spec(distinct_count(keys)))


@query("gcs_false_positives", f"WITH {GCS_VALUES}, {H.sql_hashes(FAR, 0, 'p')} SELECT p.key FROM p, s WHERE (((p.h >> 32)::UHUGEINT * buckets::UHUGEINT) >> 32)::BIGINT * 4096 + (p.h & 4095)::BIGINT IN (SELECT value FROM v)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return catalog.ALGORITHMS[20].build(urgent(spark, d), "key").semi_join(order_keys(spark, d).select((F.col("key") + AWAY).alias("key")), "key")


PREFIX = f"""{H.sql_hashes(f"SELECT DISTINCT key FROM ({URGENT})")}, s AS (SELECT greatest(ceil(n / (25 * 0.95))::BIGINT, 1) AS bins FROM (SELECT {N} AS n)),
c AS (SELECT key, (((h >> 32)::UHUGEINT * bins::UHUGEINT) >> 32)::BIGINT AS bin, (((h & {M})::UHUGEINT * 6400) >> 32)::BIGINT AS code FROM h, s),
r AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY code, key) AS r FROM c)"""


@query("prefix_first_level", f"WITH {PREFIX} SELECT bin, count(*) FILTER (r <= 25) AS held, sum(code) FILTER (r <= 25)::BIGINT AS codes, max(r) > 25 AS overflow, max(code) FILTER (r <= 25) AS largest FROM r GROUP BY bin")
def _(spark: SparkSession, d: str) -> DataFrame:
    keys = urgent(spark, d)
    first, _ = sorted_sets.prefix_build(keys, "key", sorted_sets.prefix_spec(distinct_count(keys)))
    return first.select("bin", F.size("codes").cast("long").alias("held"), F.aggregate("codes", F.lit(0).cast("long"), lambda a, x: a + x).alias("codes"), "overflow", "largest")


@query("prefix_overflow", f"WITH {PREFIX} SELECT key FROM r WHERE r > 25")
def _(spark: SparkSession, d: str) -> DataFrame:
    keys = urgent(spark, d)
    return sorted_sets.prefix_build(keys, "key", sorted_sets.prefix_spec(distinct_count(keys)))[1]


# --- every numbered algorithm --------------------------------------------------------------


def _with_absent(spark: SparkSession, d: str, keys: DataFrame) -> DataFrame:
    """(key, added): ``keys``, and the keys ``AWAY`` from orders' that are not among them; once each, as repeats would count a hit many times."""
    far = order_keys(spark, d).select((F.col("key") + AWAY).alias("key")).distinct().join(keys, "key", "left_anti")
    return keys.withColumn("added", F.lit(True)).unionByName(far.withColumn("added", F.lit(False)))


def _within(rate: float) -> F.Column:
    """Whether the hits among keys not added are within five deviations of the expected rate (and five hits)."""
    hits, probes = F.count_if(~F.col("added") & F.col("maybe")), F.count_if(~F.col("added"))
    return hits <= probes * rate + 5 * F.sqrt(probes * rate) + 5


def _contract(spark: SparkSession, d: str, number: int) -> DataFrame:
    """What an algorithm must hold: all added keys found, a rate under its bound, and, where it removes, an empty filter after."""
    algorithm, keys = catalog.ALGORITHMS[number], urgent(spark, d)
    f = algorithm.build(keys, "key")
    f.rows = f.rows.persist()
    found = f.might_contain(_with_absent(spark, d, keys), "key").agg(
        F.count(F.when(F.col("added"), 1)).alias("keys"), F.count(F.when(F.col("added") & F.col("maybe"), 1)).alias("found"), _within(algorithm.expected_rate()).alias("rate_holds")
    )
    if not algorithm.removes:
        return found
    left = f.remove(keys, "key").might_contain(keys, "key").agg(F.count(F.when(F.col("maybe"), 1)).alias("left"))
    return found.crossJoin(left)  # one row each


for _number, _algorithm in catalog.ALGORITHMS.items():
    _left = ", 0::BIGINT AS left" if _algorithm.removes else ""
    query(f"alg{_number:04d}_{_algorithm.name.lower().replace('-', '_').replace('^', '').replace('.', 'p').replace('+', 'plus')}", f"SELECT count(*) AS keys, count(*) AS found, true AS rate_holds{_left} FROM ({URGENT})")(partial(_contract, number=_number))


@query("sharded_beyond_broadcast", f"SELECT count(*) AS found FROM ({URGENT})")
def _(spark: SparkSession, d: str) -> DataFrame:
    f = sharded.build(urgent(spark, d), "key", "fuse", {"bits": 16, "arity": 3}, shard_keys=1000)
    return sharded.might_contain(urgent(spark, d), "key", f, broadcast_bytes=0).where("maybe").agg(F.count("*").alias("found"))


@query("static_function", "SELECT o_orderkey AS key, (o_orderkey % 200)::BIGINT AS value FROM orders WHERE o_orderpriority = '1-URGENT'")
def _(spark: SparkSession, d: str) -> DataFrame:
    keys = urgent(spark, d).withColumn("value", F.col("key") % 200)
    f = sharded.build(keys, "key", "ribbon", {"columns": 8, "variant": "standard", "min_pad": 0.1}, values="value")
    return sharded.lookup(urgent(spark, d), "key", f)


@query("dynamic_add", f"SELECT count(*) AS found FROM ({URGENT})")
def _(spark: SparkSession, d: str) -> DataFrame:
    keys = urgent(spark, d)
    f = sharded.build(keys.where("key % 2 = 0"), "key", "cuckoo", {"bits": 12, "capacity": distinct_count(keys)}, shard_keys=1 << 20)
    return sharded.might_contain(keys, "key", sharded.add(f, keys.where("key % 2 = 1"), "key")).where("maybe").agg(F.count("*").alias("found"))


@query("static_function_by_shard", "SELECT o_orderkey AS key, (o_orderkey % 200)::BIGINT AS value FROM orders WHERE o_orderpriority = '1-URGENT'")
def _(spark: SparkSession, d: str) -> DataFrame:
    keys = urgent(spark, d).withColumn("value", F.col("key") % 200)
    f = sharded.build(keys, "key", "ribbon", {"columns": 8, "variant": "standard", "min_pad": 0.1}, shard_keys=1000, values="value")
    return sharded.lookup(urgent(spark, d), "key", f, broadcast_bytes=0)


def _added(spark: SparkSession, d: str, number: int) -> DataFrame:
    """A filter sized for the urgent orders and the lines' orders, built of the first and given the others."""
    first, rest = urgent(spark, d), read(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"))
    every = first.unionByName(rest).distinct()
    f = catalog.ALGORITHMS[number].build(first, "key", every.count()).add(rest.join(first, "key", "left_anti"), "key")
    return f.might_contain(every, "key").agg(F.count_if("maybe").alias("found"), F.count("*").alias("keys"))


ADDED = f"SELECT count(*) AS found, count(*) AS keys FROM ({URGENT} UNION SELECT l_orderkey FROM lineitem)"
for _number, _name in ((18, "cuckoofuse_add"), (35, "prefix_add"), (36, "prefix_cuckoo_add"), (37, "prefix_blocked_add"), (11, "reserve_then_add"), (80, "morton_add"), (32, "two_choice_add")):
    query(_name, ADDED)(partial(_added, number=_number))


@query("add_status", f"SELECT 'not enough space' AS status, count(*) AS found, count(*) AS keys FROM ({URGENT})")
def _(spark: SparkSession, d: str) -> DataFrame:
    """A filter without room for all lines' orders tells so, and still has its own keys."""
    keys = urgent(spark, d)
    f, status = catalog.ALGORITHMS[11].build(keys, "key").add_attempt(order_keys(spark, d).join(keys, "key", "left_anti"), "key")
    return f.might_contain(keys, "key").agg(F.count_if("maybe").alias("found"), F.count("*").alias("keys")).crossJoin(status.select("status").distinct())  # one row each


@query("morton_presets", f"SELECT preset, count(*) AS found, count(*) AS keys, true AS rate_holds FROM ({URGENT}), (SELECT unnest([{', '.join(repr(x) for x in S.MORTON_PRESETS)}]) AS preset) GROUP BY preset")
def _(spark: SparkSession, d: str) -> DataFrame:
    keys = urgent(spark, d)
    rows, made = _with_absent(spark, d, keys), []
    for preset in S.MORTON_PRESETS:
        got = catalog.build("sharded", keys, "key", "morton", preset=preset).might_contain(rows, "key")
        _, bits, most, per = sharded.K.morton_layout(preset)
        rate = 2 * 0.95 * most / per / 2.0**bits  # the tags of two buckets at full load
        made.append(got.agg(F.lit(preset).alias("preset"), F.count_if(F.col("added") & F.col("maybe")).alias("found"), F.count_if("added").alias("keys"), _within(rate).alias("rate_holds")))
    return reduce(DataFrame.unionByName, made)


@query("load_histogram", f"SELECT count(DISTINCT key)::BIGINT AS tags FROM ({URGENT})")
def _(spark: SparkSession, d: str) -> DataFrame:
    f = sharded.build(urgent(spark, d), "key", "cuckoo", {"bits": 16})
    return benchmark.load_histogram(f).agg(F.sum(F.col("load") * F.col("buckets")).alias("tags"))


# --- sources, metrics, formulas ------------------------------------------------------------


@query("keys_random", f"WITH {H.sql_hashes('SELECT range AS key FROM range(1000, 3000)', 5)} SELECT {H.sql_i64('h')} AS key FROM h")
def _(spark: SparkSession, d: str) -> DataFrame:
    return source.random_keys(spark, 2000, 1000, 5)


@query("keys_rotated", f"SELECT {H.sql_i64(H.sql_rotl('range::UBIGINT', 13))} AS key FROM range(2000)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return source.generate(spark, 2000, 13)


@query("keys_reversed", f"SELECT {H.sql_i64('list_reduce(list_transform(range(64), lambda i: (((r >> i::UBIGINT) & 1)::UBIGINT << (63 - i)::UBIGINT)), lambda a, b: a | b)::UBIGINT')} AS key FROM (SELECT {H.sql_rotl('range::UBIGINT', 6)} AS r FROM range(2000))")
def _(spark: SparkSession, d: str) -> DataFrame:
    return source.generate(spark, 2000, 70)


@query("keys_sample", f"WITH {H.sql_hashes('SELECT o_orderkey AS key FROM orders')} SELECT key FROM h ORDER BY {H.sql_i64('h')}, key LIMIT 100")
def _(spark: SparkSession, d: str) -> DataFrame:
    return source.sample(order_keys(spark, d), 100)


@query("probe_sets", "SELECT p::INT AS hit_pct, 400::BIGINT AS probes, (4 * p)::BIGINT AS present FROM (SELECT unnest([0, 25, 50, 75, 100]) AS p)")
def _(spark: SparkSession, d: str) -> DataFrame:
    present = order_keys(spark, d)
    mixed = source.probe_sets(present, present.select((F.col("key") + AWAY).alias("key")), 400)
    marked = mixed.join(present.withColumn("there", F.lit(1)), "key", "left")
    return marked.groupBy("hit_pct").agg(F.count("*").alias("probes"), F.count("there").alias("present"))


@query("match_size", f"SELECT count(*) AS match_size FROM lineitem WHERE l_orderkey IN ({URGENT})")
def _(spark: SparkSession, d: str) -> DataFrame:
    return benchmark.match_size(read(spark, d, "lineitem").select(F.col("l_orderkey").alias("key")), urgent(spark, d))


@query("count_distinct", "SELECT count(DISTINCT l_partkey) AS count_distinct FROM lineitem")
def _(spark: SparkSession, d: str) -> DataFrame:
    return benchmark.count_distinct(read(spark, d, "lineitem"), "l_partkey")


@query("has_duplicates", "SELECT count(*) > count(DISTINCT l_partkey) AS has_duplicates FROM lineitem")
def _(spark: SparkSession, d: str) -> DataFrame:
    return benchmark.has_duplicates(read(spark, d, "lineitem"), "l_partkey")


@query("false_negatives", "SELECT 0::BIGINT AS false_negatives")
def _(spark: SparkSession, d: str) -> DataFrame:
    return benchmark.false_negatives(catalog.ALGORITHMS[118].build(urgent(spark, d), "key"), urgent(spark, d))


@query(
    "bloom_math",
    """SELECT bits::INT AS bits, probes::INT AS probes, round(pow(1 - exp(-probes / bits::DOUBLE), probes), 9) AS standard,
       round((pow(1 - exp(-probes * (m + sqrt(m)) / 512), probes) + pow(1 - exp(-probes * greatest(0, m - sqrt(m)) / 512), probes)) / 2, 9) AS cache_local, round(-log2(pow(1 - exp(-probes / bits::DOUBLE), probes)), 9) AS optimal_bits
FROM (SELECT b AS bits, floor(b * ln(2) + 0.5) AS probes, 512 / b::DOUBLE AS m FROM (SELECT unnest([8, 10, 12, 16, 18]) AS b))""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = [(b, k := S.bloom_probes(b), round(S.bloom_rate(1, b, k), 9), round(S.cache_local_rate(1, b, k), 9), round(S.optimal_bits(S.bloom_rate(1, b, k)), 9)) for b in (8, 10, 12, 16, 18)]
    return spark.createDataFrame(rows, "bits int, probes int, standard double, cache_local double, optimal_bits double")


_steps = " ".join(f"WHEN m <= {x} THEN {k}" for x, k in S.PROBE_STEPS)


@query("local_probes", f"SELECT m AS millibits, (CASE {_steps} WHEN m > 50000 THEN 24 ELSE (m - 1) // 2000 - 1 END)::INT AS probes FROM (SELECT range * 500 AS m FROM range(1, 140))")
def _(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(1, 140).select((F.col("id") * 500).alias("millibits")).withColumn("probes", S.local_probes_column(F.col("millibits")))


def _fuse_sql(arity: int) -> str:
    segment = "floor(ln(n) / ln(3.33) + 2.25)" if arity == 3 else "floor(ln(n) / ln(2.91) - 0.5)"
    factor = "greatest(1.125, 0.875 + 0.25 * ln(1000000) / ln(n))" if arity == 3 else "greatest(1.075, 0.77 + 0.305 * ln(600000) / ln(n))"
    return f"SELECT n, pow(2, greatest(2, least(18, {segment})))::BIGINT AS segment, round({factor}, 9) AS factor FROM (SELECT (range + 1) * 997 AS n FROM range(500))"


def _fuse(spark: SparkSession, d: str, arity: int) -> DataFrame:
    n = spark.range(500).select(((F.col("id") + 1) * 997).alias("n"))
    return n.select("n", S.fuse_segment_column(F.col("n"), arity).alias("segment"), F.round(S.fuse_factor_column(F.col("n"), arity), 9).alias("factor"))


for _arity in (3, 4):
    query(f"fuse{_arity}_sizing", _fuse_sql(_arity))(partial(_fuse, arity=_arity))


@query("construction_sweep", "SELECT unnest([100, 316, 1000, 3162])::BIGINT AS n, 10::BIGINT AS builds, true AS size_holds")
def _(spark: SparkSession, d: str) -> DataFrame:
    got = benchmark.construction_sweep(spark, "xor", {"bits": 8}, benchmark.geometric(100, 3162, 4))
    return got.select("n", "builds", (F.abs(F.col("bits_per_item") - 8 * (32 + 1.23 * F.col("n")) / F.col("n")) < 0.5).alias("size_holds"))


@query("sizes", f"SELECT 'Xor8' AS name, (8 * (floor(32 + 1.23 * n)::BIGINT // 3 * 3))::BIGINT AS bits FROM (SELECT {N} AS n) UNION ALL SELECT 'Bloom12', ((n * 12 + 63) // 64 * 64)::BIGINT FROM (SELECT {N} AS n) UNION ALL SELECT 'BlockedBloom', (greatest(n // 24, 1) * 256)::BIGINT FROM (SELECT {N} AS n)")
def _(spark: SparkSession, d: str) -> DataFrame:
    keys = urgent(spark, d)
    n = distinct_count(keys)
    made = sharded.build(keys, "key", "xor", {"bits": 8}, shard_keys=max(n, 1))
    rows = [("Bloom12", bloom.spec("classic", n, 12).bytes * 8), ("BlockedBloom", bloom.spec("block32", n).bytes * 8)]
    return made.agg((F.sum("bytes") * 8).alias("bits")).select(F.lit("Xor8").alias("name"), "bits").unionByName(spark.createDataFrame(rows, "name string, bits long"))


@query("sort_baseline", "SELECT l_orderkey AS key FROM lineitem ORDER BY key")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").select(F.col("l_orderkey").alias("key")).orderBy("key")


# --- streams -------------------------------------------------------------------------------

_users = H.sql_hashes("SELECT user_id AS key, event_id, floor(epoch(ts) / 86400)::BIGINT AS day FROM events", 0, "u")
_n = "(SELECT greatest(count(DISTINCT user_id), 1) FROM events)"
_block = f"(((h >> 32)::UHUGEINT * greatest({_n} // 24, 1)::UHUGEINT) >> 32)::BIGINT AS block"
_words = ", ".join(f"bit_or({_bit(f'((h & {M}) * {salt}::UBIGINT & {M}) >> 27')}) AS w{i}" for i, salt in enumerate(bloom.SALTS))
_out = ", ".join(f"{H.sql_i64(f'w{i}')} AS w{i}" for i in range(8))


@query("stream_counting", f"WITH {_users}, x AS (SELECT (((h >> 32) + (h & {M}) * i::UBIGINT) & {M}) AS x FROM u, range({S.bloom_probes(10)}) AS r(i)) SELECT {H.sql_reduce32('x', f"greatest(40 * {_n} // 64, 1)")} * 16 + (x & 15)::BIGINT AS pos, count(*) AS count FROM x GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return streams.counting_of_users(spark, d)


@query("stream_bloom", f"WITH {_users}, f AS (SELECT {_block}, {_words} FROM u GROUP BY block) SELECT block, {_out} FROM f")
def _(spark: SparkSession, d: str) -> DataFrame:
    return streams.bloom_of_users(spark, d)


@query("stream_first_seen", "SELECT user_id, count(*) AS events FROM (SELECT DISTINCT user_id FROM events) GROUP BY user_id")
def _(spark: SparkSession, d: str) -> DataFrame:
    return streams.first_seen_users(spark, d)


@query(
    "stream_windows",  # a day is closed when the last event is an hour past its end
    f"WITH {_users}, f AS (SELECT day, {_block}, {_words} FROM u GROUP BY ALL) SELECT day, block, {_out} FROM f WHERE (day + 1) * 86400000 <= (SELECT max(epoch_ms(ts)) - 3600000 FROM events)",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return streams.daily_windows(spark, d)
