"""Every kind of filter under one interface, and the numbered algorithms of the benchmark."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.functions import sizing as S
from tamis.operators import bloom, counting, quotient, sharded, sorted_sets


class Unsupported(Exception):
    """The kind does not offer this operation."""


@dataclass
class Filter:
    """A built filter: its rows, and how its family sizes, probes and changes them."""

    family: str
    spec: object
    rows: DataFrame
    n: int
    more: dict = field(default_factory=dict)

    @property
    def bytes(self) -> float:
        if self.family == "sharded":
            return self.rows.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
        if self.family == "gcs":
            bits = self.rows.agg(F.coalesce(F.sum("code_bits"), F.lit(0)), F.countDistinct("chunk")).first()
            # codes, and the start of each bucket's code: about 6 bits a bucket and 8 bytes a chunk
            return bits[0] / 8 + 0.75 * self.spec.buckets + 8 * bits[1]
        if self.family == "prefix":
            return 32 * self.spec.bins + self.more["spare"].bytes
        return self.spec.bytes

    @property
    def bits_per_item(self) -> float:
        return 8 * self.bytes / self.n if self.n else float("nan")

    def might_contain(self, df: DataFrame, key: str, out: str = "maybe") -> DataFrame:
        """``df`` with ``out``: false where the key was surely not added, null for a null key."""
        if self.family == "prefix":
            return sorted_sets.prefix_might_contain(df, key, self.rows, self.spec, self.more["spare"].might_contain, out)
        probe = {"bloom": bloom.might_contain, "counting": counting.might_contain, "quotient": quotient.might_contain, "gcs": sorted_sets.gcs_might_contain}.get(self.family)
        return probe(df, key, self.rows, self.spec, out) if probe else sharded.might_contain(df, key, self.rows, out)

    def semi_join(self, df: DataFrame, key: str) -> DataFrame:
        """Rows whose key may have been added."""
        return self.might_contain(df, key, "__maybe").where("__maybe").drop("__maybe")

    def anti_join(self, df: DataFrame, key: str) -> DataFrame:
        """Rows whose key was surely not added; never a wrong one."""
        return self.might_contain(df, key, "__maybe").where(~F.col("__maybe")).drop("__maybe")

    def _changed(self, rows: DataFrame, by: int) -> Filter:
        return Filter(self.family, self.spec, rows, self.n + by, self.more)

    def add(self, keys: DataFrame, key: str) -> Filter:
        """With the distinct non-null keys; a key that is there already counts again."""
        more = _distinct(keys, key)
        if self.family == "bloom":
            return self._changed(bloom.merge(self.rows, bloom.build(keys, key, self.spec)), more)
        if self.family == "counting":
            return self._changed(counting.add(self.rows, keys, key, self.spec), more)
        if self.family == "quotient":
            return self._changed(quotient.insert(self.rows, quotient.build(keys, key, self.spec)), more)
        if self.family == "prefix":
            first, over = sorted_sets.prefix_add(self.rows, keys, key, self.spec)
            # both are read several times by what follows; without a cache each further add would plan all before it anew
            first, over = first.persist(), over.persist()
            return Filter(self.family, self.spec, first, self.n + more, {**self.more, "spare": self.more["spare"].add(over, "key")})
        if self.family == "sharded" and self.more["kernel"].add:
            return self._changed(sharded.add(self.rows, keys, key), more)
        raise Unsupported("add")

    def add_attempt(self, keys: DataFrame, key: str) -> tuple[Filter, DataFrame]:
        """The filter with the keys that found room, and (shard, status): "ok" or "not enough space". Kinds without an end of room are always "ok"."""
        if self.family != "sharded":
            made = self.add(keys, key)
            return made, self.rows.sparkSession.createDataFrame([(0, "ok")], "shard int, status string")
        if not self.more["kernel"].add:
            raise Unsupported("add")
        tried = sharded.add_attempt(self.rows, keys, key).persist()
        n = tried.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        return self._changed(tried.drop("status"), n - self.n), tried.select("shard", "status")

    def remove(self, keys: DataFrame, key: str) -> Filter:
        less = -_distinct(keys, key)
        if self.family == "counting":
            return self._changed(counting.remove(self.rows, keys, key, self.spec), less)
        if self.family == "quotient":
            return self._changed(quotient.remove(self.rows, quotient.build(keys, key, self.spec)), less)
        if self.family == "sharded" and self.more["kernel"].remove:
            return self._changed(sharded.remove(self.rows, keys, key), less)
        raise Unsupported("remove")

    def merge(self, other: Filter) -> Filter:
        if (self.family, self.spec) != (other.family, other.spec):
            raise ValueError("only filters with one spec merge")
        combine = {"bloom": bloom.merge, "counting": counting.merge, "quotient": quotient.merge}.get(self.family)
        if combine is None:
            raise Unsupported("merge")
        return self._changed(combine(self.rows, other.rows), other.n)

    def info(self) -> dict:
        told = self.more["algorithm"].name if "algorithm" in self.more else self.family
        return {"name": told, "family": self.family, "n": self.n, "bytes": self.bytes, "bits_per_item": self.bits_per_item}

    def save(self, path: str) -> None:
        """The rows as Parquet, the spec beside them; the spare of a prefix filter in a folder of its own."""
        self.rows.write.mode("overwrite").parquet(f"{path}/rows")
        told = {"family": self.family, "n": self.n, "spec": asdict(self.spec) if self.spec is not None else None, "algorithm": self.more["algorithm"].id if "algorithm" in self.more else None}
        self.rows.sparkSession.createDataFrame([(json.dumps(told),)], "spec string").coalesce(1).write.mode("overwrite").parquet(f"{path}/spec")
        if "spare" in self.more:
            self.more["spare"].save(f"{path}/spare")


def load(spark, path: str) -> Filter:
    told = json.loads(spark.read.parquet(f"{path}/spec").first()[0])
    kind = {"bloom": bloom.BloomSpec, "counting": counting.CountingSpec, "quotient": quotient.QuotientSpec, "gcs": sorted_sets.GcsSpec, "prefix": sorted_sets.PrefixSpec}.get(told["family"])
    more: dict = {"algorithm": ALGORITHMS[told["algorithm"]]} if told["algorithm"] is not None else {}
    rows = spark.read.parquet(f"{path}/rows")
    if told["family"] == "sharded":
        more["kernel"] = sharded.K.KERNELS[rows.first()["kind"]]
    if told["family"] == "prefix":
        more["spare"] = load(spark, f"{path}/spare")
    return Filter(told["family"], kind(**told["spec"]) if kind else None, rows, told["n"], more)


def _distinct(keys: DataFrame, key: str) -> int:
    return keys.select(key).where(F.col(key).isNotNull()).distinct().count()


#: A user's own kinds: name to a function (keys, key) -> Filter.
CUSTOM: dict[str, Callable[[DataFrame, str], Filter]] = {}


def register(name: str, make: Callable[[DataFrame, str], Filter]) -> None:
    """Makes ``build(name, keys, key)`` call ``make(keys, key)``."""
    CUSTOM[name] = make


# --- building ------------------------------------------------------------------------------


def build(family: str, keys: DataFrame, key: str, kind: str = "", n: int | None = None, seed: int = 0, **params) -> Filter:
    """A filter of the distinct non-null keys. ``n`` sizes it for more keys than are there now (static kinds are of the
    keys that are there). ``family`` may be the name of a registered kind."""
    if family in CUSTOM:
        return CUSTOM[family](keys, key)
    asked, n = n, _distinct(keys, key) if n is None else n
    if family == "bloom":
        s = bloom.spec(kind, n, params.get("bits_per_key", 10), seed)
        return Filter(family, s, bloom.build(keys, key, s), n)
    if family == "counting":
        s = counting.spec(kind, n, params.get("bits_per_key", 10), seed)
        return Filter(family, s, counting.build(keys, key, s), n)
    if family == "quotient":
        s = quotient.spec(n, params.get("remainder_bits", 8), 0, params.get("mode", "default"), seed)
        return Filter(family, s, quotient.build(keys, key, s), n)
    if family == "gcs":
        s = sorted_sets.gcs_spec(n, params.get("bits", 8), seed)
        return Filter(family, s, sorted_sets.gcs_build(keys, key, s), n)
    if family == "prefix":
        s = sorted_sets.prefix_spec(n, seed)
        first, over = sorted_sets.prefix_build(keys, key, s)
        of, more = {"two_choice": ("sharded", {"kind": "two_choice"}), "cuckoo": ("sharded", {"kind": "cuckoo", "bits": 12}), "blocked": ("bloom", {"kind": "block32"})}[kind]
        room = {} if asked is None else {"n": sorted_sets.prefix_overflow(s)}
        return Filter(family, s, first, n, {"spare": build(of, over, "key", seed=seed + 1, **more, **room)})
    if family == "sharded":
        return Filter(family, None, sharded.build(keys, key, kind, params, seed, n=asked), n, {"kernel": sharded.K.KERNELS[kind]})
    raise ValueError(f"unknown family {family}")


@dataclass(frozen=True)
class Algorithm:
    id: int
    name: str
    family: str
    kind: str = ""
    params: tuple = ()
    #: Keys are added one by one in the benchmark (False: all at once); removal is timed.
    batch: bool = True
    removes: bool = False

    def build(self, keys: DataFrame, key: str, n: int | None = None, seed: int = 0) -> Filter:
        made = build(self.family, keys, key, self.kind, n, seed, **dict(self.params))
        made.more["algorithm"] = self
        return made

    def expected_rate(self) -> float:
        """By the published formulas, or, for block and counting kinds, of their design at full load."""
        p = dict(self.params)
        if self.kind in ("xor", "fuse"):
            return 2.0 ** -p["bits"]
        if self.kind == "ribbon":
            return S.ribbon_rate(p["columns"])
        if self.kind == "classic":
            return S.bloom_rate(1, p["bits_per_key"], S.bloom_probes(p["bits_per_key"]))
        if self.kind == "cuckoo" and self.family == "sharded":
            return S.cuckoo_rate(p["bits"])
        if self.kind == "cuckoo_fuse":  # three spots, of which one in three holds a tag with the spot's own number
            return 1 / 2.0 ** (p["bits"] - 2)
        if self.family == "quotient":
            return 2.0 ** -p["remainder_bits"]
        return DESIGN_RATES[self.kind or self.family]


#: Share of keys not added that a kind without a formula above finds, at full load.
DESIGN_RATES = {
    "gcs": 2.0**-8, "two_choice": 0.006, "cuckoo": 0.006, "blocked": 0.012, "simple": 0.037, "simple_upper": 0.037, "block32": 0.0105, "block64": 0.0105, "bytes16": 0.0125,
    "counting": 0.0115, "succinct": 0.0115, "blocked_rank": 0.0135, "morton": 0.006,
}


def _algorithms() -> list[Algorithm]:
    a: list[Algorithm] = []

    def put(number: int, name: str, family: str, kind: str = "", batch: bool = True, removes: bool = False, **params) -> None:
        a.append(Algorithm(number, name, family, kind, tuple(sorted(params.items())), batch, removes))

    for first, name in ((0, ""), (1000, "-naive"), (2000, "-prefetch")):
        for step, bits in ((0, 8), (2, 16)):
            put(first + step, f"Xor{bits}{name}", "sharded", "xor", bits=bits)
    put(3, "Xor+8", "sharded", "xor", bits=8, plus=True)
    put(4, "Xor+16", "sharded", "xor", bits=16, plus=True)
    for first, stable, name in ((10, True, "Cuckoo"), (14, False, "Cuckoo-2^n-")):
        for step, bits in enumerate((8, 12, 16)):
            put(first + step, f"{name}{bits}", "sharded", "cuckoo", False, True, bits=bits, stable=stable)
        put(first + 3, f"{name}SemiSort13", "sharded", "cuckoo", False, True, bits=13, stable=stable, packed=True)
    put(18, "CuckooFuse8", "sharded", "cuckoo_fuse", False, True, bits=8)
    put(19, "CuckooFuse16", "sharded", "cuckoo_fuse", False, True, bits=16)
    put(20, "GCS", "gcs", bits=8)
    put(30, "CQF", "quotient", batch=False, removes=True, remainder_bits=8)
    put(31, "VQF", "sharded", "two_choice", vector=True)
    put(32, "TwoChoice", "sharded", "two_choice", False)
    for number, spare in ((35, "two_choice"), (36, "cuckoo"), (37, "blocked")):
        put(number, f"Prefix-{spare}", "prefix", spare, False)
    for first, name in ((40, ""), (43, "-addall"), (46, "-branchless-addall")):
        for step, bits in enumerate((8, 12, 16)):
            put(first + step, f"Bloom{bits}{name}", "bloom", "classic", first > 40, bits_per_key=bits)
    # the published layout draws a key's word from the half of its hash that its bits come from: beyond some 100,000 words they depend on each other
    put(50, "SimpleBlockedBloom", "bloom", "simple_upper", False)
    put(51, "BlockedBloom", "bloom", "block32", False)
    put(52, "BlockedBloom-addall", "bloom", "block32")
    put(53, "BlockedBloom64", "bloom", "block64", False)
    put(54, "BlockedBloom16", "bloom", "bytes16", False)
    for number, kind in ((60, "counting"), (61, "succinct"), (62, "blocked"), (63, "blocked_rank")):
        put(number, f"CountingBloom10-{kind}", "counting", kind, False, True, bits_per_key=10)
    put(70, "Xor8-single", "sharded", "xor", bits=8)
    put(72, "BinaryFuse8-single", "sharded", "fuse", bits=8, arity=3)
    put(80, "Morton3_8", "sharded", "morton", preset="3_8")
    for first, arity, name in ((96, 3, "-naive"), (102, 4, "-naive"), (116, 3, ""), (118, 4, "")):
        for step, bits in ((0, 8), (1, 16)):
            put(first + step, f"XorBinaryFuse{bits}-{arity}wise{name}", "sharded", "fuse", bits=bits, arity=arity)
    for thousand, variant, name in ((1000, "homogeneous", "Homog"), (2000, "balanced", "Balanced"), (3000, "standard", "Standard")):
        for columns in (5, 7, 8, 9, 11, 13, 15):
            if variant != "standard" or columns not in (7, 8):
                put(thousand + 6 + 10 * columns, f"{name}Ribbon64_{columns}", "sharded", "ribbon", columns=columns, variant=variant)
        if variant != "homogeneous":
            put(thousand + 776, f"{name}Ribbon64_7.7", "sharded", "ribbon", columns=7.7, variant=variant)
    for number, pad in ((3072, 25), (3073, 20), (3074, 15), (3075, 10), (3076, 0)):
        put(number, f"StandardRibbon64_7_{pad}PctPad", "sharded", "ribbon", columns=7, variant="standard", min_pad=pad / 100)
    put(3086, "StandardRibbon64_8", "sharded", "ribbon", columns=8, variant="standard")
    put(3088, "StandardRibbon64_8_Smash", "sharded", "ribbon", columns=8, variant="standard", smash=True)
    return a


ALGORITHMS: dict[int, Algorithm] = {x.id: x for x in _algorithms()}
SORT_ID = 100
#: What runs when no algorithm is named.
DEFAULT_IDS = (0, 2, 11, 12, 44, 45, 51, 116, 117, 118, 119, 1086, 1156, 3086, 3156, 100)


def parse_ids(text: str) -> list[int]:
    """Ids from a text of numbers and ranges like ``0,2,40-45``; ``all`` is every known one."""
    if text.strip() == "all":
        return sorted(ALGORITHMS)
    out: list[int] = []
    for part in filter(None, (p.strip() for p in text.split(","))):
        low, dash, high = part.partition("-")
        out += [i for i in range(int(low), int(high) + 1) if i in ALGORITHMS or i == SORT_ID] if dash else [int(low)]
    return list(dict.fromkeys(out))
