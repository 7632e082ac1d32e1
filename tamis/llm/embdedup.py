"""Near-duplicate vectors by sorted projection passes.

Vectors with equal labels and components are one class from the start.  In each pass every
class has a key of 64 concatenated random sign hashes; classes are put in order of label
and key, and each is compared with the next ``WINDOW`` ones.  Pairs with a cosine of
``min_cosine`` or more, in double precision, are united across all passes.  Inside the
components so found every pair is then counted exactly, so that a group larger than the
window loses no link.  In a component of more than ``TILE`` classes, those within half the
linking angle of its centre are its core: all their pairs link, which is a count and no
comparison.  What lies outside the core is compared with everything in tiles of about
``TILE`` classes by a hash; each pair of tiles is one bounded group that returns counts.

Scale: a pass is a range exchange of the classes with their vectors, floats as floats (all
passes are one job, whose disk is passes times the input); keys end in the class number, so a hot label or group spreads over many partitions.  Windows end at a
partition's border; the passes have different borders, which the measured recall includes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.llm._common import arrow_map, importable, table, written
from tamis.llm.graph import components, forest
from tamis.llm.neighbours import usable

MIN_COSINE = 0.98
PASSES = 8
WINDOW = 40
BITS = 64
TILE = 512
#: Classes of small components that are counted in one group.
SMALL_ROWS = 4096
SEED = 10


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1, scaled by the largest component first, so that no square over- or underflows."""
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of equal length as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def sort_keys(vectors: np.ndarray, passes: int = PASSES) -> np.ndarray:
    """Row i: the keys of vectors[i], one for each pass, the first hash in the highest bit."""
    planes = np.random.default_rng([SEED, vectors.shape[1]]).standard_normal((vectors.shape[1], passes * BITS))
    signs = (vectors @ planes >= 0).reshape(len(vectors), passes, BITS)
    keys = np.packbits(signs, axis=2).view(">u8")[..., 0].astype(np.uint64)
    return (keys ^ np.uint64(1 << 63)).view(np.int64)  # order as signed numbers is order of the bits


def _keyed(classes: DataFrame, passes: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                n, sizes = part.num_rows, np.array([len(v) for v in part.column(2)])
                keys = np.zeros((n, passes), np.int64)
                for size in np.unique(sizes).tolist():
                    some = np.flatnonzero(sizes == size)
                    keys[some] = sort_keys(unit(_matrix(part.column(2).take(pa.array(some)))), passes)
                take = pa.array(np.repeat(np.arange(n), passes))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.tile(np.arange(passes, dtype=np.int32), n)), part.column(1).take(take), pa.array(np.repeat(sizes, passes).astype(np.int32)), pa.array(keys.ravel()), part.column(0).take(take), part.column(2).take(take)],
                    ["pass", "label", "size", "key", "id", "vector"],
                )

    return arrow_map(classes.select("id", "label", "vector"), run, "pass int, label long, size int, key long, id long, vector " + classes.schema["vector"].dataType.simpleString())


def _window_links(ordered: DataFrame, min_cosine: float, window: int) -> DataFrame:
    """Links among neighbours of partitions in order, as a forest for each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: dict[int, tuple] = {}
        for b in batches:
            group = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], 1)
            ids, a, c = b.column(4).to_numpy(zero_copy_only=False), [], []
            for size in np.unique(group[:, 2]).tolist():
                some = np.flatnonzero(group[:, 2] == size)
                g, i, u = group[some], ids[some], unit(_matrix(b.column(5).take(pa.array(some))))
                if size in tail:
                    g, i, u = (np.concatenate([x, y]) for x, y in zip(tail[size], (g, i, u), strict=True))
                for s in range(1, min(window, len(i) - 1) + 1):
                    near = (np.einsum("ij,ij->i", u[:-s], u[s:]) >= min_cosine) & (g[:-s] == g[s:]).all(1)
                    a.append(i[:-s][near])
                    c.append(i[s:][near])
                tail[size] = (g[-window:], i[-window:], u[-window:])
            a, c = forest(np.concatenate(a), np.concatenate(c)) if a else (np.zeros(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(c)], ["a", "b"])

    return arrow_map(ordered, run, "a long, b long")


def _count(key: tuple, rows: pd.DataFrame, min_cosine: float) -> pd.DataFrame:
    """Weighted links of each class within one group of tiles; a pair in two tiles counts for both."""
    _, low, high = key
    ids, links = [], []
    for _, own in rows.groupby(["component", "size"], sort=False):
        u = unit(np.stack(own["vector"].to_numpy()).astype(np.float64))
        w, i, tile = own["weight"].to_numpy(np.int64), own["id"].to_numpy(np.int64), own["tile"].to_numpy()
        if low == high:
            near = u @ u.T >= min_cosine
            np.fill_diagonal(near, False)
            ids.append(i)
            links.append(near @ w)
        else:
            x, y = tile == low, tile == high
            near = u[x] @ u[y].T >= min_cosine
            ids += [i[x], i[y]]
            links += [near @ w[y], w[x] @ near]
    return pd.DataFrame({"id": np.concatenate(ids), "links": np.concatenate(links)})


def _centres(big: DataFrame) -> DataFrame:
    """(component, size, centre): the sum of each component's unit vectors, added up in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            component, size, weight = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
            out: list[tuple] = []
            for n in np.unique(size).tolist():
                some = np.flatnonzero(size == n)
                u = unit(_matrix(b.column(3).take(pa.array(some)))) * weight[some][:, None]
                for c in np.unique(component[some]).tolist():
                    total = u[component[some] == c].sum(0)
                    out += [(c, n, i, x) for i, x in enumerate(total.tolist())]
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, [pa.int64(), pa.int32(), pa.int32(), pa.float64()], strict=True)], ["component", "size", "pos", "value"])

    sums = arrow_map(big.select("component", "size", "weight", "vector"), run, "component long, size int, pos int, value double").groupBy("component", "size", "pos").agg(F.sum("value").alias("value"))
    return sums.groupBy("component", "size").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("centre"))


def _with_core(big: DataFrame, min_cosine: float) -> DataFrame:
    """``core``: within half the linking angle of the component's centre. By the triangle inequality of angles all pairs of the core link."""
    near = math.cos(max(0.0, math.acos(min_cosine) / 2 - 1e-7))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, core = b.column(4).to_numpy(zero_copy_only=False), np.zeros(b.num_rows, bool)
            for n in np.unique(size).tolist():
                some = np.flatnonzero(size == n)
                u, c = (_matrix(b.column(i).take(pa.array(some))) for i in (2, 5))
                length = np.sqrt((c * c).sum(1))
                core[some] = (unit(u) * c).sum(1) >= near * length
                core[some[length == 0]] = False
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(core)], ["id", "weight", "vector", "component", "size", "core"])

    joined = big.join(_centres(big), ["component", "size"]).select("id", "weight", "vector", "component", "size", "centre")
    return arrow_map(joined, run, f"id long, weight long, vector {big.schema['vector'].dataType.simpleString()}, component long, size int, core boolean")


def _exact_links(classes: DataFrame, found: DataFrame, min_cosine: float, tile: int) -> DataFrame:
    """(id, links): for each class in a component, the vectors of other classes in it that it links with."""
    sizes = written(found.groupBy("component").count(), "sizes")
    importable(classes.sparkSession)
    count = lambda rows: rows.groupBy("group", "low", "high").applyInPandas(lambda key, x: _count(key, x, min_cosine), "id long, links long")
    few = sizes.where(F.col("count") <= tile).agg(F.sum("count")).first()[0] or 0
    rows = classes.join(found.join(sizes, "component"), F.col("id") == F.col("vertex")).select("id", "weight", "vector", F.size("vector").alias("size"), "component", "count")
    zero = F.lit(0)
    counted = count(rows.where(F.col("count") <= tile).select("id", "weight", "vector", "size", "component", zero.alias("tile"), F.pmod(F.xxhash64("component"), F.lit(max(1, math.ceil(few / SMALL_ROWS)))).alias("group"), zero.alias("low"), zero.alias("high")))
    big = written(rows.where(F.col("count") > tile), "large")
    if not big.isEmpty():
        # the core's pairs all link; what lies outside of it is compared with everything, tile by tile
        marked = written(_with_core(big, min_cosine), "marked")
        of = ["component", "size"]
        stats = written(marked.groupBy(*of).agg(F.sum(F.when(F.col("core"), F.col("weight")).otherwise(0)).alias("core_weight"), F.ceil(F.count_if("core") / tile).cast("int").alias("c"), F.ceil(F.count_if(~F.col("core")) / tile).cast("int").alias("o")), "cores")
        both = marked.join(stats, of)
        number = lambda n: F.pmod(F.xxhash64("id"), F.greatest(F.col(n), F.lit(1))).cast("int")
        none = F.array().cast("array<int>")
        others = F.when(F.col("o") == 0, none).when(F.col("core"), F.sequence(F.col("c"), F.col("c") + F.col("o") - 1)).otherwise(F.sequence(zero, F.col("c") + F.col("o") - 1))
        tiled = both.select("id", "weight", "vector", *of, F.when(F.col("core"), number("c")).otherwise(F.col("c") + number("o")).alias("tile"), F.explode_outer(others).alias("other")).where("other is not null")
        pairs = tiled.select("id", "weight", "vector", "size", "component", "tile", F.xxhash64(*of).alias("group"), F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"))
        counted = counted.union(count(pairs)).union(both.where("core").select("id", (F.col("core_weight") - F.col("weight")).alias("links")))
    return counted.groupBy("id").agg(F.sum("links").alias("links"))


def near_duplicates(rows: DataFrame, min_cosine: float = MIN_COSINE, passes: int = PASSES, window: int = WINDOW, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``rows`` (vec_id, embedding, label).

    Only vectors with equal labels are compared. Rows with a null label or vec_id, and vectors
    that are null, empty, all zero, or hold null or non-finite components, link with nothing:
    0 links, their own component, kept. Vectors of other lengths do not link. Repeated rows
    of one vec_id are one vector (the smallest, of the smallest label) and get its result.
    Other columns are ignored; an empty table gives no rows.
    """
    # floats are carried as such, and are made doubles where they are compared
    kind = rows.schema["embedding"].dataType.simpleString()
    every = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind if kind == "array<float>" else "array<double>").alias("embedding"), F.col("label").cast("long").alias("label"))
    able = every.where(usable() & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    vectors = written(able.groupBy("vec_id").agg(F.min(F.struct("label", F.col("embedding").alias("vector"))).alias("v")).select("vec_id", "v.label", "v.vector"), "vectors")
    classes = written(vectors.groupBy("label", "vector").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight")), "classes")
    ordered = _keyed(classes, passes).repartitionByRange("pass", "label", "size", "key", "id").sortWithinPartitions("pass", "label", "size", "key", "id")
    links = written(_window_links(ordered, min_cosine, window), "links")
    found = written(components(links), "found")
    direct = _exact_links(classes, found, min_cosine, tile)
    per_class = classes.where("weight > 1").select("id", "weight").join(direct, "id", "full").join(found.withColumnRenamed("vertex", "id"), "id", "left")
    per_class = written(per_class.select("id", (F.coalesce("weight", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("component", "id").alias("c")), "linked")
    # the members of classes with more than one vector, then each vector's class
    copies = vectors.join(classes.where("weight > 1").select("label", "vector", "id"), ["label", "vector"]).select("vec_id", "id")
    of = written(copies.join(per_class, "id").select("vec_id", "n", "c").union(per_class.join(classes.where("weight = 1").select("id"), "id").select("id", "n", "c")), "results")
    found_of = of.withColumnRenamed("vec_id", "v")
    joined = every.select("vec_id").join(found_of, F.col("vec_id") == F.col("v"), "left")
    component = F.coalesce("c", "vec_id")
    return joined.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op10_sorted_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
