"""Nearest neighbours by collision counting over single-projection sorted arrays.

Each block of vectors has an index: for each of ``PROJECTIONS`` random directions the
sorted projections of its vectors.  A query opens a window around its own projection in
every array and widens all windows together (virtual rehashing: no bucket is rebuilt, the
radius alone grows).  A vector that lies in the windows of ``COLLISIONS`` of the directions
is a candidate, and its true distance is computed.  A query is done when a vector as near as
its k-th nearest would, by the normal law of projections, have missed that many windows
with a chance under ``MISS`` only; or when all vectors of the block are candidates.  The
more projections, the sharper the count tells near vectors from far ones: of vectors
half as far again as the k-th nearest, about one in a hundred is verified.

Scale: every vector is indexed, in blocks of about ``BLOCK_ROWS`` by a hash of its number,
so memory is bounded; the indexes are built once, and written.  Queries, in blocks of
``QUERY_ROWS``, meet every block of the index, which is what a search of a stated query set
over all rows asks for: queries are repeated for each index block, an index for each query
block, and of each meeting only the k nearest go on, which are merged for each query.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tamis.llm._common import importable, table, written

PROJECTIONS = 128
#: Share of the windows that a candidate lies in, at least.
COLLISIONS = 0.5
#: Chance of passing over a vector as near as the k-th, as the radius is chosen.
MISS = 0.07
#: Growth of the radius from one round to the next, at least.
WIDEN = 1.12
K = 10
BLOCK_ROWS = 16_384
QUERY_ROWS = 65_536
SEED = 3


def usable(vector: str = "embedding") -> F.Column:
    """True for vectors that are not null, not all zero, and without null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


@functools.cache
def needed(m: int = PROJECTIONS, collisions: float = COLLISIONS, miss: float = MISS) -> tuple[int, float]:
    """The collision threshold, and the least radius, in units of the distance, at which a
    vector collides that often but for a chance of ``miss``."""
    least = math.ceil(collisions * m)

    def missed(r: float) -> float:
        p = math.erf(r / math.sqrt(2))
        return sum(math.comb(m, i) * p**i * (1 - p) ** (m - i) for i in range(least))

    low, high = 0.0, 10.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if missed(mid) > miss else (low, mid)
    return least, high


class Index:
    """Sorted projections of one block, whose ids ascend."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, order: np.ndarray, sorted_: np.ndarray):
        self.ids, self.vectors, self.order = ids, vectors, order.ravel()
        m, n = sorted_.shape
        self.directions = directions(m, vectors.shape[1])
        # one ascending array of all projections: direction j is moved by j gaps
        self.gap = 4.0 * (float(np.abs(sorted_).max(initial=0.0)) + 1e-9)
        self.flat = (sorted_ + self.gap * np.arange(m)[:, None]).ravel()
        self.starts, self.lasts = np.arange(m) * n, np.arange(1, m + 1) * n
        self.squares = (vectors * vectors).sum(1)

    @classmethod
    def built(cls, ids: np.ndarray, vectors: np.ndarray, m: int = PROJECTIONS) -> Index:
        by = np.argsort(ids, kind="stable")
        ids, vectors = ids[by], vectors[by]
        values = directions(m, vectors.shape[1]) @ vectors.T
        order = np.argsort(values, axis=1, kind="stable").astype(np.int32)
        return cls(ids, vectors, order, np.take_along_axis(values, order, 1))

    def packed(self) -> list[bytes]:
        """What ``unpacked`` takes."""
        m = len(self.directions)
        values = self.flat.reshape(m, -1) - self.gap * np.arange(m)[:, None]
        return [self.ids.astype("<i8").tobytes(), self.vectors.astype("<f8").tobytes(), self.order.astype("<i4").tobytes(), values.astype("<f8").tobytes()]

    @classmethod
    def unpacked(cls, ids: bytes, vectors: bytes, order: bytes, values: bytes) -> Index:
        n = len(ids) // 8
        return cls(np.frombuffer(ids, "<i8"), np.frombuffer(vectors, "<f8").reshape(n, -1), np.frombuffer(order, "<i4"), np.frombuffer(values, "<f8").reshape(-1, n))

    def nearest(self, query_id: int, query: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids and distances of the k nearest found, nearest first, ties to the smaller id, without the query's own id; and the number of distances computed."""
        n, m = len(self.ids), len(self.directions)
        least, scale = needed(m)
        # a projection beyond all others opens no window earlier or later than one just outside
        at = np.clip(self.directions @ query, -self.gap / 4, self.gap / 4) + self.gap * np.arange(m)
        low = np.clip(np.searchsorted(self.flat, at), self.starts, self.lasts)
        high = low.copy()
        counts, checked = np.zeros(n, np.int16), self.ids == query_id
        found_i, found_d, verified, own = np.zeros(0, np.int64), np.zeros(0), 0, float(query @ query)
        # the first radius opens windows of some hundredths of the block
        some = max(k, n // 64)
        around = self.flat[np.clip(low + some, self.starts, self.lasts - 1)] - self.flat[np.clip(low - some, self.starts, self.lasts - 1)]
        radius = max(float(np.median(around)) / 2, 1e-12)
        while True:
            edges = np.searchsorted(self.flat, np.concatenate([at - radius, at + radius]))
            left, right = np.minimum(np.clip(edges[:m], self.starts, self.lasts), low), np.maximum(np.clip(edges[m:], self.starts, self.lasts), high)
            new = [self.order[a:b] for a, b in zip(np.concatenate([left, high]).tolist(), np.concatenate([low, right]).tolist(), strict=True) if a < b]
            low, high = left, right
            if new:
                counts += np.bincount(np.concatenate(new), minlength=n).astype(np.int16)
                fresh = np.flatnonzero((counts >= least) & ~checked)
                if len(fresh):
                    checked[fresh] = True
                    verified += len(fresh)
                    # products of the matrix leave out what is surely beyond the k nearest; the rest is measured as told
                    square = self.squares[fresh] + own - 2 * (self.vectors[fresh] @ query)
                    limit = found_d[-1] ** 2 if len(found_d) == k else np.partition(square, k - 1)[k - 1] if len(fresh) > k else np.inf
                    fresh = fresh[square <= limit + 1e-9 * (own + self.squares[fresh])]
                    d = np.sqrt(((self.vectors[fresh] - query) ** 2).sum(1))
                    found_i, found_d = np.concatenate([found_i, fresh]), np.concatenate([found_d, d])
                    best = np.lexsort((found_i, found_d))[:k]
                    found_i, found_d = found_i[best], found_d[best]
            done = len(found_d) == k and radius >= scale * found_d[-1]
            if done or checked.all() or (low == self.starts).all() and (high == self.lasts).all():
                return self.ids[found_i], found_d, verified
            if len(found_d) == k:  # never beyond what the k nearest so far ask for
                radius = min(radius * WIDEN, max(scale * found_d[-1], radius))
            else:  # counts grow no faster than the radius
                radius *= max(WIDEN, least / max(int(counts[~checked].max()), 1))


@functools.cache
def directions(m: int, size: int) -> np.ndarray:
    return np.random.default_rng([SEED, size]).standard_normal((m, size))


def _build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """A row for each length of vector."""
    out = []
    for size, some in rows.groupby(rows["vector"].map(len)):
        out.append((key[0], size, *Index.built(some["vec_id"].to_numpy(np.int64), np.stack(some["vector"].to_numpy()).astype(np.float64)).packed()))
    return pd.DataFrame(out, columns=["b", "size", "ids", "vectors", "orders", "values"])


def _search(key: tuple, queries: pd.DataFrame, indexes: pd.DataFrame, k: int) -> pd.DataFrame:
    ids, found, scores, asked = [], [], [], []
    for x in indexes.itertuples(index=False):
        index = Index.unpacked(x.ids, x.vectors, x.orders, x.values)
        for q, v in zip(queries["vec_id"].tolist(), queries["vector"], strict=True):
            if len(v) == x.size:  # vectors of one length are compared
                i, d, _ = index.nearest(q, np.asarray(v, np.float64), k)
                asked.append(np.full(len(i), q))
                found.append(i)
                scores.append(d)
    ids = np.concatenate(asked) if asked else np.zeros(0, np.int64)
    return pd.DataFrame({"query_id": ids, "vec_id": np.concatenate(found) if asked else ids, "score": np.concatenate(scores) if asked else np.zeros(0)})


def search(queries: DataFrame, rows: DataFrame, k: int = K, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each of ``queries`` its k nearest of ``rows`` (both vec_id,
    embedding) by Euclidean distance in double precision, ties to the smaller vec_id.

    Vectors that are null, all zero, or hold null or non-finite components take no part, nor
    do rows with a null vec_id, nor the query's own vec_id as an answer. Repeated rows of one
    vec_id count once, as the one with the smallest vector. Vectors of another length are not compared. Fewer
    than k rows give as many as there are; an empty table gives none. Other columns are ignored.
    """
    importable(rows.sparkSession)
    clean = lambda df: df.where(usable()).where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector")).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    rows, queries = written(clean(rows), "vectors"), written(clean(queries), "queries")
    blocks = max(1, math.ceil(rows.count() / block_rows))
    query_blocks = max(1, math.ceil(queries.count() / query_rows))
    number = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    index = written(rows.withColumn("b", number(blocks)).groupBy("b").applyInPandas(_build, "b int, size int, ids binary, vectors binary, orders binary, values binary"), "index")
    # a meeting of one block of the index and one of queries is a group
    left = queries.select("*", number(query_blocks).alias("q"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"))
    right = index.select("*", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("q"))
    near = left.groupBy("q", "b").cogroup(right.groupBy("q", "b")).applyInPandas(lambda key, a, b: _search(key, a, b, k), "query_id long, vec_id long, score double")
    best = W.partitionBy("query_id").orderBy("score", "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return search(rows.where("vec_id % 100 = 0"), rows)
