"""Connected components by repeated contraction, for near-duplicate links.

In each round every vertex points to the first vertex of its closed neighbourhood, and
the edges are relabelled by these pointers; loops and repeats vanish.  Even rounds order
vertices by value, which ends stars in one round, odd ones by a hash of value and round,
which shortens chains by a constant factor whatever their numbering.

Scale: edges and pointers are written tables, so a round is two aggregations with
map-side combining and joins of two exchanged sides, which adaptive execution splits
where a vertex is hot.  Nothing is collected but one count a round.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.llm._common import written

MAX_ROUNDS = 100


def components(edges: DataFrame) -> DataFrame:
    """(vertex, component) of all vertices of ``edges`` (a long, b long): the smallest vertex that each reaches.

    Rows with a null end are ignored; repeated rows and loops change nothing, but a
    vertex with only a loop is in the result. No edges give no rows.
    """
    ends = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a is not null and b is not null")
    current = written(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    mapping = written(current.select(F.explode(F.array("a", "b")).alias("vertex")).distinct().select("vertex", F.col("vertex").alias("rep")), "vertices")
    current = current.where("a <> b")
    for r in range(MAX_ROUNDS):
        if current.isEmpty():
            break
        order = lambda c: F.struct(*([F.xxhash64(F.lit(r), F.col(c)).alias("h")] if r % 2 else []), F.col(c).alias("v"))  # noqa: B023, E731
        both = current.select(F.col("a").alias("u"), F.col("b").alias("w")).union(current.select("b", "a"))
        pointers = written(both.groupBy("u").agg(F.min(order("w")).alias("m")).select("u", F.least("m", order("u"))["v"].alias("p")), "pointers")
        mapping = written(mapping.join(pointers, F.col("rep") == F.col("u"), "left").select("vertex", F.coalesce("p", "rep").alias("rep")), "mapping")
        to_a, to_b = pointers.select(F.col("u").alias("a"), F.col("p").alias("pa")), pointers.select(F.col("u").alias("b"), F.col("p").alias("pb"))
        moved = current.join(to_a, "a").join(to_b, "b").where("pa <> pb")
        current = written(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
    else:
        raise RuntimeError("components did not settle")
    least = written(mapping.groupBy("rep").agg(F.min("vertex").alias("component")), "components")
    return mapping.join(least, "rep").select("vertex", "component")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same connections in fewer edges: (smallest vertex, other vertex) of each local component."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent[x]
        return root

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    out = [(find(x), x) for x in parent]
    out = [x for x in out if x[0] != x[1]]
    return np.array([x[0] for x in out], np.int64), np.array([x[1] for x in out], np.int64)
