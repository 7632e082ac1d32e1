import numpy as np
import pytest

from tamis.llm import neighbours


def table(spark, vectors, ids=None):
    rows = [(i if ids is None else ids[i], None if v is None else [None if x is None else float(x) for x in v], 0, 1.0) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int, score double")


def brute(ids, x, q, k):
    d = np.sqrt(((x - x[q]) ** 2).sum(1))
    order = np.lexsort((ids, d))
    return [(int(ids[i]), d[i]) for i in order if ids[i] != ids[q]][:k]


@pytest.mark.parametrize("block_rows", [64, 100_000])
def test_recall(spark, block_rows):
    r = np.random.default_rng(1)
    x = np.concatenate([r.standard_normal((400, 16)), r.standard_normal((1, 16)) + 0.01 * r.standard_normal((100, 16))]).astype(np.float32)
    df = table(spark, x.tolist())
    got = neighbours.search(df.where("vec_id % 20 = 0"), df, block_rows=block_rows, query_rows=16).collect()
    hit = total = 0
    for q in range(0, 500, 20):
        own = sorted((a["rank"], a.vec_id, a.score) for a in got if a.query_id == q)
        assert [a[0] for a in own] == list(range(1, 11))
        want = brute(np.arange(500), x.astype(np.float64), q, 10)
        exact = {i: d for i, d in brute(np.arange(500), x.astype(np.float64), q, 499)}
        assert all(exact[i] == s for _, i, s in own)
        assert [(s, i) for _, i, s in own] == sorted((s, i) for _, i, s in own)
        hit += len({i for _, i, _ in own} & {i for i, _ in want})
        total += 10
    assert hit / total >= 0.9


def test_edges(spark):
    bad = [None, [], [0, 0], [None, 1], [float("nan"), 1], [float("inf"), 1]]
    df = table(spark, [[1, 0], [1, 0], [1, 0], [0, 1], *bad])
    got = neighbours.search(df, df).collect()
    assert {r.query_id for r in got} == {0, 1, 2, 3}
    assert [(r["rank"], r.vec_id) for r in got if r.query_id == 0] == [(1, 1), (2, 2), (3, 3)]
    same = table(spark, [[1, 0], [1, 0], [0, 1]], [1, 1, None])
    assert neighbours.search(same, same).count() == 0
    assert neighbours.search(df.limit(0), df).count() == 0 and neighbours.search(df, df.limit(0)).count() == 0


def share(ids, x, queries, k=10):
    """Recall, and share of the vectors whose distance is computed."""
    index, hit, verified = neighbours.Index.built(ids, x), 0, 0
    for q in queries:
        i, d, n = index.nearest(int(ids[q]), x[q], k)
        want = brute(ids, x, q, k)
        hit += len({j for j, _ in want} & set(i.tolist()))
        verified += n
        exact = np.sqrt(((x - x[q]) ** 2).sum(1))
        assert all(exact[np.flatnonzero(ids == j)[0]] == s for j, s in zip(i, d, strict=True))
    return hit / (k * len(queries)), verified / (len(queries) * len(x))


def test_collisions_prune():
    r = np.random.default_rng(2)
    centres = r.standard_normal((200, 64))
    x = centres[r.integers(0, 200, 8192)] + 0.3 * r.standard_normal((8192, 64))
    recall, verified = share(r.permutation(8192), x, range(0, 8192, 256))
    assert recall >= 0.9 and verified < 0.05
    # without any clusters, 64 dimensions leave the nearest not much nearer than the rest
    recall, verified = share(r.permutation(8192), r.standard_normal((8192, 64)), range(0, 8192, 256))
    assert recall >= 0.9 and verified < 0.3


def test_recall_of_the_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").where(neighbours.usable()).select("vec_id", "embedding").toPandas()
    ids, x = table["vec_id"].to_numpy(), np.stack(table["embedding"].to_numpy()).astype(np.float64)
    recall, verified = share(ids, x, np.flatnonzero(ids % 100 == 0))
    assert recall >= 0.9 and verified < 0.5


def test_index_survives_packing():
    r = np.random.default_rng(5)
    x = r.standard_normal((300, 8))
    one = neighbours.Index.built(np.arange(300), x, 16)
    two = neighbours.Index.unpacked(*one.packed())
    for q in range(0, 300, 30):
        a, b = one.nearest(q, x[q], 5), two.nearest(q, x[q], 5)
        assert a[0].tolist() == b[0].tolist() and a[1].tolist() == b[1].tolist()
    far = one.nearest(-1, np.full(8, 1e9), 5)  # a query far outside of all projections
    assert far[0].tolist() == [i for i, _ in brute(np.arange(301), np.vstack([x, np.full(8, 1e9)]), 300, 5)]


def test_threshold_is_met():
    least, radius = neighbours.needed(40, 0.5, 0.02)
    r = np.random.default_rng(0)
    hits = (np.abs(r.standard_normal((4000, 40))) <= radius).sum(1) >= least
    assert 0.96 <= hits.mean() <= 1
