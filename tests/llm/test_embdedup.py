import numpy as np
import pytest

from tamis.llm import embdedup


def brute(rows, cosine=0.98):
    usable = [i for i, (_, v, label) in enumerate(rows) if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {i: set() for i in range(len(rows))}
    for a in usable:
        for b in usable:
            if a < b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                    links[a].add(b)
                    links[b].add(a)
    out = {}
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        least = min(rows[j][0] for j in seen)
        out[rows[i][0]] = (len(links[i]), least, rows[i][0] == least)
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], label, 7) for i, v, label in rows], "vec_id long, embedding array<float>, label int, kept int")


@pytest.mark.parametrize(("window", "tile"), [(40, 512), (3, 16)])
def test_matches_brute_force(spark, window, tile):
    r = np.random.default_rng(3)
    rows = []
    for g in range(30):
        base = r.standard_normal(16)
        for _ in range(int(r.integers(1, 5)) if g else 90):  # one group is larger than the window and a tile
            v = (base + r.standard_normal(16) * 0.05).astype(np.float32)
            rows.append((len(rows), v.tolist(), int(g % 3)))
    rows += [(1000 + i, rows[0][1], 0) for i in range(20)] + [(2000, rows[0][1], 1)]
    got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in embdedup.near_duplicates(frame(spark, rows), window=window, tile=tile).collect()}
    want = brute(rows)
    assert sum(n for n, _, _ in got.values()) >= 0.99 * sum(n for n, _, _ in want.values())
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(got[i] == want[i] for i in want) >= 0.95 * len(want)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1, 0], 1), (1, [2, 0], 1), (2, [1, 0], None), (3, None, 1), (4, [0, 0], 1), (5, [None, 1], 1), (6, [nan, 1], 1), (7, [inf, 1], 1), (8, [], 1), (9, [1, 0, 0], 1), (10, [1e30, 0], 1), (11, [1, 0], 2)]
    got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in embdedup.near_duplicates(frame(spark, rows)).collect()}
    assert got == {**{i: (0, i, True) for i in range(12)}, 0: (2, 0, True), 1: (2, 0, False), 10: (2, 0, False)}
    assert embdedup.near_duplicates(frame(spark, rows).limit(0)).count() == 0
    twice = embdedup.near_duplicates(frame(spark, [(1, [1, 0], 1), (1, [0, 1], 1), (2, [0, 2], 1), (None, [0, 1], 1)])).collect()
    assert sorted((str(x.vec_id), x.n_links, str(x.component_id), x.kept) for x in twice) == [("1", 1, "1", True), ("1", 1, "1", True), ("2", 1, "1", False), ("None", 0, "None", True)]


def test_keys_sort_by_leading_hashes():
    v = np.random.default_rng(0).standard_normal((50, 8))
    keys = embdedup.sort_keys(v, 2)
    planes = np.random.default_rng([embdedup.SEED, 8]).standard_normal((8, 128))
    for p in range(2):
        bits = (v @ planes >= 0)[:, p * 64 : (p + 1) * 64]
        by_bits = sorted(range(50), key=lambda i: tuple(bits[i]))
        assert [tuple(bits[i]) for i in np.argsort(keys[:, p], kind="stable")] == [tuple(bits[i]) for i in by_bits]
