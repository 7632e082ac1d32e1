import numpy as np
import xxhash
from hypothesis import given
from hypothesis import strategies as st

from tamis.llm import graph, simhash


def slow_fingerprint(text, words=3):
    parts = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    parts = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", parts) if w]
    grams = [" ".join(parts[i : i + words]) for i in range(len(parts) - words + 1)] or ([" ".join(parts)] if parts else [])
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


@given(st.text(alphabet="aBc \t\nÉz ", max_size=60))
def test_fingerprint_matches_brute_force(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def slow_components(fps, ids):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                parent[find(i)] = find(j)
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[find(i)] = min(least.get(find(i), x), x)
    return [least.get(find(i)) for i in range(len(fps))]


def near_fps(n, seed=0):
    """Chains and clusters of fingerprints a few bits apart, and lone ones."""
    r = np.random.default_rng(seed)
    out = [int(x) for x in r.integers(0, 1 << 63, n // 2, np.uint64)]
    while len(out) < n:
        x = out[int(r.integers(max(0, len(out) - 10), len(out)))]
        for b in r.choice(64, int(r.integers(1, 4)), replace=False):
            x ^= 1 << int(b)
        out.append(x)
    return out


def test_pivot_tables_discard_no_link():
    fps = np.array(near_fps(300), np.uint64)
    keys, table = simhash.band_keys(simhash.distances(fps)), simhash.distances(fps).astype(int)
    for i in range(len(fps)):
        for j in range(i):
            if int(fps[i] ^ fps[j]).bit_count() <= 2:
                assert (keys[i] == keys[j]).any() and np.abs(table[i] - table[j]).max() <= 2


def test_links_with_hot_keys(spark):
    fps = list(dict.fromkeys(near_fps(400, 1)))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    want = slow_components(fps, signed)
    for cap in (simhash.BUCKET_CAP, 1):  # compared in keys, or by shared variants
        got = {r.vertex: r.component for r in graph.components(simhash.links(df, bucket_cap=cap)).collect()}
        mine = [got.get(x, x) for x in signed]
        groups = lambda labels: {frozenset(i for i, y in enumerate(labels) if y == x) for x in labels}
        assert groups(mine) == groups(want)


def test_components(spark):
    import random

    r = random.Random(4)
    names = r.sample(range(1000), 300)
    edges = [(names[i], names[i + 1]) for i in range(99)] + [(names[100], names[i]) for i in range(101, 200)] + [(names[200], names[200]), (names[201], names[202]), (names[202], names[201])]
    got = {x.vertex: x.component for x in graph.components(spark.createDataFrame([*edges, (None, 1)], "a long, b long")).collect()}
    assert {got[x] for x in names[:100]} == {min(names[:100])} and {got[x] for x in names[100:200]} == {min(names[100:200])}
    assert got[names[200]] == names[200] and got[names[201]] == got[names[202]] and len(got) == 203
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rows(edge_docs, no_docs):
    docs = edge_docs.withColumnRenamed("score", "fp").withColumnRenamed("labels", "component_id")
    rows = docs.select("doc_id", "text").collect()
    got = simhash.near_duplicates(docs).collect()
    want = slow_components([slow_fingerprint(r.text) for r in rows], [r.doc_id for r in rows])
    assert sorted(map(repr, [(r.doc_id, r.fp % (1 << 64), r.component_id) for r in got])) == sorted(map(repr, [(r.doc_id, slow_fingerprint(r.text), c) for r, c in zip(rows, want, strict=True)]))
    assert simhash.near_duplicates(no_docs).count() == 0


def test_one_of_each_group_stays(edge_docs, no_docs):
    kept = simhash.keep_one(edge_docs)
    assert kept.columns == edge_docs.columns
    by = [(str(r.doc_id), r.text) for r in kept.select("doc_id", "text").collect()]
    # 2 (null), 3 and the null-id row are one group of empty texts; a row without an id stays alone only
    assert ("2", None) in by and ("3", "") not in by and by.count(("1", "Released under the MIT License.")) == 1
    assert sum(i == "None" for i, _ in by) == 1 and sum(i == "7" for i, _ in by) == 2
    assert simhash.keep_one(no_docs).count() == 0


def test_one_row_of_each_repeated_head_stays(spark):
    rows = [(1, "alpha beta gamma delta"), (1, "one two three four five")] * 2 + [(None, "of no id at all")] * 3 + [(None, "something else without id")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, kept)) == sorted(map(str, spark.createDataFrame(list(dict.fromkeys(rows)), "doc_id long, text string").collect()))


def test_all_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in simhash.op9_simhash_pivots(spark, small).collect()}
    want = slow_components([slow_fingerprint(r.text) for r in docs], [r.doc_id for r in docs])
    assert len(got) == len(docs)
    for r, c in zip(docs, want, strict=True):
        assert got[r.doc_id].component_id == c and got[r.doc_id].fingerprint == f"{slow_fingerprint(r.text):016x}"
