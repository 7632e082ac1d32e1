import zlib

import numpy as np
import public_tokenizers
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tamis.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


LIBRARY = Tokenizer.from_file(PATH)


def ids_of(texts):
    return [[*e.ids, 0] for e in LIBRARY.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@given(st.text(max_size=80))
def test_encoder_equals_the_library(text):
    coder = packing.tokenizer(PATH)
    assert coder.encode(text + "<|endoftext|> x").tolist() + [0] == ids_of([text + "<|endoftext|> x"])[0]


@given(st.lists(st.sampled_from([" " * 5000, "\n" * 4097, "\u3000" * 4096, "\x1c" * 4500, "\t \r" * 2000, "x", " y", "\n", "<|endoftext|>", "日本", "1"]), max_size=6))
def test_long_white_space_equals_the_library(parts):
    text = "".join(parts)
    assert packing.tokenizer(PATH).encode(text).tolist() + [0] == ids_of([text])[0]


def test_very_long_runs():
    coder = packing.tokenizer(PATH)
    for text in (" " * 5_000_000 + "x", "a" + "\n" * 1_500_000, "\t" * 1_200_000 + "<|endoftext|>", "ab" * 500_000):
        assert np.array_equal(coder.encode(text), LIBRARY.encode(text, add_special_tokens=False).ids)


def test_assignment_matches_plain_greedy():
    r = np.random.default_rng(4)
    for _ in range(50):
        lengths = r.integers(1, 65, r.integers(1, 40))
        k = -(-int(lengths.sum()) // 64)
        room, cost, whole = [64] * k, [0.0] * k, []
        for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
            n = int(lengths[i])
            options = [(cost[s], s) for s in range(k) if room[s] >= n]
            if options:
                s = min(options)[1]
                whole.append((i, 0, n, s, 64 - room[s]))
                room[s] -= n
                cost[s] += packing.LINEAR * n + packing.QUADRATIC * n * n
        got = packing.assign(lengths, 64)
        assert got[: len(whole)] == whole
        gaps = [s for s in sorted(range(k), key=lambda s: (room[s], s)) if room[s]]
        rest = [x[3] for x in got[len(whole) :]]
        assert rest == sorted(rest, key=gaps.index)


@given(st.lists(st.integers(1, 64), min_size=1, max_size=60))
def test_assignment_uses_every_id_once(lengths):
    lengths = np.array(lengths)
    got = packing.assign(lengths, 64)
    seen = {i: sorted((s, n) for j, s, n, _, _ in got if j == i) for i in range(len(lengths))}
    for i, n in enumerate(lengths):
        at = 0
        for s, m in seen[i]:
            assert s == at
            at += m
        assert at == n
    fill = {}
    for _, _, n, q, o in got:
        fill.setdefault(q, []).append((o, n))
    for parts in fill.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 64
    assert sorted(fill) == list(range(-(-int(lengths.sum()) // 64)))


def test_costs_are_balanced():
    r = np.random.default_rng(2)
    lengths = r.integers(1, 400, 1000)
    cost = lambda n: packing.LINEAR * n + packing.QUADRATIC * n * n
    sums = {}
    for _, _, n, q, _ in packing.assign(lengths):
        sums[q] = sums.get(q, 0) + cost(n)
    full = np.array(list(sums.values()))
    assert full.std() / full.mean() < 0.1


def check(docs, seq_len=1024, group=2048):
    rows = docs.select("doc_id", "text").collect()
    got = packing.pack(docs, PATH, seq_len, group, with_ids=True).collect()
    want = sorted((str(r.doc_id), ids) for r, ids in zip(rows, ids_of([r.text for r in rows]), strict=True))
    assert sum(r.length for r in got) == sum(len(i) for _, i in want)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length for r in got)
    fill = {}
    for r in got:
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in fill.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= seq_len
    return got, want, fill


def test_rows(edge_docs, no_docs):
    got, want, fill = check(edge_docs, 64, 3)
    by = {}
    for r in got:
        by.setdefault((str(r.doc_id), r.doc_tokens), []).append((r.start, r.ids))
    # repeated rows apart, the pieces of a document are its ids in order
    for doc, ids in want:
        if doc not in ("1", "None", "7"):
            parts = sorted(by[doc, len(ids)])
            assert [i for _, p in parts for i in p] == ids and [s for s, _ in parts] == list(np.cumsum([0, *(len(p) for _, p in parts)])[:-1])
    assert packing.pack(no_docs, PATH).count() == 0


def test_little_padding(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").coalesce(1)
    _, _, fill = check(docs)
    used = sum(n for parts in fill.values() for _, n in parts)
    assert len(fill) * 1024 - used < 1024
