import itertools
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tamis.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def coder():
    return pieces.Coder(PATH)


def brute(coder, part):
    """All segmentations (score, ids) of a part by the vocabulary alone, best first, ties by the last piece that differs, the longer first."""
    p = coder.pieces

    def ways(end):
        if end == 0:
            return [(0, (), ())]
        out = []
        for start in range(end):
            text = part[start:end]
            if text in p.ids:
                s, ids = p.score[p.ids[text]], (p.ids[text],)
            elif len(text) == 1:
                ids = tuple(p.bytes[x] for x in text.encode())
                s = sum(p.score[i] for i in ids)
            else:
                continue
            out += [(before + s, head + ids, (start, *starts)) for before, head, starts in ways(start)]
        return out

    return [(s, list(ids)) for s, ids, _ in sorted(ways(len(part)), key=lambda x: (-x[0], x[2]))]


@pytest.mark.parametrize("part", ["▁the", "▁atthin", "▁▁▁a", "▁日本", "▁éàtion,", "▁", "▁aaaaaaa", "ababab", "日本日本"])
@pytest.mark.parametrize("n", [1, 2, 4, 9])
def test_part_matches_brute_force(coder, part, n):
    want = brute(coder, part)
    assert coder.pieces.n_best(part, n) == want[:n]
    assert coder.pieces.best(part) == (*want[0], want[0][0] - want[1][0] if len(want) > 1 else pieces.NEVER)


@pytest.mark.parametrize("text", ["the in", "a b, c.", "  two  spaces ", "x\ny", "aa aa aa", "in in"])
def test_text_matches_brute_force(coder, text):
    parts = [brute(coder, p) for p in coder.parts(text)]
    every = itertools.product(*(list(enumerate(p)) for p in parts))
    want = sorted(((sum(s for _, (s, _) in x), tuple(r for r, _ in x), [i for _, (_, ids) in x for i in ids]) for x in every), key=lambda x: (-x[0], x[1][::-1]))[:4]
    got = coder.segmentations(text)
    assert [s for s, _ in got] == [s / pieces.UNIT for s, _, _ in want]
    assert [ids for _, ids in got] == [ids for *_, ids in want]
    assert all(coder.decode(ids) == text for _, ids in got)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60).filter(lambda t: pieces.SPACE not in t))
def test_round_trip(text):
    coder = pieces.coder(PATH)
    found = coder.segmentations(text)
    assert all(coder.decode(ids) == text for _, ids in found)
    assert [s for s, _ in found] == sorted((s for s, _ in found), reverse=True)


@pytest.mark.parametrize("text", ["internationalization" * 500, "a" * 9000, "the\nlonger\ntexts\nof\nlines\n" * 400, "\u65e5\u672cQUJDREVGR0hJSktMTU5PUFFSU1RVVldYWVo0" * 300, "x " + " " * 9000 + "in" * 5000, "ab" * 25000])
def test_long_parts_are_searched_whole(coder, text):
    marked = pieces.SPACE + text.replace(" ", pieces.SPACE)
    want = coder.pieces.n_best(marked, 4)  # the lattice of the whole text
    got = coder.segmentations(text)
    assert np.allclose([s for s, _ in got], [s / pieces.UNIT for s, _ in want], rtol=0, atol=1e-6)
    assert all(coder.decode(ids) == text for _, ids in got)
    # best scores up to each place, by plain dynamic programming over the vocabulary
    best, ids, score, longest = [0.0], coder.pieces.ids, coder.pieces.score, max(map(len, coder.pieces.ids))
    for end in range(1, len(marked) + 1):
        c = marked[end - 1]
        options = [best[end - n] + score[ids[marked[end - n : end]]] for n in range(1, min(end, longest) + 1) if marked[end - n : end] in ids]
        if c not in ids:
            options.append(best[-1] + sum(score[coder.pieces.bytes[x]] for x in c.encode()))
        best.append(max(options))
    assert best[-1] / pieces.UNIT == got[0][0]


def test_rows(spark, edge_docs, no_docs):
    got = pieces.digests(edge_docs, PATH).collect()
    assert len(got) == edge_docs.count() and all(r.round_trip for r in got)
    assert {r.n_pieces for r in got if r.doc_id in (2, 3)} == {0}
    assert pieces.digests(no_docs, PATH).count() == 0
    rows = pieces.encode(edge_docs.where("doc_id in (1, 6)"), PATH)
    back = pieces.decode(rows.withColumnRenamed("score", "weight"), PATH).collect()
    texts = {r.text for r in edge_docs.where("doc_id in (1, 6)").collect()}
    assert {r.text for r in back} == texts and {r["rank"] for r in back} == {1, 2, 3, 4}
    crcs = {(r.doc_id, k): c for r in got for k, c in enumerate(r.crcs, 1)}
    assert all(crcs[r.doc_id, r["rank"]] == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in rows.collect())
