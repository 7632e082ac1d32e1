"""SentencePiece encoding with the N best segmentations, and decoding.

The lattice of a text holds every piece of the vocabulary at every place where it stands,
and a character's bytes where no piece of one character covers it.  A segmentation's score
is the sum of its pieces' scores.  Forward Viterbi gives the best score up to each place;
these scores are exact heuristics for a backward A* search from the end, which therefore
delivers whole segmentations in order of score and expands none in vain.

No piece has a space mark after another character, so the lattice of a text falls apart
before each run of space marks.  The search runs once for each distinct part (kept in a
bounded memory); then the parts' own N best are merged, part by part, into the text's.

Scores: the vocabulary file ranks pieces, it has no probabilities.  A piece of rank r
scores ``-log(r + 2)`` (Zipf's law up to a constant), a byte that of the lowest rank less
``BYTE_PENALTY``.  The scores are a parameter.  They are added up in units of ``1 / UNIT``,
so sums are exact and ties are ties: of two segmentations with one score, that goes first
which has the earlier segmentation of the last part in which they differ, and of one part,
that which has the longer piece at the last place in which they differ.

Scale: one narrow pass over the texts.  The lattice is not stored: what ends at a place is
looked up in a trie of reversed pieces, so a long part costs one number a character.
"""

from __future__ import annotations

import gc
import math
import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.llm._common import arrow_map, table

SPACE = "▁"
N_BEST = 4
BYTE_PENALTY = 4.0
UNIT = 1 << 24
#: More than any loss.
NEVER = 1 << 62
#: Distinct parts that a worker remembers; the memory is emptied when it is full.
CACHE_PARTS = 600_000
PART = re.compile(f"{SPACE}*[^{SPACE}]*")
#: Longer parts are not remembered.
PART_CHARS = 4096


class Pieces:
    """A vocabulary and its scores."""

    def __init__(self, path: str, scores: dict[str, float] | None = None):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.text = [model.id_to_piece(i) for i in range(size)]
        self.bytes = {int(self.text[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        if len(self.bytes) != 256:
            raise ValueError("the vocabulary has no byte pieces")
        plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        rank = {i: r for r, i in enumerate(sorted(plain, key=lambda i: (-model.get_score(i), i)))}
        self.score = [0] * size
        for i in plain:
            self.score[i] = round(UNIT * (-math.log(rank[i] + 2) if scores is None else scores[self.text[i]]))
        self.low = min(self.score[i] for i in plain) - round(UNIT * BYTE_PENALTY)
        for i in self.bytes.values():
            self.score[i] = self.low
        self.ids = {self.text[i]: i for i in plain}
        if any(SPACE in t.lstrip(SPACE) for t in self.ids):
            raise ValueError("a piece has a space mark after another character")
        #: Neighbouring characters inside pieces.
        self.pairs = {t[i : i + 2] for t in self.ids for i in range(len(t) - 1)}
        # a trie of reversed pieces: each node is (children by character, id or -1, score)
        self.trie: tuple[dict, int, int] = ({}, -1, 0)
        for t, i in sorted(self.ids.items(), key=lambda x: (x[0][::-1], x[1])):  # a piece comes after all its ends
            children = self.trie[0]
            for c in t[:0:-1]:
                children = children.setdefault(c, ({}, -1, 0))[0]
            children[t[0]] = ({}, i, self.score[i])
        self.raw = [b""] * size
        for i in plain:
            self.raw[i] = self.text[i].replace(SPACE, " ").encode("utf-8", "surrogatepass")
        for byte, i in self.bytes.items():
            self.raw[i] = bytes([byte])

    def into(self, part: str, end: int) -> list[tuple[int, int, int | tuple[int, ...]]]:
        """The (start, score, id or byte ids) of what ends at a place of the lattice, the longest first."""
        found, children = [], self.trie[0]
        for start in range(end - 1, -1, -1):
            node = children.get(part[start])
            if node is None:
                break
            children, i, s = node
            if i >= 0:
                found.append((start, s, i))
        if not found or found[0][0] != end - 1:
            ids = tuple(self.bytes[x] for x in part[end - 1].encode("utf-8", "surrogatepass"))
            found.insert(0, (end - 1, self.score[ids[0]] * len(ids), ids))
        found.reverse()
        return found

    def forward(self, part: str) -> list[int]:
        """The forward Viterbi score of each place."""
        root, best = self.trie[0], [0]
        for end in range(1, len(part) + 1):
            start = end - 1
            node = root.get(part[start])
            if node is None or node[1] < 0:
                top = best[start] + self.low * len(part[start].encode("utf-8", "surrogatepass"))
            else:
                top = best[start] + node[2]
            while node is not None and start:
                start -= 1
                node = node[0].get(part[start])
                if node is not None and node[1] >= 0 and (s := best[start] + node[2]) > top:
                    top = s
            best.append(top)
        return best

    def best(self, part: str) -> tuple[int, list[int], int]:
        """Score and ids of the best segmentation, and how far behind the second is: what the search finds
        for n = 2. The second leaves the best way at one place, so it loses the least that an edge into a
        place of the best way loses there."""
        root, score = self.trie[0], self.forward(part)
        place, out, gap = len(part), [], NEVER
        while place:
            start, top, came, last = place - 1, score[place], -1, -1
            node = root.get(part[start])
            if node is None or node[1] < 0:
                loss = top - score[start] - self.low * len(part[start].encode("utf-8", "surrogatepass"))
                if loss:
                    gap = min(gap, loss)
                else:
                    came = start
            while node is not None:
                if node[1] >= 0:
                    loss = top - score[start] - node[2]
                    if not loss:
                        if came >= 0:
                            gap = 0
                        came, last = start, node[1]
                    elif loss < gap:
                        gap = loss
                if not start:
                    break
                start -= 1
                node = node[0].get(part[start])
            if last >= 0:
                out.append(last)
            else:
                out += [self.bytes[x] for x in reversed(part[came].encode("utf-8", "surrogatepass"))]
            place = came
        out.reverse()
        return score[-1], out, gap

    def n_best(self, part: str, n: int) -> list[tuple[int, list[int]]]:
        """The n best segmentations (all, if fewer): score in units of ``1 / UNIT`` and ids, best first.

        Ties: at the last piece in which two differ, the longer one goes first. A state is a
        place and what follows it; its key, forward score plus score behind, is the score of
        its best completion. States complete to different segmentations, so no more of them
        are kept than segmentations are still wanted; the list is in the order of ties, since
        a state's successors take its place.
        """
        best = self.forward(part)
        out: list[tuple[int, list[int]]] = []
        keys, states = [best[-1]], [(len(part), 0, None)]
        while states and len(out) < n:
            at = keys.index(max(keys))
            place, behind, follow = states[at]
            if place == 0:
                ids = []
                while follow is not None:
                    i, follow = follow
                    ids += [i] if isinstance(i, int) else i
                out.append((behind, ids))
                del keys[at], states[at]
            else:
                found = self.into(part, place)
                keys[at : at + 1] = [best[start] + s + behind for start, s, _ in found]
                states[at : at + 1] = [(start, s + behind, (i, follow)) for start, s, i in found]
            for _ in range(len(keys) - (n - len(out))):
                low = min(keys)
                last = len(keys) - 1
                while keys[last] != low:
                    last -= 1
                del keys[last], states[last]
        return out


if sys.byteorder != "little" or array("I").itemsize != 4:
    raise ImportError("ids are kept as little-endian 32-bit arrays")


class Coder:
    def __init__(self, path: str, n: int = N_BEST, cache_parts: int = CACHE_PARTS):
        self.pieces, self.n, self.cache, self.words, self.cache_parts = Pieces(path), n, {}, {}, cache_parts

    def _part(self, part: str) -> tuple[int, bytes, int]:
        """Score and ids of the best, and how far behind the second is."""
        if len(self.cache) >= self.cache_parts:
            self.cache.clear()
        got = self._found(part)
        if len(part) <= PART_CHARS:
            self.cache[part] = got
        return got

    def _apart(self, part: str) -> list[str]:
        """The part, cut at the pairs of characters that no piece holds: there its lattice falls apart."""
        pairs = self.pieces.pairs
        cuts = [i for i in range(1, len(part)) if part[i - 1 : i + 1] not in pairs]
        return [part[i:j] for i, j in zip([0, *cuts], [*cuts, len(part)], strict=True)] if cuts else [part]

    def _found(self, part: str) -> tuple[int, bytes, int]:
        apart = self._apart(part)
        if len(apart) > 1:
            get, made = self.cache.get, self._part
            some = [get(p) or made(p) for p in apart]
            return sum(x[0] for x in some), b"".join([x[1] for x in some]), min(x[2] for x in some)
        score, ids, gap = self.pieces.best(part)
        return score, array("I", ids).tobytes(), gap

    def parts(self, text: str) -> list[str]:
        """The text with space marks, cut before each run of them; none for an empty text."""
        return PART.findall(SPACE + text.replace(" ", SPACE))[:-1] if text else []

    def _word(self, word: str) -> tuple[int, bytes, int]:
        """The same for the part of a space mark and a word."""
        if len(self.words) >= self.cache_parts:
            self.words.clear()
        got = self._found(SPACE + word)
        if len(word) < PART_CHARS:
            self.words[word] = got
        return got

    def n_best(self, text: str) -> tuple[list[bytes], list[float], list[dict[int, list[int]]]]:
        """Each part's ids in the best segmentation; the n best scores; for each, the parts that differ, with their ids."""
        if not text:
            return [], [0.0], [{}]
        words = text.split(" ")
        if "" in words or SPACE in text:
            get, made, parts, mark = self.cache.get, self._part, self.parts(text), ""
        else:  # single spaces: parts are words with a mark before them
            get, made, parts, mark = self.words.get, self._word, words, SPACE
        best_scores, ids, gaps = zip(*[get(p) or made(p) for p in parts], strict=True)
        best, gaps = sum(best_scores), np.array(gaps)
        # only the n - 1 parts with the nearest second can differ in the n best, of equal ones the first
        if len(gaps) >= self.n:
            near = np.flatnonzero(gaps <= np.partition(gaps, self.n - 2)[self.n - 2]) if self.n > 1 else gaps[:0].astype(int)
            loose = near[np.argsort(gaps[near], kind="stable")[: self.n - 1]]
        else:
            loose = np.arange(len(gaps))
        combos: list[tuple[int, dict[int, list[int]]]] = [(0, {})]
        for i in sorted(loose.tolist()):
            if gaps[i] == NEVER:
                continue
            (first, _), *others = self.pieces.n_best(mark + parts[i], self.n)
            merged = combos + [(loss + first - s, {**other, i: ids}) for s, ids in others for loss, other in combos]
            combos = sorted(merged, key=lambda x: x[0])[: self.n]  # stable: ties by the last part, then by the ones before
        return list(ids), [(best - loss) / UNIT for loss, _ in combos], [other for _, other in combos]

    def segmentations(self, text: str) -> list[tuple[float, list[int]]]:
        """The n best segmentations of a text: score and ids."""
        parts, scores, others = self.n_best(text)
        ids = [np.frombuffer(p, "<u4").tolist() for p in parts]
        return [(s, [i for k, p in enumerate(ids) for i in other.get(k, p)]) for s, other in zip(scores, others, strict=True)]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces and bytes joined, space marks as spaces, without the first one."""
        return b"".join(map(self.pieces.raw.__getitem__, ids)).decode("utf-8", "surrogatepass").removeprefix(" ")


_LOADED: dict[tuple[str, int], Coder] = {}


def coder(path: str, n: int = N_BEST) -> Coder:
    """One for each worker, file and n."""
    if (path, n) not in _LOADED:
        _LOADED[path, n] = Coder(path, n)
    return _LOADED[path, n]


@contextmanager
def _few_collections() -> Iterator[None]:
    """The search makes many short-lived lists and no cycles; collections at the usual rate would take a tenth of the time."""
    usual = gc.get_threshold()
    gc.set_threshold(100_000, 20, 20)
    try:
        yield
    finally:
        gc.set_threshold(*usual)


def encode(docs: DataFrame, path: str, n: int = N_BEST) -> DataFrame:
    """(doc_id, rank, score, ids) of the n best segmentations of each row of ``docs`` (doc_id, text), rank from 1.

    A null or empty text has one segmentation, without ids. A text with fewer than n
    segmentations has all of them. A text's own space marks decode as spaces. Repeated
    rows and null ids stay; other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, n)
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                found = c.segmentations(text.as_py() or "")
                yield pa.RecordBatch.from_arrays([pa.array([doc] * len(found), pa.int64()), pa.array(range(1, len(found) + 1), pa.int32()), pa.array([s for s, _ in found], pa.float64()), pa.array([i for _, i in found], pa.list_(pa.int32()))], ["doc_id", "rank", "score", "ids"])

    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, rank int, score double, ids array<int>")


def decode(rows: DataFrame, path: str) -> DataFrame:
    """``text`` for the column ``ids`` of ``rows``; null ids give a null text. All other columns stay."""
    names = [f for f in rows.columns if f not in ("ids", "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for b in batches:
            texts = [None if ids is None else c.decode(ids) for ids in b.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(texts, pa.string())], [*names, "text"])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in names]
    return arrow_map(rows.select(*names, "ids"), run, ", ".join([*kinds, "text string"]))


def digests(docs: DataFrame, path: str, n: int = N_BEST) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, n_found, scores, crcs, round_trip) of each row, without the ids: of
    the best segmentation the number of ids, their CRC-32 (little-endian, 32 bits each) and
    whether they decode to the text; of all found, the scores and CRC-32s, best first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, n)
        for b in batches:
            rows = []
            with _few_collections():
                for text in b.column(1):
                    t = text.as_py() or ""
                    parts, scores, others = c.n_best(t)
                    ids = b"".join(parts)
                    numbers = np.frombuffer(ids, "<u4")
                    crcs = [zlib.crc32(b"".join(_replaced(parts, other)) if other else ids) for other in others]
                    rows.append((len(numbers), crcs[0], len(scores), [round(s, 6) for s in scores], crcs, c.decode(numbers.tolist()) == t.replace(SPACE, " ")))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.bool_()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, k) for x, k in zip(columns, kinds, strict=True))], ["doc_id", "n_pieces", "ids_crc32", "n_found", "scores", "crcs", "round_trip"])

    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, n_pieces long, ids_crc32 long, n_found int, scores array<double>, crcs array<long>, round_trip boolean")


def _replaced(parts: list[bytes], other: dict[int, list[int]]) -> list[bytes]:
    parts = parts.copy()
    for i, ids in other.items():
        parts[i] = array("I", ids).tobytes()
    return parts


def op2_nbest_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
