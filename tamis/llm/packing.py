"""Cost-balanced packing of tokenised documents into fixed-length sequences.

Every document becomes its token ids followed by one end id.  Whole stretches of
``seq_len`` ids fill sequences of their own; the rest of each document is packed by
estimated cost.  A piece of ``n`` ids costs ``linear * n + quadratic * n * n`` (attention
stays inside a piece), and pieces, longest first, go to the cheapest sequence that
still has room.  What fits nowhere whole is cut over the remaining gaps, so a group of
pieces takes the fewest sequences that can hold it: its padding, over all of them, is less
than ``seq_len``.

Scale: one narrow pass, no shuffle.  Groups of ``group_pieces`` rests are packed as they
stream by, so memory is bounded by a group, however many rows a partition has.  Costs are
balanced within a group; a whole stretch has the highest cost that a sequence can have,
and groups differ as the lengths of their documents do.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.llm._common import arrow_map, table

SEQ_LEN = 1024
END_ID = 0
#: Relative cost of an id in the feed-forward part and of a pair of ids in attention.
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
GROUP_PIECES = 2048
#: The byte-level vocabulary's own split of a text into words (a fixed value of the format).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Runs of the white space that ``SPLIT`` knows which are split off by hand: its look-ahead
#: tracks back over a run, and the matcher's stack has an end.
LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{4096,}")

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
SCHEMA_IDS = SCHEMA + ", ids array<int>"


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteTokenizer:
    """Ids of a byte-level BPE file, equal to ``Tokenizer.encode(text, add_special_tokens=False)``.

    The file's vocabulary is handed to a faster encoder of the same algorithm, whose ranks
    are ids; that holds where ids follow the order of merges, which is checked on loading.
    Special tokens' strings in a text are taken as such, as the library does.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        symbols, special = byte_symbols(), {t["content"]: t["id"] for t in told["added_tokens"]}
        ranks = {bytes(map(symbols.__getitem__, t)): i for t, i in told["model"]["vocab"].items() if t not in special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in told["model"]["merges"]]
        if [told["model"]["vocab"]["".join(m)] for m in merges] != list(range(256, 256 + len(merges))):
            raise ValueError(f"the ids of {path} do not follow its merges")
        self.coder = tiktoken.Encoding("bytes", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)
        self.special = tuple(special)

    def encode(self, text: str) -> np.ndarray:
        out, at = [], 0
        for m in LONG_SPACE.finditer(text):
            # a run is one word, but for its last character where a word follows
            end = m.end() - (m.end() < len(text) and not text.startswith(self.special, m.end()))
            word = text[m.start() : end].encode()
            out += [self.coder.encode_to_numpy(text[at : m.start()], allowed_special="all"), np.array(self.coder._encode_single_piece(word), np.uint32)]
            at = end
        last = self.coder.encode_to_numpy(text[at:], allowed_special="all")
        return np.concatenate([*out, last]) if out else last


_LOADED: dict[str, ByteTokenizer] = {}


def tokenizer(path: str) -> ByteTokenizer:
    """One for each worker and file."""
    if path not in _LOADED:
        _LOADED[path] = ByteTokenizer(path)
    return _LOADED[path]


def assign(lengths: np.ndarray, seq_len: int = SEQ_LEN, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """Packs rests of ``lengths`` (each from 1 to ``seq_len``): (piece, its start, length,
    sequence, offset there), every id once, sequences numbered from 0 and gapless.

    Longest first, each whole to the cheapest sequence with room, ties to the lowest
    number; then those that fit nowhere, cut over the gaps from the fullest sequence on.
    """
    total = int(lengths.sum())
    k = -(-total // seq_len)
    used, cost, out, left = np.zeros(k, np.int64), np.zeros(k), [], []
    for i in np.lexsort((np.arange(len(lengths)), -lengths)).tolist():
        n = int(lengths[i])
        open_cost = np.where(used + n <= seq_len, cost, np.inf)
        s = int(open_cost.argmin())
        if open_cost[s] == np.inf:
            left.append(i)
            continue
        out.append((i, 0, n, s, int(used[s])))
        used[s] += n
        cost[s] += linear * n + quadratic * n * n
    gaps = iter(np.argsort(-used, kind="stable").tolist())
    s = next(gaps, None)
    for i in left:
        start, n = 0, int(lengths[i])
        while start < n:
            while used[s] == seq_len:
                s = next(gaps)
            take = min(n - start, seq_len - int(used[s]))
            out.append((i, start, take, s, int(used[s])))
            used[s] += take
            start += take
    return out


def pack(docs: DataFrame, tokenizer_path: str, seq_len: int = SEQ_LEN, group_pieces: int = GROUP_PIECES, with_ids: bool = False) -> DataFrame:
    """Pieces of all rows of ``docs`` (doc_id, text): the columns of ``SCHEMA``, and ``ids`` on demand.

    A null or empty text is the end id alone. Repeated rows are packed each by itself; a
    null doc_id stays null. An empty table gives no pieces; other columns are ignored.
    ``sequence_id`` is unique over the result: the task's number, then a count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        next_id = (task.partitionId() if task else 0) << 36
        coder, rests, rows = tokenizer(tokenizer_path), [], []
        end = np.array([END_ID], "<u4").tobytes()

        def piece(doc: int, ids: bytes, start: int, n: int, total: int, sequence: int, offset: int) -> tuple:
            part = ids[4 * start : 4 * (start + n)]
            row = (doc, start, n, zlib.crc32(part), total, sequence, offset)
            return (*row, np.frombuffer(part, "<i4")) if with_ids else row

        def close() -> None:
            nonlocal next_id
            if not rests:
                return
            last = 0
            for i, start, n, s, offset in assign(np.array([x[3] for x in rests]), seq_len):
                doc, ids, at, _, total = rests[i]
                part = ids[4 * start : 4 * (start + n)]
                row = (doc, at + start, n, zlib.crc32(part), total, next_id + s, offset)
                rows.append((*row, np.frombuffer(part, "<i4")) if with_ids else row)
                last = max(last, s)
            next_id += last + 1
            rests.clear()

        def batch() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in range(7 + with_ids)]
            rows.clear()
            kinds = [pa.int64()] * 7 + [pa.list_(pa.int32())] * with_ids
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names[: 7 + with_ids])

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = coder.encode(text.as_py() or "").tobytes() + end
                total = len(ids) // 4
                whole = total - total % seq_len
                for start in range(0, whole, seq_len):
                    rows.append(piece(doc, ids, start, seq_len, total, next_id, 0))
                    next_id += 1
                if whole < total:
                    rests.append((doc, ids[4 * whole :], whole, total - whole, total))
                    if len(rests) >= group_pieces:
                        close()
            yield batch()
        close()
        yield batch()

    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, SCHEMA_IDS if with_ids else SCHEMA)


def op6_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
