"""SimHash near-duplicates with pivot distance tables.

A fingerprint has 64 majority bits of the XXH64 of a text's word shingles.  For each
distinct fingerprint the Hamming distances to ``PIVOTS`` reference fingerprints are
computed once.  The references are zero, one mask for each block of two bits, and random
ones; the distances to zero and to a mask give the weight of the block.  Two fingerprints
that differ in at most two bits differ in the weights of at most two blocks, so of the
four bands of eight blocks at least two agree: the six pairs of bands are the keys of a
complete candidate search.  Of fingerprints with equal keys, pairs whose largest distance
difference is over two are discarded (triangle inequality), and the rest are verified.

A key with more than ``bucket_cap`` fingerprints is not compared pair by pair.  Its
members go by an exact way of bounded groups: each gives its 65 variants of at most one
flipped bit; two fingerprints within two bits share a variant, those that share one are
within two bits, and a variant has at most 65 of them.

Scale: texts are read once and never shuffled; what is shuffled is a row of some 60 bytes
for each distinct fingerprint and key.  Exact copies are one fingerprint from the start.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.llm._common import arrow_map, table, written
from tamis.llm.graph import components, forest

SHINGLE_WORDS = 3
SEED = 42
MAX_BITS = 2
BANDS = 4
BLOCK_BITS = 2
BUCKET_CAP = 2048
BLOCKS = 64 // BLOCK_BITS
#: Reference fingerprints: zero, the blocks' masks, and random ones.
RANDOM_PIVOTS = 15
_MASKS = np.array([((1 << BLOCK_BITS) - 1) << BLOCK_BITS * i for i in range(BLOCKS)], np.uint64)
PIVOTS = np.concatenate([np.zeros(1, np.uint64), _MASKS, np.random.default_rng(9).integers(0, 1 << 64, RANDOM_PIVOTS, np.uint64)])
#: Shingles that are hashed before their bits are added up.
PART = 1 << 16


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """64 bits, unsigned. A-Z is lower-cased and words are split at ASCII white space.

    A text of fewer words has the bits of its whole sequence; one without words has 0.
    """
    import xxhash

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined, digest = b" ".join(parts), xxhash.xxh64_intdigest
    if len(parts) <= words:
        return digest(joined, SEED)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    first, last = starts[: len(parts) - words + 1], ends[words - 1 :]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(first), PART):
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(first[at : at + PART].tolist(), last[at : at + PART].tolist(), strict=True)), np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(first), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, text_hash, fp) of each row; fp holds the 64 bits as a signed long. A null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), words) for t in b.column(2)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64))], ["doc_id", "text_hash", "fp"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("text_hash"), text.alias("text")), run, "doc_id long, text_hash long, fp long")


def distances(fps: np.ndarray) -> np.ndarray:
    """The pivot distance table: row i has the Hamming distances of fps[i] to all pivots."""
    return np.bitwise_count(fps[:, None] ^ PIVOTS[None, :])


def band_keys(table: np.ndarray) -> np.ndarray:
    """Row i: the six keys of a row of the distance table, made of the weights of two bands' blocks."""
    weights = (table[:, :1].astype(np.int64) + BLOCK_BITS - table[:, 1 : 1 + BLOCKS]) // 2
    per = BLOCKS // BANDS
    digits = (BLOCK_BITS + 1) ** np.arange(per, dtype=np.int64)
    bands = [weights[:, i * per : (i + 1) * per] @ digits for i in range(BANDS)]
    base = (BLOCK_BITS + 1) ** per
    return np.stack([(k * base + bands[i]) * base + bands[j] for k, (i, j) in enumerate(combinations(range(BANDS), 2))], 1)


def _pivot_table(classes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            dist = distances(fps.view(np.uint64))
            keys = band_keys(dist)
            n = keys.shape[1]
            rows = np.repeat(dist.astype(np.uint8), n, 0)
            packed = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)), pa.py_buffer(rows.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(fps, n)), packed], ["key", "fp", "dist"])

    return arrow_map(classes.select("fp"), run, "key long, fp long, dist binary")


def compare_sorted(key: np.ndarray, fp: np.ndarray, dist: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links among neighbours with equal keys (sorted), as a forest."""
    found, alive, step = [], np.arange(len(key) - 1), 1
    while len(alive):
        alive = alive[(alive + step < len(key))]
        alive = alive[key[alive] == key[alive + step]]
        for at in range(0, len(alive), 1 << 18):
            i = alive[at : at + (1 << 18)]
            j = i + step
            near = np.abs(dist[i].astype(np.int8) - dist[j].astype(np.int8)).max(1) <= max_bits
            i, j = i[near], j[near]
            near = np.bitwise_count(fp[i].view(np.uint64) ^ fp[j].view(np.uint64)) <= max_bits
            found.append((fp[i[near]], fp[j[near]]))
        step += 1
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return forest(np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found]))


def _links(keyed: DataFrame, max_bits: int) -> DataFrame:
    """Links among rows with equal keys; the rows of a key fit in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp, dist = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, len(PIVOTS)), np.uint8)

        def out(n: int) -> pa.RecordBatch:
            a, b = compare_sorted(key[:n], fp[:n], dist[:n], max_bits)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            key = np.concatenate([key, b.column(0).to_numpy(zero_copy_only=False)])
            fp = np.concatenate([fp, b.column(1).to_numpy(zero_copy_only=False)])
            dist = np.concatenate([dist, np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(-1, len(PIVOTS))])
            done = int(np.searchsorted(key, key[-1]))
            yield out(done)
            key, fp, dist = key[done:], fp[done:], dist[done:]
        yield out(len(key))

    return arrow_map(keyed.select("key", "fp", "dist").repartition("key").sortWithinPartitions("key"), run, "a long, b long")


def _variant_links(fps: DataFrame) -> DataFrame:
    """Links within two bits by shared variants of at most one flipped bit; a group has 65 members at most."""
    flips = F.concat(F.array(F.col("fp")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    groups = fps.select("fp", F.explode(flips).alias("variant")).groupBy("variant").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("members")).where(F.size("members") > 1)
    return groups.select("a", F.explode("members").alias("b")).where("a <> b")


def links(classes: DataFrame, max_bits: int = MAX_BITS, bucket_cap: int = BUCKET_CAP) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints that connect just those within ``max_bits`` (2 at most) of each other."""
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError("max_bits is 0, 1 or 2")
    keyed = written(_pivot_table(classes), "pivots")
    hot = written(keyed.groupBy("key").count().where(F.col("count") > bucket_cap).select("key"), "hot")
    if hot.isEmpty():
        return _links(keyed, max_bits)
    if max_bits < 2:
        raise ValueError("a key is over bucket_cap; for fewer than two bits raise it")
    return _links(keyed.join(hot, "key", "left_anti"), max_bits).union(_variant_links(keyed.join(hot, "key", "left_semi").select("fp").distinct()))


def _resolved(docs: DataFrame, words: int, max_bits: int, bucket_cap: int) -> tuple[DataFrame, DataFrame]:
    """The rows' fingerprints; and of each distinct one its component_id (see ``near_duplicates``) and root."""
    fps = written(fingerprints(docs, words), "fingerprints")
    classes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    joined = components(links(classes, max_bits, bucket_cap))
    members = joined.join(classes, F.col("vertex") == F.col("fp")).select("fp", "component", "least")
    members = written(members, "members")
    least = members.groupBy("component").agg(F.min("least").alias("other"))
    linked = written(members.join(least, "component").select("fp", "component", "other"), "linked")
    ids = classes.join(linked, "fp", "left").select("fp", F.coalesce("other", "least").alias("component_id"), F.coalesce("component", "fp").alias("root"))
    return fps, written(ids, "ids")


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, bucket_cap: int = BUCKET_CAP) -> DataFrame:
    """(doc_id, text_hash, fp, component_id, root) of each row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id reachable over links, the row's own included, and
    root the smallest fingerprint; root tells components of rows with one doc_id apart.
    Repeated rows stay, each with the same component. A row with a null doc_id is linked
    by its text, and has a null component_id only if nothing else is in its component.
    An empty table gives no rows; other columns are ignored.
    """
    fps, ids = _resolved(docs, words, max_bits, bucket_cap)
    return fps.join(ids, "fp", "left").select("doc_id", "text_hash", "fp", "component_id", "root")


def keep_one(docs: DataFrame, words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, bucket_cap: int = BUCKET_CAP) -> DataFrame:
    """One row of each component of ``docs``, with all its columns: that of the smallest doc_id.

    Rows of that doc_id with several texts leave the one with the smallest hash, of
    repeated rows one stays, and a row without a doc_id stays only where none has one.

    Scale: heads are found among distinct fingerprints first, so neither a group of copies
    nor a component is one task; what is joined with the rows are the keys that go.
    """
    fps, ids = _resolved(docs, words, max_bits, bucket_cap)
    told = F.struct(F.col("doc_id").isNull().alias("untold"), "doc_id", "text_hash")
    heads = fps.groupBy("fp").agg(F.min(told).alias("head")).join(ids, "fp").groupBy("root").agg(F.min("head").alias("head"))
    heads = written(heads.select(F.col("head.doc_id").alias("key_id"), F.col("head.text_hash").alias("key_hash"), F.lit(True).alias("first")), "heads")
    keys = fps.groupBy("doc_id", "text_hash").agg(F.count("*").alias("rows"))
    marked = keys.join(heads, F.col("doc_id").eqNullSafe(F.col("key_id")) & (F.col("text_hash") == F.col("key_hash")), "left")
    marked = written(marked.where("first is null or rows > 1").select(F.col("doc_id").alias("key_id"), F.col("text_hash").alias("key_hash"), "first"), "marked")
    gone, twice = marked.where("first is null").drop("first"), marked.where("first").drop("first")
    hashed = docs.withColumn("__text_hash", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    same = lambda other: hashed["doc_id"].cast("long").eqNullSafe(other["key_id"]) & (hashed["__text_hash"] == other["key_hash"])
    kept = hashed.join(gone, same(gone), "left_anti")
    if not twice.isEmpty():
        kept = kept.join(twice, same(twice), "left_anti").union(kept.join(twice, same(twice), "left_semi").dropDuplicates(["doc_id", "__text_hash"]))
    return kept.drop("__text_hash")


def op9_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates share a key made of pivot distances, which fingerprints within two bits always do; see the module."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
