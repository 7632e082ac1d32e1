"""Language identification with hyperdimensional letter profiles.

Each letter has a random +1/-1 vector, drawn from its code point (letters are lower-cased
one by one; every run of other characters is one word border with a vector of its own).  A
trigram's vector binds (multiplies) its letters' vectors, the first rotated by two places
and the second by one; a text's vector bundles (sums) those of its trigrams, and a
language's prototype bundles its training texts.  A text gets the language whose prototype
has the largest cosine with it.

A text is identified if its cosine is at least half of what a text of that language and
diversity has on average, less ``SLACK`` for the noise of few trigrams: one rule for all
lengths.  A language's strength is the mean projection of its trigrams on its prototype; a
text whose vector is as long as that of ``e`` equally frequent trigrams would have has a
mean cosine of strength times the root of ``e``.

Scale: two narrow passes.  Training adds up one vector for each language in every task,
then ``dimensions + 1`` sums a language are shuffled and collected; there are no more
languages than training rows, whose number is bounded.  Prediction has no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.llm._common import arrow_map, table

DIMENSIONS = 1024
SEED = 5
#: Rows that the prototypes are fitted on, at most about (a hash of all that is learned from picks them when there are more).
TRAIN_ROWS = 20_000
#: Languages whose sums a task holds before it passes them on.
HELD_LANGUAGES = 2048
#: Characters that are turned into trigrams at once; the last two letters are carried over.
PART = 1 << 20
UNKNOWN = "und"
#: Share of the mean cosine that an identified text has, and what is allowed for noise.
MIN_SHARE = 0.5
SLACK = 0.25

_STATE: dict[str, np.ndarray] = {}


class Profiles(NamedTuple):
    languages: list[str]
    prototypes: np.ndarray  # a row of length 1 for each language
    strengths: np.ndarray


def folded() -> np.ndarray:
    """The lower-case letter of each code point, 0 for what is no letter."""
    if "folded" not in _STATE:
        _STATE["folded"] = np.fromiter((ord(c.lower()[0]) if (c := chr(i)).isalpha() else 0 for i in range(0x110000)), np.int64, 0x110000)
    return _STATE["folded"]


def letter_vector(letter: int, dimensions: int) -> np.ndarray:
    return np.random.default_rng([SEED, letter]).integers(0, 2, dimensions, np.int8) * 2 - 1


class Trigrams:
    """Bundled trigram vectors of texts; the vectors of up to ``remembered`` trigrams, and of as many letters, are kept."""

    def __init__(self, dimensions: int, remembered: int = 24_000):
        self.dimensions = dimensions
        self.vectors = np.zeros((remembered, dimensions), np.float32)
        self.places: dict[int, int] = {}
        self.letters: dict[int, np.ndarray] = {}

    def _of_letters(self, letters: np.ndarray) -> np.ndarray:
        distinct, at = np.unique(letters, return_inverse=True)
        if len(self.letters) > len(self.vectors):
            self.letters.clear()
        for x in distinct.tolist():
            if x not in self.letters:
                self.letters[x] = letter_vector(x, self.dimensions)
        return np.stack([self.letters[x] for x in distinct.tolist()])[at]

    def _vectors(self, codes: np.ndarray) -> np.ndarray:
        """Of at most ``remembered`` distinct codes."""
        told = codes.tolist()
        new = [c for c in told if c not in self.places]
        if len(self.places) + len(new) > len(self.vectors):
            self.places.clear()
            new = told
        if new:
            made, at = np.array(new), len(self.places)
            a, b, c = (self._of_letters(x) for x in (made >> 42, made >> 21 & 0x1FFFFF, made & 0x1FFFFF))
            self.vectors[at : at + len(new)] = np.roll(a, 2, 1) * np.roll(b, 1, 1) * c
            self.places.update(zip(new, range(at, at + len(new)), strict=True))
        return self.vectors[[self.places[c] for c in told]]

    def codes(self, text: str) -> Iterator[np.ndarray]:
        """The text's trigrams, 21 bits a letter, in order."""
        tail = np.zeros(1, np.int64)
        for at in range(0, len(text) + 1, PART):
            letters = folded()[np.frombuffer(text[at : at + PART].encode("utf-32-le", "surrogatepass"), "<u4")]
            x = np.concatenate([tail, letters, [0]] if at + PART > len(text) else [tail, letters])
            x = x[(x != 0) | (np.concatenate([[1], x[:-1]]) != 0)]
            yield x[:-2] << 42 | x[1:-1] << 21 | x[2:]
            tail = x[-2:]

    def bundle(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Row i: the sum of the vectors of the trigrams of texts[i]; and their number."""
        out, many = np.zeros((len(texts), self.dimensions), np.float32), np.zeros(len(texts), np.int64)
        codes: list[np.ndarray] = []
        rows: list[np.ndarray] = []
        held = 0
        for i, text in enumerate(texts):
            for c in self.codes(text):
                codes.append(c)
                rows.append(np.full(len(c), i, np.int64))
                many[i] += len(c)
                held += len(c)
                if held >= 2 * PART:
                    self._add(out, np.concatenate(codes), np.concatenate(rows))
                    codes, rows, held = [], [], 0
        if held:
            self._add(out, np.concatenate(codes), np.concatenate(rows))
        return out, many

    def _add(self, out: np.ndarray, codes: np.ndarray, row: np.ndarray) -> None:
        local, distinct = pd.factorize(codes)
        first = int(row[0])
        row = row - first
        n_rows = int(row[-1]) + 1
        step = max(1, min(len(self.vectors), (1 << 24) // n_rows))
        for at in range(0, len(distinct), step):
            n = min(step, len(distinct) - at)
            here = slice(None) if n == len(distinct) else (local >= at) & (local < at + n)
            counts = np.bincount(row[here] * n + (local[here] - at), minlength=n_rows * n).reshape(n_rows, n)
            out[first : first + n_rows] += counts.astype(np.float32) @ self._vectors(distinct[at : at + n])


def _groups(texts: list[str], rows: int = 256, chars: int = 2_000_000) -> Iterator[slice]:
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and (i - start >= rows or size + len(t) > chars):
            yield slice(start, i)
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield slice(start, len(texts))


def fit(labelled: DataFrame, dimensions: int = DIMENSIONS, train_rows: int = TRAIN_ROWS) -> Profiles:
    """Languages, sorted, their prototypes and strengths, from rows (doc_id, text, lang).

    Rows with a null text or lang teach nothing; without any, there are no languages. Of
    more than ``train_rows`` rows, those with the smallest hashes of doc_id, text and lang are taken.
    """
    rows = labelled.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    many = rows.select("doc_id").count()
    if many > train_rows:
        rows = rows.where(F.pmod(F.xxhash64("doc_id", "text", "lang"), F.lit(1 << 30)) < int(train_rows / many * (1 << 30)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trigrams, sums = Trigrams(dimensions), {}

        def told() -> Iterator[pa.RecordBatch]:
            for lang, v in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(v)), pa.array(np.arange(len(v), dtype=np.int32)), pa.array(v)], ["lang", "place", "value"])
            sums.clear()

        for b in batches:
            texts, langs = b.column(0).to_pylist(), b.column(1).to_pylist()
            for part in _groups(texts):
                vectors, n = trigrams.bundle(texts[part])
                # every text weighs as the square root of its length; the last place has the trigrams
                weight = 1 / np.sqrt(np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1))
                rounded = np.rint(np.hstack([vectors, n[:, None]]).astype(np.float64) * weight * 1024).astype(np.int64)
                for lang, v in zip(langs[part], rounded, strict=True):
                    sums[lang] = sums.get(lang, 0) + v
                if len(sums) > HELD_LANGUAGES:
                    yield from told()
        yield from told()

    sums = arrow_map(rows.select("text", "lang"), run, "lang string, place int, value long").groupBy("lang", "place").agg(F.sum("value").alias("value"))
    vectors = sums.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]).alias("sums"))
    got = vectors.toPandas().sort_values("lang")
    summed = np.stack(got["sums"].to_numpy()).astype(np.float64) if len(got) else np.zeros((0, dimensions + 1))
    length = np.maximum(np.linalg.norm(summed[:, :-1], axis=1, keepdims=True), 1e-9)
    return Profiles(got["lang"].tolist(), summed[:, :-1] / length, length[:, 0] / np.maximum(summed[:, -1], 1e-9) / np.sqrt(dimensions))


def cosines(vectors: np.ndarray, prototypes: np.ndarray) -> np.ndarray:
    return vectors @ prototypes.T / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)


class Judgement(NamedTuple):
    language: str
    score: float
    identified: bool


def judge(trigrams: Trigrams, texts: list[str | None], profiles: Profiles, min_share: float = MIN_SHARE, slack: float = SLACK) -> list[Judgement]:
    """The nearest language of each text, its cosine, and whether the text is identified by it (without any language, every text with a letter is)."""
    texts, out = [t or "" for t in texts], []
    for part in _groups(texts):
        vectors, n = trigrams.bundle(texts[part])
        if not profiles.languages:
            out += [Judgement(UNKNOWN, 0.0, x > 0) for x in n.tolist()]
            continue
        near = cosines(vectors, profiles.prototypes)
        best, score = near.argmax(1), near.max(1)
        # trigrams, if all were equally frequent, for a vector of this length
        even = n.astype(np.float64) ** 2 * vectors.shape[1] / np.maximum((vectors.astype(np.float64) ** 2).sum(1), 1e-9)
        enough = (n > 0) & (score >= min_share * profiles.strengths[best] * np.sqrt(even) - slack)
        for i, x, ok, letters in zip(best.tolist(), score.tolist(), enough.tolist(), n.tolist(), strict=True):
            out.append(Judgement(profiles.languages[i], min(1.0, max(0.0, x)), ok) if letters else Judgement(UNKNOWN, 0.0, False))
    return out


def _sent(df: DataFrame, profiles: Profiles):
    """Broadcast: a row of floats for each language, of which there are no more than training rows."""
    return df.sparkSession.sparkContext.broadcast(Profiles(profiles.languages, profiles.prototypes.astype(np.float32), profiles.strengths))


def predict(docs: DataFrame, profiles: Profiles, keep: list[str] | None = None) -> DataFrame:
    """Each row's ``keep`` columns (doc_id, if not told) with lang_pred and score, the largest cosine between 0 and 1.

    A text that is null or has no letter gets ``und`` and 0, as does every text when there
    are no languages. Ties go to the language first in sorted order. Repeated rows stay;
    an empty table gives no rows; columns that are not kept are ignored.
    """
    keep = ["doc_id"] if keep is None else keep
    source = docs.select(F.col("text").cast("string").alias("text"), *keep)
    sent, dimensions = _sent(docs, profiles), profiles.prototypes.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trigrams = Trigrams(dimensions)
        for b in batches:
            got = judge(trigrams, b.column(0).to_pylist(), sent.value)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array([x.language for x in got], pa.string()), pa.array([x.score for x in got], pa.float64())], [*b.schema.names[1:], "lang_pred", "score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[1:])
    return arrow_map(source, run, f"{kinds}, lang_pred string, score double")


def keep_identified(docs: DataFrame, languages: list[str], prototypes: np.ndarray, strengths: np.ndarray, min_share: float = MIN_SHARE, slack: float = SLACK) -> DataFrame:
    """The rows of ``docs`` whose language is identified, with all their columns; a null ``lang`` becomes the predicted one.

    Rejected are texts that are null or without a letter, and those whose cosine is under
    what the module's rule asks for; a text of few trigrams is never under it.
    """
    names = docs.columns
    at, lang = names.index("text"), names.index("lang") if "lang" in names else None
    sent, dimensions = _sent(docs, Profiles(languages, prototypes, strengths)), prototypes.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trigrams = Trigrams(dimensions)
        for b in batches:
            got = judge(trigrams, b.column(at).to_pylist(), sent.value, min_share, slack)
            columns = list(b.columns)
            if lang is not None and columns[lang].null_count:
                told = [x if x is not None or g.language == UNKNOWN else g.language for x, g in zip(columns[lang].to_pylist(), got, strict=True)]
                columns[lang] = pa.array(told, columns[lang].type)
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array([g.identified for g in got], pa.bool_()))

    return arrow_map(docs, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields))


def held_out() -> F.Column:
    """True for the documents that nothing is learned from: crc32 of doc_id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def op5_hyperdimensional_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs.select("doc_id", "text", held_out().alias("held_out")), fit(docs.where(~held_out())), ["doc_id", "held_out"])
