import base64
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tamis.llm import language

DATA = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = language.op5_hyperdimensional_language(spark, DATA)
    told = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang")
    rows = got.join(told, "doc_id").collect()
    assert len(rows) == told.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97


def slow_vector(text, d):
    """The sum of trigram vectors, letter by letter."""
    marked = [0]
    for c in text:
        x = ord(c.lower()[0]) if c.isalpha() else 0
        if x or marked[-1]:
            marked.append(x)
    if marked[-1]:
        marked.append(0)
    v = {x: language.letter_vector(x, d).astype(int) for x in set(marked)}
    return sum((np.roll(v[a], 2) * np.roll(v[b], 1) * v[c] for a, b, c in zip(marked, marked[1:], marked[2:], strict=False)), np.zeros(d, int)), max(0, len(marked) - 2)


TEXTS = ["Ab éa, b", "", "x", "...", "ΑΣ σας ИЙ日本語", "a" * 50 + " b" * 30, "one two  three\n" * 9]


def test_vectors_match_brute_force(monkeypatch):
    want = [slow_vector(t, 64) for t in TEXTS]
    for part, remembered in ((1 << 20, 24_000), (1, 24_000), (2, 5), (7, 3), (30, 24_000)):  # neither parts nor forgetting change anything
        monkeypatch.setattr(language, "PART", part)
        got, many = language.Trigrams(64, remembered).bundle(TEXTS)
        assert np.array_equal(got, np.stack([v for v, _ in want])) and many.tolist() == [n for _, n in want]


def test_letters_have_their_own_vectors():
    near = [abs(int(language.letter_vector(a, 1024).astype(int) @ language.letter_vector(a + k, 1024))) for a in (0x61, 0x430, 0x3B1, 0x4E00) for k in (1, 101, 202)]
    assert max(near) < 160


def test_predictions_match_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").where("length(text) < 1500").orderBy("doc_id").limit(60).cache()
    rows = [r for r in docs.collect()]
    sums, weights = {}, {}
    for r in rows:
        if r.lang is not None and r.text is not None:
            v, n = slow_vector(r.text, 256)
            w = 1 / np.sqrt(max(np.linalg.norm(v), 1))
            sums[r.lang], weights[r.lang] = sums.get(r.lang, 0) + v * w, weights.get(r.lang, 0) + n * w
    fitted = language.fit(docs, 256)
    assert fitted.languages == sorted(sums)
    unit = np.stack([sums[x] / np.linalg.norm(sums[x]) for x in fitted.languages])
    assert np.abs(unit - fitted.prototypes).max() < 1e-3
    assert np.allclose(fitted.strengths, [np.linalg.norm(sums[x]) / weights[x] / 16 for x in fitted.languages], rtol=1e-3)
    got = {r.doc_id: r for r in language.predict(docs, fitted).collect()}
    for r in rows:
        v, n = slow_vector(r.text or "", 256)
        near = fitted.prototypes @ v / max(np.linalg.norm(v), 1e-9)
        want = (fitted.languages[int(near.argmax())], max(0, near.max())) if n else ("und", 0.0)
        assert got[r.doc_id].lang_pred == want[0] and abs(got[r.doc_id].score - want[1]) < 1e-5


def test_edges(edge_docs, no_docs):
    fitted = language.fit(edge_docs.where("lang is not null"))
    langs = fitted.languages
    assert langs == ["en", "fr"]
    got = language.predict(edge_docs, fitted).collect()
    assert len(got) == edge_docs.count()
    assert {(r.lang_pred, r.score) for r in got if r.doc_id in (2, 3, 4)} == {("und", 0.0)}
    assert all(r.lang_pred in langs for r in got if r.doc_id in (1, 5, 6, 7))
    none = language.fit(no_docs)
    assert none.languages == [] and {r.lang_pred for r in language.predict(edge_docs, none).collect()} == {"und"}
    assert language.predict(no_docs, fitted).count() == 0
    assert language.keep_identified(edge_docs, *none).count() == edge_docs.where(F.col("text").rlike("[A-Za-z]")).count()


def test_as_many_languages_as_rows(spark, monkeypatch):
    monkeypatch.setattr(language, "HELD_LANGUAGES", 100)
    docs = spark.createDataFrame([(i, "abc def", f"x{i}") for i in range(3000)], "doc_id long, text string, lang string")
    fitted = language.fit(docs, dimensions=16)
    assert len(fitted.languages) == 3000 and fitted.prototypes.shape == (3000, 16)
    assert language.predict(docs, fitted).where("lang_pred = 'x0'").count() == 3000  # a tie of all


def test_rejects_what_is_no_learned_language(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    fitted = language.fit(docs.where(~language.held_out()))
    r = random.Random(3)
    noise = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz     ") for _ in range(n))
    bad = [noise(n) for n in (200, 400, 1000, 20_000)] + ["Это совершенно обычный русский текст о погоде, который никто не учил. " * 9, base64.b64encode(r.randbytes(3000)).decode()]
    good = [" ".join(t.split()[:n]) for t in docs.where("lang is not null and length(text) > 400").select("text").limit(60).toPandas()["text"] for n in (1, 3, 10, 60, 10_000)]
    found = language.judge(language.Trigrams(language.DIMENSIONS), bad + good, fitted)
    assert not any(x.identified for x in found[: len(bad)])
    assert all(x.identified for x, t in zip(found[len(bad) :], good, strict=True) if any(map(str.isalpha, t)))
    kept = language.keep_identified(docs, *fitted)
    assert kept.count() == docs.where(F.col("text").rlike(r"\p{L}")).count()  # the table has only learned languages


def test_stage_keeps_rows_with_letters(edge_docs):
    docs = edge_docs.withColumnRenamed("score", "lang_pred")  # a clashing name
    kept = language.keep_identified(docs, *language.fit(docs))
    assert kept.columns == docs.columns
    want = docs.where(F.col("text").rlike("[A-Za-z]")).count()
    assert kept.count() == want
    assert kept.where("lang is null").count() == 0


def test_training_bound(spark):
    docs = spark.createDataFrame([(i, "abc abd" if i % 2 else "xyz xyw", "a" if i % 2 else "b") for i in range(200)], "doc_id long, text string, lang string")
    fitted = language.fit(docs, dimensions=128, train_rows=50)
    assert fitted.languages == ["a", "b"]
    assert {(r.doc_id % 2, r.lang_pred) for r in language.predict(docs, fitted).collect()} == {(1, "a"), (0, "b")}
