import public_tokenizers
from tests.llm.test_packing import ids_of
from tests.llm.test_secrets import brute
from tests.llm.test_simhash import slow_components, slow_fingerprint

import __spark_entry__
import corpus_pipeline
from tamis.llm import secrets


def test_stages_match_brute_force(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    names, frames = docs.columns, [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, frames[-1], small).write.parquet(f"{tmp_path}/{i}")
        frames.append(spark.read.parquet(f"{tmp_path}/{i}"))
        assert i == 3 or frames[-1].columns == names
    start, identified, single, masked, packed = [f.collect() for f in frames]
    assert {r.doc_id for r in identified} == {r.doc_id for r in start if r.text and any(map(str.isalpha, r.text))}
    least = slow_components([slow_fingerprint(r.text) for r in identified], [r.doc_id for r in identified])
    assert sorted(r.doc_id for r in single) == sorted({c for c in least})
    before = {r.doc_id: r for r in single}
    for r in masked:
        old = before[r.doc_id].text
        assert not brute(r.text) and (r.text == old) == (not secrets.scan(old)[1]) and r.n_chars == (len(r.text) if r.text != old else before[r.doc_id].n_chars)
    want = ids_of([r.text for r in masked])
    assert sum(r.length for r in packed) == sum(map(len, want)) and {r.doc_id for r in packed} == set(before)
    assert sorted(map(tuple, corpus_pipeline.run(spark, small).select("doc_id", "doc_tokens").distinct().collect())) == sorted((r.doc_id, len(i)) for r, i in zip(masked, want, strict=True))


def test_edges(spark, small, edge_docs, no_docs):
    docs = edge_docs.withColumnRenamed("labels", "source").withColumn("n_chars", edge_docs["score"].cast("long")).drop("score")
    for frame in (docs, docs.limit(0)):
        out = frame
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, out, small)
        assert (out.count() > 0) == (frame is docs)


def test_registered():
    names = list(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert public_tokenizers.path("byte_bpe_50k.json")
