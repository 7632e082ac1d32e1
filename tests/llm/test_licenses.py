import re

import duckdb
import pytest

from tamis.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(text):
    words = WORD.findall((text or "").translate(LOWER))
    places = [(i, label) for label, phrase in licenses.BASE for p in [phrase.split()] for i in range(len(words)) if words[i : i + len(p)] == p]
    return len(words), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None), ",".join(sorted({x for _, x in places}))


def test_base_matches_brute_force(edge_docs):
    got = licenses.scan(edge_docs).collect()
    assert len(got) == edge_docs.count()
    want = sorted((repr((r.doc_id, *brute(r.text)))) for r in edge_docs.collect())
    assert sorted(repr((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in got) == want
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)


def test_kelvin_sign_is_no_letter_k(spark):
    docs = spark.createDataFrame([(1, "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted".replace("k", "K")), (2, "worK")], "doc_id long, text string")
    assert licenses.scan(docs).where("doc_id = 2").first().n_words == 1


def test_method_finds_altered_notices(spark):
    notice = "Permission is hereby granted, free of charge, to any single person obtaining a copy of this software and associated documentation files"
    docs = spark.createDataFrame([(1, "x " * 50 + notice), (2, "permission to enter is granted to any person"), (3, notice.replace(" of ", " zz "))], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert got[1].labels == "mit" and got[1].score > 0.7 and got[1].n_base == 0
    assert got[2].labels == "" and got[2].score == 0


def test_templates_of_any_fitting_length(spark):
    longest = " ".join(f"w{i}" for i in range(66))
    rows = licenses.templates(spark, (), (("a", longest), ("b", "x y z"))).groupBy("label").count().collect()
    assert {r.label: r["count"] for r in rows} == {"a": 64, "b": 1}
    for text in (longest + " w", "x y", "", "It's so so", "x  y z"):
        with pytest.raises(ValueError):
            licenses.templates(spark, (), (("a", text),))


def test_no_rows(no_docs):
    assert licenses.scan(no_docs).count() == 0


def test_sql_gives_the_same(spark, small):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{small}/documents.parquet'")
    got = licenses.op1_license_diagonals(spark, small)
    want = con.sql(licenses.OP1_SQL).fetchall()
    columns = [x[0] for x in con.sql(licenses.OP1_SQL).description]
    assert sorted(map(repr, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(repr, want))
