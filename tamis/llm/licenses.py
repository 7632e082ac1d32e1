"""License scans by diagonal voting, in DataFrame operations alone.

Texts and license templates are words.  The rolling hashes of three words of a text join
the positions of the same hashes in the templates; a match at text position p and template
position t votes for the diagonal p - t, where the template would start.  Votes are the
set of template positions matched (a bit mask, so repeats count once).  A base phrase
stands where all its positions vote for one diagonal.  For the longer templates of the
method, diagonals that are ``GAP`` or less apart are merged (words inserted or left out),
and a merged span counts when at least ``MIN_COVERAGE`` of the positions voted and
``MIN_WORDS`` of the template's words stand in the span.

Scale: the templates are a fixed table of some hundred rows, broadcast.  All other rows
stay in their tasks until the join has left only matches; what is shuffled is a row for
each document, template and diagonal.  Keys hold the document, so no common line is hot.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tamis.llm._common import table

#: The base phrases and their labels.
BASE = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
#: Short notices and openings of public licenses, as words.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl-3", "under the terms of the gnu lesser general public license version 3"),
    ("agpl-3", "under the terms of the gnu affero general public license version 3"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc0", "cc0 1 0 universal public domain dedication"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("proprietary", "all rights reserved no part of this publication may be reproduced distributed or transmitted in any form"),
)
K = 3
GAP = 3
MIN_COVERAGE = 0.5
MIN_WORDS = 0.6
TEMPLATE = re.compile("[a-z0-9]+( [a-z0-9]+)*")
#: Everything in ASCII but digits and small letters; texts are in lower case by then.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """A text's words; null has none. Only A-Z may become other ASCII letters, so the Kelvin
    sign, the one other letter whose small form is ASCII, is replaced first."""
    plain = F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit("K"), F.lit("ĸ"))
    return F.array_remove(F.split(F.lower(plain), SEPARATORS), "")


def _gram(hashes: Column, i: Column) -> Column:
    return F.xxhash64(*(F.get(hashes, i + d) for d in range(K)))


def templates(spark: SparkSession, base: tuple = BASE, more: tuple = TEMPLATES) -> DataFrame:
    """(gram, tpos, tid, base, label, twords, grams): a row for each position of each template.

    Templates have 3 to 66 words in small letters and digits, with single spaces: a mask has 64 positions.
    ValueError for others; a longer notice is given as several templates of one label."""
    for _, text in (*base, *more):
        if not TEMPLATE.fullmatch(text) or not K <= len(text.split(" ")) < 64 + K:
            raise ValueError(f"no template: {text!r}")
    rows = ", ".join(f"({i}, {i < len(base)}, '{label}', split('{text}', ' '))" for i, (label, text) in enumerate((*base, *more)))
    all_ = spark.sql(f"SELECT * FROM VALUES {rows} AS t(tid, base, label, twords)")
    hashed = all_.withColumn("th", F.transform("twords", lambda x: F.xxhash64(x)))
    grams = hashed.withColumn("g", F.transform(F.sequence(F.lit(0), F.size("th") - K), lambda i: _gram(F.col("th"), i)))
    return grams.select("tid", "base", "label", "twords", F.size("g").alias("grams"), F.posexplode("g").alias("tpos", "gram"))


def _grams(column: Column) -> Column:
    n = F.size(column)
    return F.when(n >= K, F.transform(F.sequence(F.lit(0), n - K), lambda i: _gram(column, i))).otherwise(F.array().cast("array<bigint>"))


def matches(docs: DataFrame) -> DataFrame:
    """Diagonals of each text that got votes: doc_id, text_hash, text_bytes, tid, base, label,
    grams, twords, diagonal, mask of the template positions, and the span's words."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.coalesce(F.octet_length("text"), F.lit(-1)).alias("text_bytes"), words(F.col("text")).alias("w"))
    hashed = rows.select("doc_id", "text_hash", "text_bytes", "w", F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    rolled = hashed.select("doc_id", "text_hash", "text_bytes", "w", _grams(F.col("h")).alias("g"))
    # the outer form: for the other, the planner would add a filter that repeats the whole expression under each element
    every = rolled.select("doc_id", "text_hash", "text_bytes", "w", F.posexplode_outer("g").alias("pos", "gram"))
    hits = every.join(F.broadcast(templates(spark)), "gram").where("pos >= tpos or not base")
    diagonal = F.col("pos") - F.col("tpos")
    span = F.slice("w", F.greatest(diagonal, F.lit(0)) + 1, F.size("twords"))
    votes = hits.select("doc_id", "text_hash", "text_bytes", "tid", "base", "label", "grams", "twords", diagonal.alias("diagonal"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("tpos")).alias("vote"), span.alias("span"))
    return votes.groupBy("doc_id", "text_hash", "text_bytes", "tid", "diagonal").agg(F.bit_or("vote").alias("mask"), *(F.first(c).alias(c) for c in ("base", "label", "grams", "twords", "span")))


def spans(found: DataFrame) -> DataFrame:
    """Verified spans: the base phrases' places, and the method's merged diagonals, with coverage from 0 to 1."""
    key = ["doc_id", "text_hash", "text_bytes", "tid"]
    exact = found.where("base and bit_count(mask) = grams and span = twords").select(*key, "base", "label", "diagonal", F.lit(1.0).alias("coverage"))
    along = W.partitionBy(*key).orderBy("diagonal")
    near = found.where("not base").withColumn("new", F.coalesce((F.col("diagonal") - F.lag("diagonal").over(along) > GAP).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(along))
    merged = near.groupBy(*key, "run").agg(
        F.bit_or("mask").alias("mask"), F.min("diagonal").alias("diagonal"), F.array_distinct(F.flatten(F.collect_list("span"))).alias("span"), *(F.first(c).alias(c) for c in ("base", "label", "grams", "twords"))
    )
    coverage = F.bit_count("mask") / F.col("grams")
    inside = F.size(F.array_intersect("span", "twords")) / F.size(F.array_distinct("twords"))
    return exact.union(merged.where((coverage >= MIN_COVERAGE) & (inside >= MIN_WORDS)).select(*key, "base", "label", "diagonal", coverage.alias("coverage")))


def scan(docs: DataFrame) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text): n_words, the base phrases' places (n_base,
    first_word, last_word), base_labels, labels and score, the largest coverage (0: no license).

    A null or empty text has no words, no places, empty labels and score 0. Repeated rows
    stay, each with the same result, as do rows with a null doc_id. Other columns are
    ignored; an empty table gives no rows.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    key = ["doc_id", "text_hash", "text_bytes"]
    labels = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    found = spans(matches(docs)).groupBy(*key).agg(
        F.sum(F.col("base").cast("long")).alias("n_base"),
        F.min(F.when(F.col("base"), F.col("diagonal"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("base"), F.col("diagonal"))).cast("long").alias("last_word"),
        labels(F.when(F.col("base"), F.col("label"))).alias("base_labels"),
        labels("label").alias("labels"),
        F.max("coverage").alias("score"),
    ).select(*(F.col(c).alias(f"f_{c}") for c in key), "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.coalesce(F.octet_length("text"), F.lit(-1)).alias("text_bytes"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    same = rows["doc_id"].eqNullSafe(found["f_doc_id"]) & (rows["text_hash"] == found["f_text_hash"]) & (rows["text_bytes"] == found["f_text_bytes"])
    return rows.join(found, same, "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def op1_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    rows = ",\n    ".join(f"({i}, {i < len(BASE)}, '{label}', string_split('{text}', ' '))" for i, (label, text) in enumerate((*BASE, *TEMPLATES)))
    return rf"""
WITH t(tid, base, label, twords) AS (VALUES
    {rows}
), tg AS (
  SELECT tid, base, label, twords, len(twords) - 2 AS grams, unnest(range(1, len(twords) - 1)) AS i FROM t
), tgram AS (
  SELECT tid, base, label, twords, grams, i - 1 AS tpos, twords[i] AS a, twords[i + 1] AS b, twords[i + 2] AS c FROM tg
), d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), p AS (
  SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3
), g AS (
  SELECT rid, i - 1 AS pos, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM p
), f AS (
  SELECT rid, tid, base, label, grams, twords, pos - tpos AS diagonal, bit_or(1::BIGINT << tpos::INT) AS mask
  FROM g JOIN tgram USING (a, b, c) GROUP BY ALL
), x AS (
  SELECT f.*, d.w[greatest(diagonal, 0) + 1 : greatest(diagonal, 0) + len(twords)] AS span FROM f JOIN d USING (rid)
), n AS (
  SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY rid, tid ORDER BY diagonal) <= {GAP} THEN 0 ELSE 1 END AS new FROM x WHERE NOT base
), r AS (
  SELECT *, sum(new) OVER (PARTITION BY rid, tid ORDER BY diagonal) AS run FROM n
), m AS (
  SELECT rid, base, label, min(diagonal) AS diagonal, bit_count(bit_or(mask)) / grams::DOUBLE AS coverage,
         len(list_intersect(list_distinct(flatten(list(span))), list_distinct(twords))) / len(list_distinct(twords))::DOUBLE AS inside
  FROM r GROUP BY rid, tid, run, base, label, grams, twords
), s AS (
  SELECT rid, base, label, diagonal, 1.0::DOUBLE AS coverage FROM x WHERE base AND bit_count(mask) = grams AND span = twords
  UNION ALL
  SELECT rid, base, label, diagonal, coverage FROM m WHERE coverage >= {MIN_COVERAGE} AND inside >= {MIN_WORDS}
), a AS (
  SELECT rid, count(*) FILTER (base) AS n_base, min(diagonal) FILTER (base) AS first_word, max(diagonal) FILTER (base) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(coverage) AS score
  FROM s GROUP BY rid
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN a USING (rid)
"""


OP1_SQL = _sql()
