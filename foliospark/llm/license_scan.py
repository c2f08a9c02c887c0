"""License scan over a positional rare-token index.

Each licence template is a word sequence with one mandatory key phrase. Words are weighted by their
inverse document frequency over the whole corpus; the rarest words of each template are its index
entries. A file's index words give candidate places (template, start), the other template words are
checked at their relative positions, and a place counts when the key phrase stands complete and the
matched weight reaches `MIN_SCORE`. Base phrases are templates that must match in every word, so all
their places are found. Everything is one projection over the documents: no shuffle, no Python.

Null or empty texts have no words, no labels and score 0. Repeated rows give repeated results. Word
arrays stay inside one row, so memory is bounded by the longest single text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .common import ascii_lower

DELIMITERS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Index entries per template and the matched share of weight that a place needs.
ANCHORS, MIN_SCORE = 3, 0.6

# Phrases that the result counts, with their labels.
BASE = [
    ("cc-by", "cc by"),
    ("gpl", "general public license"),
    ("reserved", "all rights reserved"),
]
# Label, opening words of the public licence or its usual notice, mandatory key phrase.
TEMPLATES = [
    ("agpl", "gnu affero general public license", "affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    ("cc-by-4.0", "creative commons attribution 4 0 international", "creative commons attribution"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc0", "cc0 1 0 universal public domain dedication", "public domain dedication"),
    ("gpl-2.0", "licensed under the gnu general public license version 2", "general public license version 2"),
    ("gpl-3.0", "licensed under the gnu general public license version 3", "general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee"),
    ("lgpl", "gnu lesser general public license", "lesser general public license"),
    ("mit", "released under the mit license", "mit license"),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software", "hereby granted free of charge"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software"),
]


def template_words() -> list[tuple[str, int, str, bool, bool]]:
    """(template, position, word, is mandatory, is base) for every template word."""
    out = [(f"={label}", i, w, True, True) for label, phrase in BASE for i, w in enumerate(phrase.split())]
    for label, text, key in TEMPLATES:
        words, must = text.split(), key.split()
        at = next(i for i in range(len(words)) if words[i : i + len(must)] == must)
        out += [(label, i, w, at <= i < at + len(must), False) for i, w in enumerate(words)]
    return out


def words_of(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(text), DELIMITERS), lambda w: w != "")


def word_weights(docs: DataFrame, text_col: str = "text") -> dict[str, float]:
    """Inverse document frequency of each template word, over all documents. The result is as long as the template vocabulary."""
    vocabulary = sorted({w for _, _, w, _, _ in template_words()})
    known = F.array(*map(F.lit, vocabulary))
    seen = docs.select(F.explode(F.array_append(F.array_intersect(words_of(F.col(text_col)), known), F.lit(""))).alias("word"))
    df = {r.word: r.n for r in seen.groupBy("word").agg(F.count("*").alias("n")).collect()}
    total = df.get("", 0)
    return {w: math.log((total + 1) / (df.get(w, 0) + 1)) + 0.01 for w in vocabulary}


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: n_words, n_base, first_word, last_word, base_labels, labels, score, places.

    `places` lists every verified place (label, first word, share of the template's weight).
    """
    weight, tokens = word_weights(docs, text_col), template_words()
    templates = sorted({t for t, *_ in tokens})
    postings, most = [], {}
    for t in templates:
        own = [x for x in tokens if x[0] == t]
        most[t] = sum(weight[w] for _, _, w, _, _ in own)
        first = sorted(own, key=lambda x: (-weight[x[2]], x[1]))[: 1 if own[0][4] else ANCHORS]
        postings += [(w, t, i) for _, i, w, _, _ in first]
    lit = F.lit
    index = F.array(*(F.struct(lit(w).alias("w"), lit(t).alias("t"), lit(i).alias("i")) for w, t, i in postings))
    parts = F.array(*(F.struct(lit(t).alias("t"), lit(i).alias("i"), lit(w).alias("w"), lit(must).alias("must"), lit(weight[w] / most[t]).alias("part")) for t, i, w, must, _ in tokens))
    rare = F.array(*map(lit, sorted({w for w, _, _ in postings})))

    def place(c: Column) -> Column:
        own = F.filter(parts, lambda p: p.t == c.t)
        right = F.filter(own, lambda p: F.coalesce(F.get(F.col("words"), c.start + p.i) == p.w, lit(False)))
        whole = F.size(F.filter(own, lambda p: p.must)) == F.size(F.filter(right, lambda p: p.must))
        return F.struct(c.t.alias("label"), c.start.cast("long").alias("start"), F.when(whole, F.aggregate(right, lit(0.0), lambda a, p: a + p.part)).otherwise(0.0).alias("score"))

    found = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: F.array_contains(rare, x.w))
    starts = F.array_distinct(F.flatten(F.transform(found, lambda o: F.transform(F.filter(index, lambda p: p.w == o.w), lambda p: F.struct(p.t.alias("t"), (o.i - p.i).alias("start"))))))
    places = F.filter(F.transform(F.filter(starts, lambda c: c.start >= 0), place), lambda p: p.score >= MIN_SCORE)
    base = F.filter("places", lambda p: p.label.startswith("="))
    label = lambda arr: F.array_join(F.array_sort(F.array_distinct(F.transform(arr, lambda p: F.ltrim(p.label, lit("="))))), ",")
    return (
        docs.select(F.col(id_col).alias("doc_id"), words_of(F.col(text_col)).alias("words"))
        .select("doc_id", F.size("words").cast("long").alias("n_words"), F.when(F.arrays_overlap("words", rare), places).otherwise(F.expr("cast(array() as array<struct<label:string,start:bigint,score:double>>)")).alias("places"))
        .select(
            "doc_id",
            "n_words",
            F.size(base).cast("long").alias("n_base"),
            F.array_min(F.transform(base, lambda p: p.start)).alias("first_word"),
            F.array_max(F.transform(base, lambda p: p.start)).alias("last_word"),
            label(base).alias("base_labels"),
            label(F.col("places")).alias("labels"),
            F.round(F.coalesce(F.array_max(F.transform("places", lambda p: p.score)), lit(0.0)), 6).alias("score"),
            "places",
        )
    )


def _values() -> str:
    return ", ".join(f"('{t}', {i}, '{w}', {str(m).lower()}, {str(b).lower()})" for t, i, w, m, b in template_words())


ORACLE = f"""
WITH tok(t, i, w, must, base) AS (VALUES {_values()}),
d AS (SELECT doc_id, row_number() OVER () AS rid, list_filter(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS words FROM documents),
occ AS (SELECT rid, unnest(words) AS w, generate_subscripts(words, 1) - 1 AS pos FROM d),
freq AS (SELECT w, count(DISTINCT rid) AS n FROM occ SEMI JOIN tok USING (w) GROUP BY w),
wt AS (SELECT t, i, w, must, base, ln(((SELECT count(*) FROM d) + 1)::DOUBLE / (coalesce(n, 0) + 1)) + 0.01 AS weight
       FROM tok LEFT JOIN freq USING (w)),
part AS (SELECT *, weight / sum(weight) OVER (PARTITION BY t) AS share,
         row_number() OVER (PARTITION BY t ORDER BY weight DESC, i) AS rk FROM wt),
cand AS (SELECT DISTINCT o.rid, p.t, o.pos - p.i AS start FROM occ o JOIN part p ON o.w = p.w
         WHERE p.rk <= CASE WHEN p.base THEN 1 ELSE {ANCHORS} END AND o.pos >= p.i),
seen AS (SELECT c.rid, c.t, c.start, sum(CASE WHEN o.w IS NOT NULL THEN p.share ELSE 0 END) AS score,
         bool_and(NOT p.must OR o.w IS NOT NULL) AS whole, bool_or(p.base) AS base
         FROM cand c JOIN part p ON p.t = c.t LEFT JOIN occ o ON o.rid = c.rid AND o.pos = c.start + p.i AND o.w = p.w
         GROUP BY c.rid, c.t, c.start),
ok AS (SELECT rid, ltrim(t, '=') AS label, start, score, base FROM seen WHERE whole AND score >= {MIN_SCORE}),
agg AS (SELECT rid, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
        string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
        string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score FROM ok GROUP BY rid)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
       last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       round(coalesce(score, 0), 6) AS score
FROM d LEFT JOIN agg USING (rid)
"""
