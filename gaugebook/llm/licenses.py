"""License notices found by an exact set-similarity join of text blocks and templates.

A text is a row of words. Its blocks are windows of two cells of CELL words, one window
starting at each cell, so any CELL consecutive words stand in one block together. A
template is a set of at most CELL words with a threshold; a block matches when it holds
ceil(threshold * size) words of the template. Template phrases (threshold 1) are matched the same way, and
the places where their words stand in a row are then read from the matching blocks.

Words take one global order, rarest in the corpus first. Then

* prefix filter: with `need` words to share, a template of n words and a block of m
  template words must share one of the first n - need + 1 and first m - need + 1 words;
* length filter: m >= need;
* positional filter: where the first shared word is number i of the template and j of the
  block, at most 1 + min(n - i - 1, m - j - 1) words are shared.

Words that no template holds can never be shared, so blocks are compared by their template words only. All of
it is built-in functions and joins; only templates (a parameter with checked size) and
the blocks that hold a prefix word meet in a join.

Defined results: null text counts as empty, and an empty text has no words, no matches and
score 0; rows with equal or null doc_id are told apart by row; repeated rows get equal
results; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugebook.session import stage

CELL = 64
#: All templates together are sent to every task: their number of words is checked.
MAX_TEMPLATE_WORDS = 20_000
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    threshold: float = 0.8
    phrase: bool = False

    @property
    def words(self) -> list[str]:
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), self.text)
        return [w for w in re.split(GAP, lowered) if w]

    @property
    def need(self) -> int:
        # Halves of a hundredth keep ceil(0.8 * 5) at 4, whatever the rounding of 0.8.
        return max(1, ceil(round(self.threshold * len(set(self.words)), 6)))


# The phrases of the base labels.
PHRASES = (
    Template("gpl", "gnu general public license", 1.0, True),
    Template("apache", "apache license", 1.0, True),
    Template("cc-by", "cc by", 1.0, True),
    Template("mit", "mit license", 1.0, True),
)
# Wording of public license notices.
NOTICES = (
    Template("agpl-3.0", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    Template("all-rights-reserved", "all rights reserved", 1.0),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    Template("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    Template("boost-1.0", "Distributed under the Boost Software License, Version 1.0"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                    "provided that the following conditions are met"),
    Template("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", 1.0),
    Template("cc-by-sa-4.0", "licensed under the Creative Commons Attribution-ShareAlike 4.0 International License"),
    Template("cc0-1.0", "waived all copyright and related or neighboring rights to this work under CC0 1.0 Universal public domain dedication"),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                    "General Public License as published by the Free Software Foundation"),
    Template("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
                    "hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    Template("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    Template("mit", "Released under the MIT License", 1.0),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
                    "associated documentation files, to deal in the Software without restriction"),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    Template("unlicense", "This is free and unencumbered software released into the public domain"),
)
TEMPLATES = PHRASES + NOTICES


def words_of(text: Column) -> Column:
    """Words with A-Z lowered. `lower` also lowers other letters, which no template word
    holds; the one sign it would turn into a-z, the Kelvin sign, is replaced before."""
    plain = F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit("K"), F.lit("ĸ"))
    return F.array_remove(F.split(F.lower(plain), GAP), "")


def _array(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")


def _checked(templates: tuple[Template, ...]) -> None:
    if sum(len(t.words) for t in templates) > MAX_TEMPLATE_WORDS:
        raise ValueError(f"templates may hold {MAX_TEMPLATE_WORDS} words together")
    for t in templates:
        if not t.words or len(t.words) > CELL:
            raise ValueError(f"a template has 1 to {CELL} words: {t.text[:60]!r}")
        if t.phrase and t.need < len(set(t.words)):
            raise ValueError(f"a phrase has threshold 1: {t.text!r}")


def global_order(docs: DataFrame, templates: tuple[Template, ...]) -> list[str]:
    """Template words, rarest first: by the number of documents that hold them, then by spelling."""
    vocabulary = sorted({w for t in templates for w in t.words})
    held = docs.select(F.explode(F.array_intersect(_array(vocabulary), words_of(docs["text"]))).alias("word"))
    counts = {r["word"]: r["n"] for r in held.groupBy("word").agg(F.count("*").alias("n")).collect()}
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def _prefix_rows(spark: SparkSession, templates: tuple[Template, ...], order: list[str]) -> DataFrame:
    """One row per prefix word of a template: the index side of the join."""
    rank = {w: i for i, w in enumerate(order)}
    rows = []
    for number, t in enumerate(templates):
        sorted_words = sorted(set(t.words), key=rank.__getitem__)
        for i, w in enumerate(sorted_words[:len(sorted_words) - t.need + 1]):
            rows.append((w, i, number, t.label, t.phrase, t.words, sorted_words, len(sorted_words), t.need))
    schema = ("token string, i int, template int, label string, phrase boolean, t_words array<string>, "
              "t_set array<string>, n int, need int")
    return spark.createDataFrame(rows, schema)


def candidates(docs: DataFrame, templates: tuple[Template, ...], order: list[str]) -> DataFrame:
    """row, doc_id, n_words and those blocks (number, words, last) of each text that hold a
    prefix word of some template. Staged: rows keep their numbers."""
    prefix = {w for t in templates for w in sorted(set(t.words), key=order.index)[:len(set(t.words)) - t.need + 1]}
    words = docs.select(docs["doc_id"].cast("long").alias("doc_id"), words_of(docs["text"]).alias("words"))
    last = F.greatest(F.ceil(F.size("words") / CELL).cast("int") - 2, F.lit(0))
    block = F.transform(F.sequence(F.lit(0), last), lambda b: F.struct(
        b.alias("block"), F.slice("words", b * CELL + 1, 2 * CELL).alias("words"), (b == last).alias("last")))
    kept = F.filter(block, lambda b: F.arrays_overlap(b["words"], _array(sorted(prefix))))
    return stage(words.select("doc_id", F.size("words").cast("long").alias("n_words"), kept.alias("blocks")).withColumn(
        "row", F.monotonically_increasing_id()), "license-blocks")


def matches(found: DataFrame, templates: tuple[Template, ...], order: list[str]) -> DataFrame:
    """Every (row, block, template) whose block meets the template's threshold.

    Columns: row, block, first_word, last, words, template, label, phrase, t_words,
    shared, containment.
    """
    least = min((t.need for t in templates), default=1)
    index = _prefix_rows(found.sparkSession, templates, order)
    blocks = found.select("row", F.explode("blocks").alias("b")).select("row", "b.*")
    # In the order of the first array: the template words of the block, rarest first.
    sets = blocks.withColumn("s", F.array_intersect(_array(order), F.col("words"))).withColumn("m", F.size("s"))
    heads = sets.where(F.col("m") >= least).select("*", F.posexplode(F.slice("s", F.lit(1), F.col("m") - least + 1)).alias("j", "token"))
    met = heads.join(index, "token")
    fits = (F.col("m") >= F.col("need")) & (F.col("j") <= F.col("m") - F.col("need")) & (
        F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j")) >= F.col("need"))
    first_met = ~F.arrays_overlap(F.slice("s", F.lit(1), F.col("j")), F.col("t_set"))
    shared = F.size(F.array_intersect("t_set", "s"))
    return met.where(fits & first_met).withColumn("shared", shared).where(F.col("shared") >= F.col("need")).select(
        "row", "block", (F.col("block").cast("long") * CELL).alias("first_word"), "last", "words", "template", "label",
        "phrase", "t_words", "shared", (F.col("shared") / F.col("n")).alias("containment"))


def places(met: DataFrame) -> DataFrame:
    """Adds `starts`: words where the phrase stands in a row, each in the one block that owns it."""
    k = F.size("t_words")
    at = F.filter(F.sequence(F.lit(0), F.greatest(F.size("words") - k, F.lit(0))), lambda p: (
        (p < CELL) | F.col("last")) & (F.slice("words", p + 1, k) == F.col("t_words")))
    return met.withColumn("starts", F.when(F.col("phrase"), F.transform(at, lambda p: F.col("first_word") + p)))


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """Per document: n_words, places of phrases, labels of phrases and of all templates, score.

    `score` is the largest containment of any matching notice, 1 where a phrase stands.
    """
    _checked(templates)
    order = global_order(docs, templates)
    found = candidates(docs, templates, order)
    met = places(matches(found, templates, order))
    stands = F.size("starts") > 0
    counts = ~F.col("phrase") | stands
    labels = lambda when: F.array_join(F.sort_array(F.collect_set(F.when(when, F.col("label")))), ",")
    per_row = met.where(counts).groupBy("row").agg(
        F.sum(F.when(F.col("phrase"), F.size("starts")).otherwise(0)).alias("n_base"),
        F.min(F.array_min("starts")).alias("first_word"), F.max(F.array_max("starts")).alias("last_word"),
        labels(F.col("phrase")).alias("base_labels"), labels(F.lit(True)).alias("labels"), F.max("containment").alias("score"))
    rows = found.drop("blocks").join(per_row, "row", "left")
    return rows.select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word",
                       "last_word", F.coalesce("base_labels", F.lit("")).alias("base_labels"),
                       F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))


def oracle(templates: tuple[Template, ...] = TEMPLATES) -> str:
    """DuckDB SQL with the same rows, without any filter: every block against every template."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    values = ", ".join(f"({k}, '{t.label}', {str(t.phrase).lower()}, {t.need}, {len(set(t.words))}, '{w}')"
                       for k, t in enumerate(templates) for w in sorted(set(t.words)))
    phrases = ", ".join(f"('{t.label}', '{t.words[0]}', '{' '.join(t.words)}', {len(t.words)})" for t in templates if t.phrase)
    return f"""
WITH t(template, label, phrase, need, n, w) AS (VALUES {values}),
ph(label, w, words, k) AS (VALUES {phrases}),
d AS (SELECT row_number() OVER () AS r, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws
      FROM documents),
w AS (SELECT r, len(ws) AS size, unnest(ws) AS w, unnest(range(len(ws))) AS p FROM d),
h AS (SELECT w.*, t.template, t.label, t.phrase, t.need, t.n FROM w JOIN t ON t.w = w.w),
b AS (SELECT DISTINCT r, template, label, phrase, need, n, w, greatest(least(p // {CELL} - o, (size + {CELL - 1}) // {CELL} - 2), 0) AS block
      FROM h, (VALUES (0), (1)) AS two(o)),
m AS (SELECT r, block, template, label, phrase, count(*) / n AS containment FROM b
      GROUP BY r, block, template, label, phrase, need, n HAVING count(*) >= need),
f AS (SELECT w.r, ph.label, w.p FROM w JOIN ph ON w.w = ph.w JOIN d USING (r)
      WHERE list_aggregate(ws[p + 1:p + k], 'string_agg', ' ') = words),
g AS (SELECT r, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word,
        string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM f GROUP BY r),
a AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score FROM (
        SELECT r, label, 1.0::DOUBLE AS score FROM f UNION ALL SELECT r, label, containment FROM m WHERE NOT phrase) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
       CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN g USING (r) LEFT JOIN a USING (r)"""
