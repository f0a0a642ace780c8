"""License scans: an exact set-similarity join of text blocks with license templates, on native functions alone.

A text block is a run of consecutive words, wherever its line breaks, blank lines and comment marks are: notices are wrapped at any width. For a template of m words a
block has m + max(2, m * SLACK) words (fewer at the text's end), so a notice may have words put in. Blocks and templates are sets of words; a block matches a template when it
holds at least CONTAINMENT of the template's words. The words of the templates are ordered by the number of documents that have them, rarest first,
ties by the word, and the join runs on that order:

- prefix: with n words and an overlap of o needed, a match holds one of the n - o + 1 rarest, so blocks are looked for around the places of these words alone;
- length: the words around such a place, as far as blocks reach, must hold o of the template's words, or no block there can;
- position: the rarest of those held must leave o - 1 behind it in the template's order.

What passes is verified block by block, from each template word that a block with the place can begin with (a block that begins with another word
holds no more), so the join is exact. The side of the templates is a parameter of a few hundred words, and the table
of frequencies has a row for each of them, whatever the size of the corpus; documents are never shuffled.

Null texts count as empty; empty texts have no word, no label and score 0. A very long text costs in proportion to its length. Null ids stay, repeated
rows give repeated rows, other columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmith.llm.common import table, text_or_empty

CONTAINMENT = 0.9
#: Words that a block may have beyond the template's, as a share of these.
SLACK = 0.5

# The phrases whose places are counted, and their labels.
BASE = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]

# Public license notices, with their labels.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_set(text: str) -> frozenset[str]:
    return frozenset(re.sub(SEPARATORS, " ", text.translate(str.maketrans(UPPER, LOWER))).split(" ")) - {""}


def words_line(text: Column) -> Column:
    """' w0 w1 w2 ' of a text; ' ' twice where it has no word."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(text, SEPARATORS, " ")), F.lit(" "))


def literal(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def block_length(template: str) -> int:
    m = len([w for w in re.sub(SEPARATORS, " ", template.translate(str.maketrans(UPPER, LOWER))).split(" ") if w])
    return m + max(2, int(m * SLACK))


def words_of(line: Column) -> Column:
    """The words of words_line(); one empty word where there is none."""
    return F.split(F.trim(line), " ")


def frequency_order(rows: DataFrame, vocabulary: list[str]) -> list[str]:
    """The vocabulary by the number of documents that hold each word, over all documents; rows: _t, lower-case texts."""
    words = rows.select(F.explode(F.array_intersect(literal(vocabulary), words_of(words_line(F.col("_t"))))).alias("w"))
    count = {r.w: r.n for r in words.groupBy("w").agg(F.count("*").alias("n")).collect()}  # one row for each template word
    return sorted(vocabulary, key=lambda w: (count.get(w, 0), w))


def containments(ws: str, templates: list[tuple[frozenset[str], int]], ranked: list[str], threshold: float) -> list[Column]:
    """For each template (its words, the words of a block) the largest share of its words that a block of the column ws holds, where that reaches the threshold; else null."""
    place = {w: i for i, w in enumerate(ranked)}
    text = F.col(ws)

    def best(t: frozenset[str], length: int) -> Column:
        words = sorted(t, key=place.get)
        n, need = len(words), math.ceil(threshold * len(words) - 1e-9)
        full, prefix = literal(words), literal(words[: n - need + 1])
        held = lambda a, m: F.array_intersect(full, F.slice(text, a + 1, m))
        places = F.filter(F.sequence(F.lit(0), F.size(text) - 1), lambda i: F.array_contains(prefix, F.get(text, i)))

        def near(a: Column) -> Column:
            around = held(F.greatest(a - (length - 1), F.lit(0)), F.lit(2 * length - 1))
            return (F.size(around) >= need) & (F.array_position(full, F.get(around, F.lit(0))) <= n - need + 1)

        def largest(a: Column) -> Column:
            begins = F.filter(F.sequence(F.greatest(a - (length - 1), F.lit(0)), a), lambda s: F.array_contains(full, F.get(text, s)))
            return F.array_max(F.transform(begins, lambda s: F.size(held(s, F.lit(length)))))

        most = F.array_max(F.transform(F.filter(places, near), largest))
        return F.when(F.arrays_overlap(text, prefix), F.when(most >= need, most / F.lit(float(n))))

    # Each share is an expression of its own, and counts its largest block once.
    return [best(*t) for t in templates]


def scan(docs: DataFrame, templates=tuple(TEMPLATES), base=tuple(BASE), threshold: float = CONTAINMENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, places of the base phrases (n_base, first_word, last_word, base_labels), labels and score."""
    sets = [word_set(t) for _, t in templates]
    vocabulary = sorted(frozenset().union(*sets))
    rows = docs.select(F.col(id_col), F.translate(text_or_empty(text_col), UPPER, LOWER).alias("_t"))
    ranked = frequency_order(rows, vocabulary)
    place = {w: i for i, w in enumerate(ranked)}
    needs = [math.ceil(threshold * len(x) - 1e-9) for x in sets]
    rare = sorted({w for x, need in zip(sets, needs, strict=True) for w in sorted(x, key=place.get)[: len(x) - need + 1]})

    rows = rows.select(id_col, words_line(F.col("_t")).alias("_w"))
    words = words_of(F.col("_w"))
    rows = rows.select(id_col, "_w", F.when(F.arrays_overlap(words, literal(rare)), words).alias("_b"))
    lengths = [block_length(t) for _, t in templates]
    rows = rows.select(id_col, "_w", F.array(*containments("_b", list(zip(sets, lengths, strict=True)), ranked, threshold)).alias("_c"), *[F.instr("_w", f" {p} ").alias(f"_p{k}") for k, (p, _) in enumerate(base)])

    def spaces(s: Column) -> Column:
        return F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))

    firsts, lasts, counts = [], [], []
    for k, (p, _) in enumerate(base):
        at = F.col(f"_p{k}")
        firsts.append(F.when(at > 0, spaces(F.substring(F.col("_w"), F.lit(1), at - 1))))
        back = F.instr(F.reverse("_w"), f" {p} "[::-1])
        lasts.append(F.when(at > 0, spaces(F.substring(F.col("_w"), F.lit(1), F.length("_w") - back - len(p) - 1))))
        counts.append(F.when(at > 0, F.regexp_count("_w", F.lit(f"(?<= ){p}(?= )"))).otherwise(0))
    labels_base = F.array_compact(F.array(*[F.when(F.col(f"_p{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(base)]))
    labels_own = F.array_compact(F.array(*[F.when(F.col("_c")[k].isNotNull(), F.lit(label)) for k, (label, _) in enumerate(templates)]))
    n_base = sum(counts[1:], counts[0])
    return rows.select(
        id_col,
        F.when(F.col("_w") == "  ", F.lit(0)).otherwise(spaces(F.col("_w")) - 1).cast("long").alias("n_words"),
        n_base.cast("long").alias("n_base"),
        F.least(*firsts).cast("long").alias("first_word"),
        F.greatest(*lasts).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(labels_base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(labels_base, labels_own)), ",").alias("labels"),
        F.when(n_base > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max("_c"), F.lit(0.0))).alias("score"),
    )


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    def words(t: str) -> str:
        return "[" + ", ".join(f"'{w}'" for w in sorted(word_set(t))) + "]"

    values = ", ".join(f"({k}, '{label}', {words(t)}, {block_length(t)})" for k, (label, t) in enumerate(TEMPLATES))
    sep = r"'[\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    base = ", ".join(f"('{p}', '{label}')" for p, label in BASE)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
w AS (SELECT r, doc_id, t, [x FOR x IN string_split(regexp_replace(t, {sep}, ' ', 'g'), ' ') IF x <> ''] AS ws FROM d),
b AS (SELECT * FROM (VALUES {base}) AS b(phrase, label)),
places AS (
  SELECT r, label, phrase, len(string_split(phrase, ' ')) AS n, unnest(range(len(ws))) AS i, ws
  FROM w, b WHERE contains(' ' || array_to_string(ws, ' ') || ' ', ' ' || phrase || ' ')),
hits AS (SELECT r, label, i FROM places WHERE array_to_string(ws[i + 1 : i + n], ' ') = phrase),
base AS (SELECT r, count(*) AS n_base, min(i) AS f, max(i) AS l, list(DISTINCT label) AS labels FROM hits GROUP BY r),
templates AS (SELECT * FROM (VALUES {values}) AS v(k, label, words, length)),
whole AS (SELECT r, ws, k, label, words, length FROM w, templates WHERE len(list_intersect(ws, words)) >= ceil({CONTAINMENT} * len(words) - 1e-9)),
blocks AS (SELECT r, label, words, ws[i : i + length - 1] AS block FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM whole) WHERE list_contains(words, ws[i])),
own AS (SELECT r, label, len(list_intersect(block, words)) / len(words) AS share FROM blocks WHERE len(list_intersect(block, words)) >= ceil({CONTAINMENT} * len(words) - 1e-9)),
found AS (SELECT r, list(DISTINCT label) AS labels, max(share) AS share FROM own GROUP BY r)
SELECT doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, f AS first_word, l AS last_word,
  coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(found.labels, [])))), ','), '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0)::DOUBLE END AS score
FROM w LEFT JOIN base USING (r) LEFT JOIN found USING (r)"""


SQL = _sql()
