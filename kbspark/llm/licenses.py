"""License scans by an exact set-similarity join, with DataFrame functions only.

Phrases are looked up as runs of words. Beside them, every text block (a line) that contains a
share of at least ``threshold`` of a template's distinct words carries the template's label:
template words are put in one order by their number of blocks in the whole corpus, rarest first;
a block that meets the threshold holds one of the first ``|T| - need + 1`` words of template T,
so blocks and templates meet under these words only. Length and positional filters bound the
overlap of those that meet, and the rest is verified by intersecting the sets.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbspark.llm._store import materialize
from kbspark.llm._words import GAP, doc_key, lower_ascii

#: Fixed values of the contract: phrase, label.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Opening sentences of public licenses and usual notices: label, text.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("mit", "Released under the MIT License"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("proprietary", "All rights reserved"),
)


def _ascii_words(text: str) -> list[str]:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return "".join(c if c > "\x7f" or "0" <= c <= "9" or "a" <= c <= "z" else " " for c in low).split()


@dataclass(frozen=True)
class LicenseRules:
    """Phrases and templates; both are program text, at most ``max_words`` words in all, and so may be sent everywhere."""

    phrases: tuple[tuple[str, str], ...] = PHRASES
    templates: tuple[tuple[str, str], ...] = TEMPLATES
    threshold: float = 0.8
    max_words: int = 20_000
    sets: tuple[tuple[str, frozenset[str], int], ...] = field(init=False)

    def __post_init__(self):
        sets = [(label, frozenset(_ascii_words(text))) for label, text in self.templates]
        if sum(len(s) for _, s in sets) + sum(len(p.split()) for p, _ in self.phrases) > self.max_words:
            raise ValueError("too many template words to send to every task")
        object.__setattr__(self, "sets", tuple((label, s, max(1, math.ceil(round(self.threshold * len(s), 9)))) for label, s in sets if s))


def _spaced(text: str | Column) -> Column:
    """The words of a text, each after one blank, and a blank at the end."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.coalesce(lower_ascii(text), F.lit("")), GAP, " ")), F.lit(" "))


def _n_words(spaced: Column) -> Column:
    """Words of ``_spaced`` text; two blanks stand for none."""
    return F.when(spaced == "  ", 0).otherwise(F.length(spaced) - F.length(F.replace(spaced, F.lit(" "), F.lit(""))) - 1).cast("long")


def _blanks(part: Column) -> Column:
    return F.length(part) - F.length(F.replace(part, F.lit(" "), F.lit("")))


def _phrases(docs: DataFrame, rules: LicenseRules) -> DataFrame:
    """``k1, k2, doc_id, n_words`` and for each phrase ``i`` its places ``n{i}, first{i}, last{i}``."""
    rows = docs.select(*doc_key(), "doc_id", _spaced("text").alias("spaced"))
    rows = rows.select("*", _n_words(F.col("spaced")).alias("n_words"), *[F.when(F.contains(F.col("spaced"), F.lit(f" {p} ")), F.split("spaced", f" {p}(?= )")).alias(f"parts{i}") for i, (p, _) in enumerate(rules.phrases)])
    out = [F.col(c) for c in ("k1", "k2", "doc_id", "n_words")]
    for i, (p, _) in enumerate(rules.phrases):
        parts = F.col(f"parts{i}")
        out += [F.when(parts.isNotNull(), F.size(parts) - 1).otherwise(0).cast("long").alias(f"n{i}")]
        out += [_blanks(F.get(parts, F.lit(0))).cast("long").alias(f"first{i}")]
        out += [(F.col("n_words") - (_blanks(F.element_at(parts, -1)) - 1) - len(p.split())).cast("long").alias(f"last{i}")]
    return rows.select(*out)


def template_blocks(docs: DataFrame, rules: LicenseRules = LicenseRules()) -> DataFrame:
    """``k1, k2, block, label, containment``: every line and template that meet the threshold."""
    vocabulary = sorted(set().union(*(s for _, s, _ in rules.sets)))
    least = min((need for _, _, need in rules.sets), default=1)
    known = F.array(*map(F.lit, vocabulary))
    lines = docs.select(*doc_key(), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("block", "line"))
    blocks = lines.select("k1", "k2", "block", F.array_intersect(known, F.split(_spaced("line"), " ")).alias("words"))
    blocks = materialize(blocks.where(F.size("words") > 0), "license-blocks")
    df = {r["word"]: r["n"] for r in blocks.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}
    order = sorted(vocabulary, key=lambda w: (df.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    spark = docs.sparkSession
    heads, sets = [], []
    for t, (label, words, need) in enumerate(rules.sets):
        ranked = sorted(rank[w] for w in words)
        sets.append((t, label, len(words), need, ranked))
        heads += [(rank_, t, i) for i, rank_ in enumerate(ranked[: len(words) - need + 1])]
    head = F.broadcast(spark.createDataFrame(heads, "word int, t int, i int"))
    full = F.broadcast(spark.createDataFrame(sets, "t int, label string, size int, need int, words array<int>"))
    ranks = F.create_map(*[x for w in order for x in (F.lit(w), F.lit(rank[w]))])
    ranked = blocks.where(F.size("words") >= least).select("k1", "k2", "block", F.array_sort(F.transform("words", lambda w: ranks[w])).alias("b"))
    met = ranked.select("k1", "k2", "block", "b", F.posexplode("b").alias("j", "word")).join(head, "word").join(full.select("t", "size", "need"), "t")
    most = 1 + F.least(F.col("size") - F.col("i") - 1, F.size("b") - F.col("j") - 1)
    met = met.where((F.size("b") >= F.col("need")) & (most >= F.col("need"))).select("k1", "k2", "block", "b", "t").dropDuplicates(["k1", "k2", "block", "t"])
    both = met.join(full, "t").withColumn("o", F.size(F.array_intersect("b", "words")))
    return both.where("o >= need").select("k1", "k2", "block", "label", (F.col("o") / F.col("size")).alias("containment"))


def scan_licenses(docs: DataFrame, rules: LicenseRules = LicenseRules()) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` for every row of ``docs(doc_id, text)``.

    ``n_base`` counts all places of the phrases, ``first_word`` and ``last_word`` are their least
    and largest starts (null without any), ``labels`` join those of phrases and templates,
    distinct and sorted. ``score`` is 1 with a phrase, else the largest containment of a template
    that reached the threshold, else 0. A null or empty text has no words. Rows that repeat an id and a text
    get the same result, null ids are ids, other columns are not looked at, an empty table gives
    an empty result, long texts are scanned whole.
    """
    base = _phrases(docs, rules)
    found = template_blocks(docs, rules).groupBy("k1", "k2").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    rows = base.join(found, ["k1", "k2"], "left")
    k = range(len(rules.phrases))
    total = sum((F.col(f"n{i}") for i in k), F.lit(0).cast("long"))
    firsts, lasts = F.array(*[F.col(f"first{i}") for i in k]), F.array(*[F.col(f"last{i}") for i in k])
    own = F.array_compact(F.array(*[F.when(F.col(f"n{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(rules.phrases)]))
    own = F.array_sort(F.array_distinct(own))
    every = F.array_sort(F.array_union(own, F.coalesce("more", F.array().cast("array<string>"))))
    score = F.when(total > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0)))
    return rows.select("doc_id", "n_words", total.alias("n_base"), F.array_min(firsts).alias("first_word"), F.array_max(lasts).alias("last_word"), F.array_join(own, ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), score.alias("score"))
