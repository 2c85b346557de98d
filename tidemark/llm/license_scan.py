"""License scans by an exact set-similarity join (operator 1), in DataFrame operations alone.

A text's words are cut into blocks of ``2 * STRIDE`` words that overlap by half, so that every run of up to ``STRIDE`` words
lies within a block. A template is a set of words with a threshold: the share of it that a block has to contain. The join
finds every (block, template) at or above the threshold:

- words are ordered globally by their frequency in all texts, rarest first; only words of templates need a place, as the
  others never meet;
- prefix filter: of a template of n words of which o have to be in the block, one of the n - o + 1 rarest is; the words of
  these prefixes are the index, which is broadcast and bounded by the templates;
- length filter: the block has at least o words of templates;
- positional filter: a first common word at places i and j of the ordered sets leaves min(n - i, m - j) common ones;
- the rest is verified by the intersection itself.

Templates of a phrase ask for all its words; the places where they stand consecutively are then looked up in their blocks.
Labels of longer license texts come from containment.

Null text: empty. A text without words has no block. Rows of the same doc_id and text get the same result, one row each;
other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER, UPPER, documents

STRIDE = 128
#: Postings of templates (a prefix word each) up to which they are broadcast.
BROADCAST = 100_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    threshold: float = 1.0
    phrase: bool = False


#: Phrases of the contract, and their labels (fixed values).
PHRASES = (
    Template("gpl", "gnu general public license", 1.0, True),
    Template("apache", "apache license", 1.0, True),
    Template("cc-by", "cc by", 1.0, True),
    Template("mit", "mit license", 1.0, True),
)
#: Opening sentences of public licenses (fixed values).
LICENSES = (
    Template("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", 0.8),
    Template("apache-text", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied", 0.8),
    Template("gpl-text", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", 0.8),
    Template("bsd-text", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", 0.8),
    Template("isc-text", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", 0.8),
    Template("mpl-text", "This Source Code Form is subject to the terms of the Mozilla Public License", 0.8),
    Template("apache-notice", "Licensed under the Apache License, Version 2.0", 0.8),
    Template("gpl-notice", "This work is licensed under the GNU General Public License, version 3", 0.8),
    Template("mit-notice", "Released under the MIT License", 0.8),
    Template("cc-by-notice", "This work is licensed under a Creative Commons Attribution license CC BY 4.0", 0.8),
)


def words_of(text: str) -> list[str]:
    import re

    return [w for w in re.split(SEPARATORS, text.translate(str.maketrans(UPPER, LOWER))) if w]


def words(text: Column) -> Column:
    """Words of a text, lower-cased in A-Z."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS)
    return F.filter(parts, lambda w: w != "")


def strings(values: Sequence[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def frequencies(docs: DataFrame, vocabulary: Sequence[str]) -> dict[str, int]:
    """How often all texts have each word of the templates: as many rows as the vocabulary, whatever the input."""
    rows = docs.select(F.explode(words(F.col("text"))).alias("w")).where(F.col("w").isin(list(vocabulary))).groupBy("w").count().collect()
    return {r.w: r["count"] for r in rows}


def block_matches(docs: DataFrame, templates: Sequence[Template]) -> DataFrame:
    """(doc_id, text_hash, block, label, phrase, overlap, size, tokens, words): every block at a template's threshold.

    ``docs`` has doc_id and text; block k holds the words from ``STRIDE * k``; ``words`` are the block's, ``tokens`` the
    template's in their own order.
    """
    listed = [words_of(t.text) for t in templates]
    if any(not w or len(w) > STRIDE for w in listed):
        raise ValueError(f"a template has from 1 to {STRIDE} words")
    vocabulary = sorted({w for ws in listed for w in ws})
    seen = frequencies(docs, vocabulary)
    order = sorted(vocabulary, key=lambda w: (seen.get(w, 0), w))
    place = {w: k for k, w in enumerate(order)}
    index, rare = [], set()
    for t, ws in zip(templates, listed, strict=True):
        ordered = sorted(set(ws), key=place.__getitem__)
        n = len(ordered)
        need = max(1, ceil(t.threshold * n - 1e-9))
        for i, w in enumerate(ordered[: n - need + 1]):
            rare.add(w)
            index.append((w, t.label, t.phrase, i, n, need, ordered, ws))
    postings = docs.sparkSession.createDataFrame(index, "token string, label string, phrase boolean, i int, n int, need int, ordered array<string>, tokens array<string>")

    least = min(x[5] for x in index)
    d = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("w"))
    hit = d.where(F.arrays_overlap("w", strings(sorted(rare))))
    # Positions of rare words give the blocks that can match at all; the other blocks aren't built.
    at = F.filter(F.transform("w", lambda x, k: F.when(x.isin(sorted(rare)), F.floor(k / STRIDE).cast("int"))), lambda k: k.isNotNull())
    hit = hit.withColumn("at", F.array_distinct(at))
    blocks = hit.select("doc_id", "text_hash", "w", F.explode(F.filter(F.array_distinct(F.concat("at", F.transform("at", lambda k: k - 1))), lambda k: k >= 0)).alias("block"))
    blocks = blocks.select("doc_id", "text_hash", "block", F.slice("w", F.col("block") * STRIDE + 1, F.lit(2 * STRIDE)).alias("words"))
    blocks = blocks.withColumn("ordered_block", F.array_intersect(strings(order), F.col("words")))
    m = F.size("ordered_block")
    probes = blocks.where(m >= least).select("*", F.posexplode("ordered_block").alias("j", "token"))
    # The postings grow with the templates alone; few are broadcast, and of many Spark decides.
    found = probes.join(F.broadcast(postings) if len(index) <= BROADCAST else postings, "token").where(
        (m >= F.col("need")) & (F.least(F.col("n") - F.col("i"), m - F.col("j")) >= F.col("need"))
    )
    common = F.array_intersect("ordered", "ordered_block")
    found = found.withColumn("common", common).where((F.size("common") >= F.col("need")) & (F.element_at("common", 1) == F.col("token")))
    return found.select("doc_id", "text_hash", "block", "label", "phrase", F.size("common").alias("overlap"), F.col("n").alias("size"), "tokens", "words")


def scan(docs: DataFrame, templates: Sequence[Template] = LICENSES, phrases: Sequence[Template] = PHRASES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row of ``docs``."""
    rows = documents(docs)
    found = block_matches(rows, [*phrases, *templates])
    # A place belongs to the block whose first half it starts in, so each is found once.
    starts = F.filter(
        F.sequence(F.lit(0), F.least(F.lit(STRIDE), F.size("words")) - 1),
        lambda k: F.slice("words", k + 1, F.size("tokens")) == F.col("tokens"),
    )
    found = found.withColumn("places", F.when(F.col("phrase"), F.transform(starts, lambda k: k + F.col("block") * STRIDE)))
    found = found.where(~F.col("phrase") | (F.size("places") > 0))
    hits = found.groupBy("doc_id", "text_hash").agg(
        F.collect_set(F.when(F.col("phrase"), F.struct("label", "places"))).alias("base"),
        F.collect_set(F.when(~F.col("phrase"), F.col("label"))).alias("more"),
        F.max(F.col("overlap") / F.col("size")).alias("score"),
    )
    places = F.flatten(F.transform("base", lambda b: b["places"]))
    base = F.array_sort(F.array_distinct(F.transform("base", lambda b: b["label"])))
    hits = hits.select(
        F.col("doc_id").alias("doc_id_"), F.col("text_hash").alias("text_hash_"), F.size(places).cast("long").alias("n_base"), F.array_min(places).cast("long").alias("first_word"), F.array_max(places).cast("long").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(base, F.col("more"))), ",").alias("labels"), "score",
    )
    all_rows = rows.select("doc_id", F.xxhash64("text").alias("text_hash"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    joined = all_rows.join(hits, F.col("doc_id").eqNullSafe(F.col("doc_id_")) & (F.col("text_hash") == F.col("text_hash_")), "left")
    zero = {"n_base": F.lit(0).cast("long"), "base_labels": F.lit(""), "labels": F.lit(""), "score": F.lit(0.0)}
    return joined.select("doc_id", "n_words", *[F.coalesce(c, zero[c]).alias(c) if c in zero else F.col(c) for c in ("n_base", "first_word", "last_word", "base_labels", "labels", "score")])
