"""License scans: exact set-similarity join of text blocks with templates, by containment.

A document is cut into blocks of 64 words plus the words that the longest template may reach beyond, so no place of a template is lost
at a cut. A block holds a template if it has at least the threshold share of the template's distinct words. Template words are
put in global order, rarest first, by the number of documents that have them. A template is filed under its prefix only: of n
words with a needed, the first n - a + 1; a block that misses all of these cannot have a of them. The length filter drops blocks with
fewer than a words in common with all templates; the positional filter drops a pair if the words that are left behind
the shared one, in the block or in the template, are too few. The pairs that remain are counted exactly. Phrases are templates that
need all their words; their places (consecutive words) are then looked up in the blocks. Licenses are often worded alike, so a template may
name words that no match may lack, whatever the share is (those that tell it from its like).

Only DataFrame operations are used. Words of documents are not moved: the index of templates is a bounded parameter and is broadcast,
and one row per document is shuffled. Null text is empty. Rows that are equal in id and text are one document: one result row;
an id with several texts has a row for each.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STEP = 64
PARTS = (8, 10)          # threshold of templates: 8 of 10 words
MOST_TEMPLATES = 10_000  # bound on the broadcast index
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    exact: bool = False   # a phrase: all its words, one behind the other
    required: str = ""    # words of the text that no match may lack

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def needed(self) -> int:
        n = len(set(self.words))
        return n if self.exact else -(-PARTS[0] * n // PARTS[1])


# Phrases of the contract, and sentences of public licenses.
PHRASES = (
    Template("cc-by", "cc by", True),
    Template("gpl", "general public license", True),
    Template("reserved", "all rights reserved", True),
)
TEMPLATES = PHRASES + (
    Template("apache", "licensed under the apache license version 2 0", required="apache"),
    Template("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain "
             "a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed "
             "under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", required="apache"),
    Template("mit", "released under the mit license", required="mit"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal "
             "in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies "
             "of the software and to permit persons to whom the software is furnished to do so", required="sublicense merge"),
    Template("bsd", "released under the bsd license", required="bsd"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
             "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", required="redistributions binary"),
    Template("gpl", "licensed under the gnu general public license version 3", required="gnu general"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software "
             "foundation either version 3 of the license or at your option any later version", required="gnu general foundation"),
    Template("lgpl", "under the terms of the gnu lesser general public license", required="lesser"),
    Template("mpl", "subject to the terms of the mozilla public license", required="mozilla"),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one "
             "at http mozilla org mpl 2 0", required="mozilla"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", required="cc nc"),
    Template("cc-by-sa", "licensed under a creative commons attribution sharealike license", required="commons sharealike"),
    Template("cc0", "to the extent possible under law the author has waived all copyright and related rights", required="waived"),
    Template("public-domain", "this is free and unencumbered software released into the public domain", required="unencumbered domain"),
)


def word_array(text: str = "text") -> Column:
    """Words of the whole text in lower case. The Kelvin sign, which would turn into an ASCII k, is kept apart."""
    return F.regexp_extract_all(F.lower(F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("K"), F.lit("Ω"))), F.lit(WORDS), F.lit(0))


def _list(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def word_frequencies(docs: DataFrame, words: list[str]) -> list[str]:
    """The given words (those of the templates) in global order: by number of documents that have them, rarest first."""
    counts = docs.select(F.explode(F.array_intersect(word_array(), _list(words))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    known = {r["word"]: r["n"] for r in counts.collect()}  # at most one row per template word
    return sorted(words, key=lambda w: (known.get(w, 0), w))


def prefix_index(spark: SparkSession, templates: tuple[Template, ...], order: list[str]) -> tuple[DataFrame, list[str]]:
    """((word, template, place, n, needed, ...) for the prefix words of all templates, the prefix words)."""
    if len(templates) > MOST_TEMPLATES:
        raise ValueError(f"at most {MOST_TEMPLATES} templates")
    rank = {w: i for i, w in enumerate(order)}
    rows, prefix = [], set()
    for number, t in enumerate(templates):
        words = sorted(set(t.words), key=rank.__getitem__)
        for place, word in enumerate(words[:len(words) - t.needed + 1]):
            prefix.add(word)
            rows.append(F.struct(
                F.lit(word).alias("word"), F.lit(number).alias("template"), F.lit(place).alias("place"), F.lit(len(words)).alias("n"),
                F.lit(t.needed).alias("needed"), F.lit(t.label).alias("label"), F.lit(t.exact).alias("exact"),
                _list(words).alias("distinct_words"), _list(t.words).alias("phrase"), _list(t.required.split()).alias("required")))
    return spark.range(1).select(F.inline(F.array(*rows))), sorted(prefix)


def license_blocks(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """(doc_id, text_key, n_words, start, template, label, exact, share, places) for every block that holds a template.

    `places` are the word positions of an exact phrase that start in the block. A document without any match has one
    row with null in the columns from `start` on.
    """
    order = word_frequencies(docs, sorted({w for t in templates for w in t.words}))
    index, prefix = prefix_index(docs.sparkSession, templates, order)
    reach = max(len(t.words) for t in templates) - 1
    n = F.size("words")
    block = F.transform(F.sequence(F.lit(0), n - 1, F.lit(STEP)), lambda s: F.struct(s.alias("start"), F.slice("words", s + 1, STEP + reach).alias("words")))
    no_block = F.array().cast("array<struct<start:int,words:array<string>>>")
    blocks = docs.select("doc_id", F.xxhash64("text").alias("text_key"), word_array().alias("words")).select(
        "doc_id", "text_key", n.cast("bigint").alias("n_words"),
        F.explode_outer(F.when(F.arrays_overlap("words", _list(prefix)), block).otherwise(no_block)).alias("block"))
    ordered = blocks.withColumn("ordered", F.array_intersect(_list(order), F.col("block.words"))).withColumn("held", F.size("ordered"))
    first_needed = F.when(F.col("held") > 0, F.col("ordered"))
    probes = ordered.select("doc_id", "text_key", "n_words", "block", "ordered", "held", F.posexplode_outer(first_needed).alias("at", "word"))
    pairs = probes.join(F.broadcast(index), "word", "left")
    near = (F.col("held") >= F.col("needed")) & (F.least(F.col("n") - F.col("place"), F.col("held") - F.col("at")) >= F.col("needed"))
    named = F.size(F.array_except("required", "ordered")) == 0
    common = F.when(near & named, F.size(F.array_intersect("distinct_words", "ordered")))
    starts = F.filter(F.sequence(F.lit(0), F.least(F.lit(STEP), F.size("block.words")) - 1),
                      lambda p: F.slice("block.words", p + 1, F.size("phrase")) == F.col("phrase"))
    pairs = pairs.withColumn("common", common)
    places = F.when(F.col("exact"), F.transform(starts, lambda p: (p + F.col("block.start")).cast("bigint")))
    holds = F.coalesce(F.col("common") >= F.col("needed"), F.lit(False))
    found = F.when(holds, F.struct(F.col("block.start").alias("start"), "template", "label", "exact", (F.col("common") / F.col("n")).alias("share"), places.alias("places")))
    kept = pairs.select("doc_id", "text_key", "n_words", found.alias("found")).groupBy("doc_id", "text_key").agg(F.max("n_words").alias("n_words"), F.collect_set("found").alias("found"))
    return kept.select("doc_id", "text_key", "n_words", F.explode_outer("found").alias("f")).select("doc_id", "text_key", "n_words", "f.*")


def scan_licenses(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), one row per document.

    Base columns are about exact phrases, `labels` about all templates; the score is the largest share of a template found.
    """
    rows = license_blocks(docs, templates)
    real = F.coalesce(F.size("places") > 0, F.lit(False))
    counted = F.coalesce(F.when(real, F.size("places")), F.lit(0))
    holds = real | F.coalesce(~F.col("exact"), F.lit(False))
    joined = lambda c: F.array_join(F.sort_array(c), ",")
    return rows.groupBy("doc_id", "text_key").agg(
        F.max("n_words").alias("n_words"), F.sum(counted).cast("bigint").alias("n_base"),
        F.min(F.when(real, F.array_min("places"))).alias("first_word"), F.max(F.when(real, F.array_max("places"))).alias("last_word"),
        joined(F.collect_set(F.when(real, F.col("label")))).alias("base_labels"), joined(F.collect_set(F.when(holds, F.col("label")))).alias("labels"),
        F.coalesce(F.max(F.when(holds, F.col("share"))), F.lit(0.0)).alias("score")).drop("text_key")
