"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text.

The lexicon holds whole words and word beginnings. Some words are given, each with its common endings; all other entries are learned
from labelled rows: smoothed log odds of the documents with an entry among toxic and clean ones. Every entry that stands in a few toxic documents
and weighs enough is taken. Text and lexicon are folded alike (lower case, compatibility forms, look-alike letters, digits and signs
that stand for letters). Of all entries that match from one word's start the heaviest counts; a match inside an exception phrase does not.

Length: toxic texts use such words all the way, others meet one by chance, more often the longer they are. So every word of the text costs a
fixed amount, as does the text itself, and the score is a logistic curve of the sum of the weights less these costs.

Null or empty text scores 0. Repeated rows score alike, each in its own row. Without labelled rows the given
lexicon alone is used. Labels, languages, sources and ids are never part of a score.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.frames import id_bucket, map_batches

TRAIN_ROWS = 40_000      # bound on the labelled rows that are learned from (expected size of a sample by id digest)
MIN_SUPPORT = 3          # toxic documents an entry must occur in
MIN_WEIGHT = 3.0
HELD_ENTRIES = 50_000    # entries a task holds before it sends its counts and starts anew
STEMS = (3, 4, 5, 6, 7)  # lengths of word beginnings
THRESHOLD = 0.7
WORD_COST = 0.03         # of every word of a text: a match of weight 3 makes up for 100 words
TEXT_COST = 1.5
SLOPE = 2.0

# Given lexicon (insults) with weights, and phrases in which its words are harmless.
LEXICON = {"idiot": 5.0, "moron": 5.0, "stupid": 4.0, "scum": 4.5, "loser": 4.0, "pathetic": 4.0, "worthless": 4.0,
           "disgusting": 4.0, "trash": 3.5, "clown": 3.5}
ENDINGS = ("", "s", "es", "y", "ish", "ly", "ity")
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "trash collection", "clown fish", "circus clown", "class clown",
              "sore loser bracket", "loser bracket", "losers bracket")

# Letters that look alike, and digits and signs that stand for letters.
_LOOKS = {"а": "a", "в": "b", "е": "e", "ё": "e", "з": "3", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p",
          "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "ԁ": "d", "ո": "n", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i",
          "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l"}
_DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"}
_SIGNS = {"@": "a", "$": "s", "!": "i", "|": "l"}
_HIDDEN = dict.fromkeys(map(ord, "­​‌‍⁠﻿"))
_TABLE = str.maketrans(_LOOKS | _DIGITS) | _HIDDEN
_ASCII = str.maketrans(_DIGITS)
_INNER_SIGN = re.compile(r"(?<=\w)[@$!|]+(?=\w)")
_WORD = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    if text.isascii():
        out = text.lower().translate(_ASCII)
    else:
        out = unicodedata.normalize("NFKC", text).lower().translate(_TABLE)
    if any(sign in out for sign in _SIGNS):
        out = _INNER_SIGN.sub(lambda m: "".join(_SIGNS[c] for c in m[0]), out)
    return out


def build_matcher(words: dict[str, float], stems: dict[str, float], exceptions: tuple[str, ...]) -> ahocorasick.Automaton:
    """Automaton over folded entries; a value is (length, whole word?, weight), weight None for an exception."""
    automaton = ahocorasick.Automaton()
    entries: dict[str, list] = {}
    for source, whole in ((stems, False), (words, True)):
        for entry, weight in source.items():
            entries.setdefault(fold(entry), []).append((whole, weight))
    for phrase in exceptions:
        for form in (phrase, phrase + "s"):
            entries.setdefault(fold(form), []).append((True, None))
    for entry, values in entries.items():
        automaton.add_word(entry, (len(entry), values))
    automaton.make_automaton()
    return automaton


def raw_score(automaton: ahocorasick.Automaton, text: str | None) -> tuple[float, int]:
    """(score, number of matched words) of one whole text."""
    if not text:
        return 0.0, 0
    folded = fold(text)
    found: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    for end, (length, values) in automaton.iter(folded):
        start = end - length + 1
        if start and folded[start - 1].isalnum():
            continue
        closed = end + 1 == len(folded) or not folded[end + 1].isalnum()
        for whole, weight in values:
            if whole and not closed:
                continue
            if weight is None:
                spared.append((start, end))
            else:
                found[start] = max(found.get(start, 0.0), weight)
    if spared:
        found = {s: w for s, w in found.items() if not any(a <= s <= b for a, b in spared)}
    if not found:
        return 0.0, 0
    costs = TEXT_COST + WORD_COST * sum(1 for _ in _WORD.finditer(folded))
    return 1 / (1 + math.exp(min((costs - sum(found.values())) / SLOPE, 700.0))), len(found)


def lexicon_counts(labelled: DataFrame) -> DataFrame:
    """(entry, whole, toxic, clean): documents with the entry, by label. Tasks add up a bounded number of entries at a time before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())

        def send() -> pa.RecordBatch:
            keys = list(counts[0].keys() | counts[1].keys())
            made = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()), *(
                pa.array([counts[i][k] for k in keys], pa.int64()) for i in (1, 0))], ["entry", "whole", "toxic", "clean"])
            counts[0].clear()
            counts[1].clear()
            return made

        for batch in batches:
            for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
                words = set(_WORD.findall(fold(text.as_py() or "")))
                features = {(w, True) for w in words}
                features |= {(w[:n], False) for w in words for n in STEMS if len(w) > n}
                counts[1 if toxic == 1 else 0].update(features)
                if len(counts[0]) + len(counts[1]) > HELD_ENTRIES:
                    yield send()
        yield send()

    made = labelled.select("text", "toxic").mapInArrow(run, "entry string, whole boolean, toxic bigint, clean bigint")
    return made.groupBy("entry", "whole").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def learn_lexicon(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[dict[str, float], dict[str, float]]:
    """(words, stems) with weights, learned from at most about `train_rows` labelled rows of `docs`.

    The labels are sampled by a digest of the id first, so that the side that is broadcast is bounded. An id
    labelled more than once is toxic if any of its labels says so.
    """
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = known.count()
    if not total:
        return {}, {}
    share = min(1.0, train_rows / total)
    sample = known.filter(F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    labelled = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    size = {r["toxic"]: r["n"] for r in sample.groupBy((F.col("toxic") == 1).alias("toxic")).agg(F.count("*").alias("n")).collect()}
    toxic, clean = size.get(True, 0), size.get(False, 0)
    weight = F.log((F.col("toxic") + 0.5) / (toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (clean + 1.0))
    found = lexicon_counts(labelled).filter(F.col("toxic") >= MIN_SUPPORT).withColumn("weight", weight).filter(F.col("weight") >= MIN_WEIGHT)
    best = found.collect()  # entries of at most about `train_rows` texts
    return ({r["entry"]: r["weight"] for r in best if r["whole"]}, {r["entry"]: r["weight"] for r in best if not r["whole"]})


def _matcher(lexicon: tuple[dict[str, float], dict[str, float]]) -> ahocorasick.Automaton:
    words = {entry + ending: weight for entry, weight in LEXICON.items() for ending in ENDINGS}
    for entry, weight in lexicon[0].items():
        words[entry] = max(weight, words.get(entry, 0.0))
    return build_matcher(words, lexicon[1], EXCEPTIONS)


def score_toxicity(docs: DataFrame, lexicon: tuple[dict[str, float], dict[str, float]]) -> DataFrame:
    """(doc_id, score, n_matches, predicted) of every row."""
    made = []

    def step(batch: pa.RecordBatch) -> dict:
        made[:] = made or [_matcher(lexicon)]
        scores = [raw_score(made[0], t.as_py()) for t in batch.column("text")]
        return {"doc_id": batch.column("doc_id"), "score": pa.array([s for s, _ in scores], pa.float64()),
                "n_matches": pa.array([n for _, n in scores], pa.int64()),
                "predicted": pa.array([int(s >= THRESHOLD) for s, _ in scores], pa.int32())}

    return map_batches(docs.select("doc_id", "text"), step, f"doc_id {dict(docs.dtypes)['doc_id']}, score double, n_matches bigint, predicted int")


def keep_civil(docs: DataFrame, lexicon: tuple[dict[str, float], dict[str, float]]) -> DataFrame:
    """The rows of `docs`, with all their columns, that do not reach the threshold. Nothing is shuffled."""
    made = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made[:] = made or [_matcher(lexicon)]
        for batch in batches:
            yield batch.filter(pa.array([raw_score(made[0], t.as_py())[0] < THRESHOLD for t in batch.column("text")], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def training_docs(docs: DataFrame) -> DataFrame:
    """Rows that may be learned from: remainder of crc32(doc_id) by 3 is not 1."""
    return docs.filter(id_bucket("doc_id", 3) != 1)
