"""Benchmark decontamination: a BM25 inverted index of test items, queried by every training passage.

Documents are cut into passages of P words that overlap by half; P is at least twice the length of an item, so an item
that stands in a document stands whole in one passage. Items are indexed by classes of length, each with its own P, so a long item does not
lengthen the passages of the others. A passage retrieves every item whose BM25 score reaches a share of the
score the item gives itself. Block-max WAND: items lie in blocks of 64, each (term, block) has the largest contribution, and a
block whose sum of these stays below the threshold is skipped; a document is first searched as one passage, which
bounds all of its passages from above. Retrieved pairs are verified: 5-word shingles of the item, words of its question and words
of its answer must be found in the passage.

Items without separate fields: the last quarter of the words is the answer, the rest the question. Words: lower case, ASCII
punctuation dropped. Null or empty texts contain and match nothing; items of fewer than five words are one shingle. Repeated rows
each get their rows; a repeated item id has one row per document and id. Indexes are built for bounded blocks of items with statistics of
all items; as many blocks as PASS_BYTES allows are held at a time, and a document is split into words once for all of them. Nothing is
shuffled but the counts of item words.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from rowloom.llm.frames import map_batches
from rowloom.session import write_stage

K1, B = 1.2, 0.75
RETRIEVE = 0.5          # share of an item's own score
SHINGLE = 5
SHINGLES, QUESTION, ANSWER = 0.8, 0.8, 0.8
ANSWER_PART = 4         # the last 1/4 of the words
LEAST_PASSAGE = 128
ITEM_BLOCK = 20_000     # items held in one index, and
ITEM_BYTES = 16 * 2**20 # bytes of their words
PASS_BYTES = 64 * 2**20 # size of the indexes that one pass over the documents holds
WAND_BLOCK = 64

_SPACES = bytes(32 if c < 48 or 57 < c < 65 or 90 < c < 97 or 122 < c < 128 else c for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.lower().encode().translate(_SPACES).split() if text else []


def passage_words(n: int) -> int:
    """Words of the passages that items of n words are looked for in: the next power of two from 2 n on, at least LEAST_PASSAGE."""
    return max(LEAST_PASSAGE, 2 << (n - 1).bit_length())


def _shingles(words: list) -> set:
    if len(words) <= SHINGLE:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(SHINGLE)), strict=False))


class ItemIndex:
    """Inverted index of one block of items; contributions are in units of the retrieval threshold."""

    def __init__(self, items: list[tuple], document_frequency: dict[bytes, int], n_items: int, mean_words: float, passage: int) -> None:
        items = sorted(((i, w) for i, w in items if w), key=lambda x: len(x[1]))
        self.ids = [i for i, _ in items]
        self.passage = passage
        self.vocabulary = {w: n for n, w in enumerate(sorted({w for _, ws in items for w in ws}))}
        rows, self.shingles, self.question, self.answer = [], [], [], []
        for number, (_, words) in enumerate(items):
            parts = {}
            for word, tf in Counter(words).items():
                df = document_frequency[word]
                idf = math.log(1 + (n_items - df + 0.5) / (df + 0.5))
                parts[word] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / mean_words))
            limit = RETRIEVE * sum(parts.values())
            rows += [(self.vocabulary[w], number, p / limit) for w, p in parts.items()]
            coded = [self.vocabulary[w] for w in words]
            cut = len(coded) - max(1, len(coded) // ANSWER_PART) if len(coded) > 1 else 1
            self.shingles.append(_shingles(coded))
            self.question.append(set(coded[:cut]))
            self.answer.append(set(coded[cut:]) or set(coded))
        rows.sort()
        self.item = np.array([r[1] for r in rows], np.int64)
        self.gain = np.array([r[2] for r in rows])
        terms = np.array([r[0] for r in rows], np.int64)
        self.begin = np.searchsorted(terms, np.arange(len(self.vocabulary) + 1))
        block = self.item // WAND_BLOCK
        first = np.flatnonzero(np.concatenate(([True], (np.diff(terms) != 0) | (np.diff(block) != 0)))) if len(rows) else np.zeros(0, np.int64)
        self.block = block[first]
        self.block_max = np.maximum.reduceat(self.gain, first) if len(first) else np.zeros(0)
        self.block_begin = np.searchsorted(terms[first], np.arange(len(self.vocabulary) + 1))
        self.blocks = len(items) // WAND_BLOCK + 1

    @staticmethod
    def _lists(begin: np.ndarray, terms: np.ndarray) -> np.ndarray:
        low, size = begin[terms], begin[terms + 1] - begin[terms]
        return np.repeat(low - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())

    def search(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(items, scores in units of the threshold) of all items at or above it, for distinct terms."""
        if not len(terms):
            return terms, terms.astype(float)
        at = self._lists(self.block_begin, terms)
        alive = np.bincount(self.block[at], self.block_max[at], self.blocks) >= 1 - 1e-9
        if not alive.any():
            return terms[:0], np.zeros(0)
        at = self._lists(self.begin, terms)
        at = at[alive[self.item[at] // WAND_BLOCK]]
        scores = np.bincount(self.item[at], self.gain[at], len(self.ids))
        found = np.flatnonzero(scores >= 1 - 1e-9)
        return found, scores[found]

    def matches(self, words: list[bytes]) -> dict[int, tuple]:
        """item number -> (passages, score, shingle share, question share, answer share) of verified items."""
        get = self.vocabulary.get
        coded = np.array([get(w, -1) for w in words], np.int64)
        distinct = np.unique(coded)
        if not len(self.search(distinct[distinct >= 0])[0]):
            return {}
        step, found = self.passage // 2, {}
        for start in range(0, max(1, -(-len(coded) // step) - 1) * step, step):
            passage = coded[start:start + self.passage]
            distinct = np.unique(passage)
            items, scores = self.search(distinct[distinct >= 0])
            if not len(items):
                continue
            there, shingles = set(distinct.tolist()), _shingles_in(passage.tolist())
            for item, score in zip(items.tolist(), scores.tolist(), strict=True):
                own = self.shingles[item]
                size = len(next(iter(own)))
                share = len(own & shingles(size)) / len(own)
                question = len(self.question[item] & there) / len(self.question[item])
                answer = len(self.answer[item] & there) / len(self.answer[item])
                if share >= SHINGLES and question >= QUESTION and answer >= ANSWER:
                    old = found.get(item, (0, 0.0, 0.0, 0.0, 0.0))
                    found[item] = (old[0] + 1, *map(max, old[1:], (score * RETRIEVE, share, question, answer)))
        return found


def _shingles_in(words: list[int]) -> Callable[[int], set]:
    made: dict[int, set] = {}

    def of(size: int) -> set:
        if size not in made:
            made[size] = set(zip(*(words[i:] for i in range(size)), strict=False))
        return made[size]

    return of


def item_indexes(items: DataFrame) -> Iterator[ItemIndex]:
    """One index per block of items of one class of length; statistics are of all items."""

    def step(batch: pa.RecordBatch) -> dict:
        words = [words_of(t) for t in batch.column("text").to_pylist()]
        return {"item_id": batch.column("item_id"), "words": pa.array(words, pa.list_(pa.binary())), "passage": pa.array([passage_words(max(len(w), 1)) for w in words], pa.int64()),
                "size": pa.array([sum(map(len, w)) for w in words], pa.int64())}

    schema = f"item_id {dict(items.dtypes)['item_id']}, words array<binary>, passage bigint, size bigint"
    split = write_stage(map_batches(items.select("item_id", "text").distinct(), step, schema).filter("size(words) > 0"), "items")
    classes = split.groupBy("passage").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), F.sum(F.size("words")).alias("words")).orderBy("passage").collect()
    total = sum(r["n"] for r in classes)
    mean = sum(r["words"] for r in classes) / max(total, 1)
    counts = split.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    for r in classes:
        blocks = max(-(-r["n"] // ITEM_BLOCK), -(-r["size"] // ITEM_BYTES))
        for block in range(blocks):
            part = split.filter((F.col("passage") == r["passage"]) & (F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks)) == block))
            held = [(x["item_id"], [bytes(w) for w in x["words"]]) for x in part.select("item_id", "words").collect()]  # about ITEM_BLOCK items, ITEM_BYTES bytes
            used = part.select(F.explode("words").alias("word")).distinct()
            frequency = {bytes(x["word"]): x["df"] for x in used.join(counts, "word").collect()}
            yield ItemIndex(held, frequency, total, mean, r["passage"])


def index_passes(items: DataFrame) -> Iterator[list[bytes]]:
    """The indexes, serialised, in groups that one pass over the documents holds."""
    held: list[bytes] = []
    for index in item_indexes(items):
        made = pickle.dumps(index)
        if held and sum(map(len, held)) + len(made) > PASS_BYTES:
            yield held
            held = []
        held.append(made)
    if held:
        yield held


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_passages, score, shingle_share, question_share, answer_share): verified pairs.

    The score is the best passage's share of the item's own score.
    """
    item_type, doc_type = dict(items.dtypes)["item_id"], dict(docs.dtypes)["doc_id"]
    arrow_item = to_arrow_type(items.schema["item_id"].dataType)
    schema = f"doc_id {doc_type}, item_id {item_type}, n_passages int, score double, shingle_share double, question_share double, answer_share double"
    out = docs.sparkSession.createDataFrame([], schema)
    names = [f.split()[0] for f in schema.split(", ")]
    for held in index_passes(items):
        shared = docs.sparkSession.sparkContext.broadcast(held)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            indexes = [pickle.loads(x) for x in shared.value]
            for batch in batches:
                rows = []
                for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                    best: dict = {}
                    words = words_of(text.as_py())
                    for index in indexes:
                        for item, found in index.matches(words).items():
                            best[index.ids[item]] = max(best.get(index.ids[item], found), found)
                    rows += [(doc, item, *found) for item, found in best.items()]
                if rows:
                    types = [batch.schema.field("doc_id").type, arrow_item, pa.int32(), *[pa.float64()] * 4]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        out = out.unionByName(docs.select("doc_id", "text").mapInArrow(run, schema))
    return out


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of `docs`, with all their columns, that contain no item."""
    for held in index_passes(items):
        shared = docs.sparkSession.sparkContext.broadcast(held)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            indexes = [pickle.loads(x) for x in shared.value]

            def clean(text: str | None) -> bool:
                words = words_of(text)
                return not any(index.matches(words) for index in indexes)

            for batch in batches:
                yield batch.filter(pa.array([clean(t.as_py()) for t in batch.column("text")], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
