"""Substring dedup: words covered by a 50-word window that also starts in a document with a smaller doc_id.

1. Count-min prefilter. Every window is represented by its anchor: of the 25-word grams it contains, the one with
   the smallest hash. Equal windows have equal anchors, so a count of the documents with an anchor is never below the count
   of documents with the window. Each task counts anchors in a sketch of fixed size, and sends its
   occupied cells; the sketches are added up by ranges of cells. A cell needs no more than "twice or more",
   so the merged sketch is a bitmap of fixed size (2 x 8 MB), small enough to broadcast whatever the input is.
   A full sketch lets more windows through; it never loses one.
2. Exact pass. Only windows whose anchor is estimated to be in two documents go on. Neighbouring windows with one
   anchor travel as one run, known by a 128-bit digest of its words. Equal runs are one class with its smallest doc_id;
   the windows of the classes are grouped by (anchor, 64-bit window digest) for the smallest doc_id with that window;
   each run then learns which of its windows have a smaller document.
3. The removed words of each document are joined to its text.

Windows are judged on the input. Null text has no words; a row without an id neither removes nor loses words; rows with equal ids
never remove words from each other. Repeated rows each keep their row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm import words as W
from rowloom.llm.frames import join_counted, match_rows, row_key
from rowloom.session import write_stage

WINDOW = 50
GRAM = 25
ROWS = 2                       # hash rows of the sketch
CELL_BITS = 26                 # cells of each row: 2^26, as bits 8 MB
RANGE_BITS = 18                # cells in one range: 2^18
PIECE_BYTES = 2**18            # text that is hashed at a time: about 60 bytes are held for each of its bytes
SEND_BYTES = 32 * 2**20        # text after which a task sends its sketch and starts anew


def _cells(anchor: np.ndarray, row: int) -> np.ndarray:
    return (W.mix(anchor + np.uint64(row * 0x9E3779B97F4A7C15 & (2**64 - 1))) >> np.uint64(64 - CELL_BITS)).astype(np.int64)


class _Windows:
    """Words, windows and runs of one piece of a batch."""

    def __init__(self, piece: pa.RecordBatch) -> None:
        raw, offsets = W.column_bytes(piece.column("text"))
        start, end, self.first = W.word_spans(raw, offsets)
        words = W.word_hashes(raw, start, end)
        self.hash = W.gram_hashes(words, WINDOW)[0]
        grams = W.gram_hashes(words, GRAM)
        n = len(self.hash)
        doc = np.repeat(np.arange(piece.num_rows), np.diff(self.first))[:n]
        self.at = np.flatnonzero((np.arange(n) + WINDOW <= self.first[1:][doc]) & ~piece.column("doc_id").is_null().to_numpy(zero_copy_only=False)[doc])
        self.doc = doc[self.at]
        self.hash = self.hash[self.at]
        self.anchor = (W.sliding_min(grams[0], WINDOW - GRAM + 1) if n else grams[0][:0])[self.at]
        self.words = words

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """(first, last) of the runs of neighbouring windows with one anchor, as positions in the window arrays."""
        if not len(self.at):
            return self.at, self.at
        new = np.ones(len(self.at), bool)
        new[1:] = (self.anchor[1:] != self.anchor[:-1]) | (self.at[1:] != self.at[:-1] + 1) | (self.doc[1:] != self.doc[:-1])
        first = np.flatnonzero(new)
        # an anchor that occurs again right behind itself must not make a run of more than 31 windows
        last = np.append(first[1:], len(self.at))
        while (last - first > 31).any():
            first = np.unique(np.concatenate((first, (first + 31)[last - first > 31])))
            last = np.append(first[1:], len(self.at))
        return first, last


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sketches of a task as (part, cells, many): per range of cells the occupied ones, and which hold two or more."""
    held: list[np.ndarray] = []
    size = 0

    def send() -> Iterator[pa.RecordBatch]:
        anchors = np.concatenate(held)
        for row in range(ROWS):
            cell, count = np.unique(_cells(anchors, row), return_counts=True)
            part = cell >> RANGE_BITS
            cut = np.flatnonzero(np.diff(part)) + 1
            low = (cell & ((1 << RANGE_BITS) - 1)).astype("<u4")
            yield pa.RecordBatch.from_arrays([
                pa.array([row << (CELL_BITS - RANGE_BITS) | int(p[0]) for p in np.split(part, cut)], pa.int32()),
                pa.array([c.tobytes() for c in np.split(low, cut)], pa.binary()),
                pa.array([np.packbits(c > 1).tobytes() for c in np.split(count, cut)], pa.binary())], ["part", "cells", "many"])

    for batch in batches:
        for piece in W.segments(batch, "text", PIECE_BYTES):
            windows = _Windows(piece)
            first, _ = windows.runs()
            anchor, doc = windows.anchor[first], windows.doc[first]
            order = np.lexsort((anchor, doc))  # each document counts once
            anchor, doc = anchor[order], doc[order]
            once = np.ones(len(anchor), bool)
            once[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
            if once.any():
                held.append(anchor[once])
            size += piece.nbytes
            if size >= SEND_BYTES and held:
                yield from send()
                held, size = [], 0
    if held:
        yield from send()


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add up the sketches of each range (rows come sorted by range) to a bitmap of the cells that hold two or more."""
    now, count = -1, np.zeros(1 << RANGE_BITS, np.uint8)

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(count > 1).tobytes()], pa.binary())], ["part", "bits"])

    for batch in batches:
        for part, cells, many in zip(batch.column("part").to_pylist(), batch.column("cells").to_pylist(), batch.column("many").to_pylist(), strict=True):
            if part != now:
                if now >= 0:
                    yield made()
                now, count = part, np.zeros(1 << RANGE_BITS, np.uint8)
            cell = np.frombuffer(cells, "<u4")
            two = np.unpackbits(np.frombuffer(many, np.uint8), count=len(cell))
            count[cell] = np.minimum(count[cell] + 1 + two, 2)
    if now >= 0:
        yield made()


def repeated_cells(docs: DataFrame) -> np.ndarray:
    """Merged sketch: for each hash row, a bitmap of the cells with two or more. Its size is fixed."""
    sent = docs.select("doc_id", "text").mapInArrow(_sketch, "part int, cells binary, many binary")
    merged = sent.repartition("part").sortWithinPartitions("part").mapInArrow(_merge, "part int, bits binary")
    bitmap = np.zeros((ROWS << CELL_BITS) // 8, np.uint8)
    width = (1 << RANGE_BITS) // 8
    for row in merged.toLocalIterator():
        bitmap[row["part"] * width:(row["part"] + 1) * width] = np.frombuffer(row["bits"], np.uint8)
    return bitmap


def _estimated(bitmap: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Is the anchor's estimated number of documents two or more?"""
    found = np.ones(len(anchor), bool)
    for row in range(ROWS):
        cell = _cells(anchor, row) + (row << CELL_BITS)
        found &= (bitmap[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1).astype(bool)
    return found


RUN_FIELDS = "text_key bigint, start int, c1 bigint, c2 bigint, anchor bigint, hashes array<bigint>"


def window_runs(docs: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """(doc_id, text_key, start, c1, c2, anchor, hashes): runs of windows estimated repeated."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in W.segments(batch, "text", PIECE_BYTES):
                windows = _Windows(piece)
                first, last = windows.runs()
                kept = _estimated(shared.value, windows.anchor[first]) if len(first) else first.astype(bool)
                first, last = first[kept], last[kept]
                if not len(first):
                    continue
                n = last - first
                doc = windows.doc[first]
                begin = windows.at[first]
                digest = [_range_hash(w, begin, n + WINDOW - 1, k) for k, w in enumerate(windows.words)]
                take = np.repeat(first - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.array(windows.hash[take].view(np.int64)))
                yield pa.RecordBatch.from_arrays([
                    piece.column("doc_id").take(pa.array(doc)), piece.column("text_key").take(pa.array(doc)),
                    pa.array((begin - windows.first[doc]).astype(np.int32)), *(pa.array(d.view(np.int64)) for d in digest),
                    pa.array(windows.anchor[first].view(np.int64)), lists], ["doc_id", "text_key", "start", "c1", "c2", "anchor", "hashes"])

    return docs.select("doc_id", "text_key", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, {RUN_FIELDS}")


def _range_hash(words: np.ndarray, begin: np.ndarray, size: np.ndarray, which: int) -> np.ndarray:
    """Hash of the words [begin, begin + size)."""
    power, inverse = (t for t in (W._powers.upto(len(words) + 1)[which], W._powers.upto(len(words) + 1)[which + 2]))
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * power[:-1], out=sums[1:])
    return W.mix((sums[begin + size] - sums[begin]) * inverse[begin] + size.astype(np.uint64))


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, start, mask): bit i of mask set if the window that starts at word start + i is a repeat.

    `docs` has doc_id, text and text_key (a digest of the text, to tell rows with equal ids apart).
    """
    runs = write_stage(window_runs(docs, repeated_cells(docs)), "runs")
    same = ["c1", "c2"]
    classes = runs.groupBy(*same).agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.min("anchor").alias("anchor"),
                                      F.min("hashes").alias("hashes"), F.count(F.lit(1)).alias("copies"))
    classes = write_stage(classes, "classes")
    # an anchor with one class needs no look at its windows: they all have the smallest document of the class
    anchors = classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("least").alias("first"), F.max("most").alias("final")).filter("first < final")
    repeated = write_stage(join_counted(classes, write_stage(anchors.select("anchor", "n"), "anchors"), ["anchor"], "n"), "repeated")
    alone = repeated.filter("n = 1").select(*same, "copies", F.transform("hashes", lambda h, i: F.struct(i.alias("i"), F.col("least").alias("least"))).alias("windows"))
    windows = repeated.filter("n > 1").select(*same, "copies", "anchor", "least", "most", F.posexplode("hashes").alias("i", "hash"))
    least = windows.groupBy("anchor", "hash").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.count(F.lit(1)).alias("n")).filter("least < most")
    least = write_stage(least.drop("most"), "least")
    known = (join_counted(windows.drop("least", "most"), least, ["anchor", "hash"], "n").groupBy(*same, "copies")
             .agg(F.collect_list(F.struct("i", "least")).alias("windows"))).unionByName(alone)  # at most 31 windows
    mask = F.aggregate(F.filter("windows", lambda w: w["least"] < F.col("doc_id")), F.lit(0), lambda m, w: m.bitwiseOR(F.call_function("shiftleft", F.lit(1), w["i"])))
    found = join_counted(runs.select("doc_id", "text_key", "start", *same), write_stage(known, "known"), same, "copies")
    return found.select("doc_id", "text_key", "start", mask.alias("mask")).filter("mask <> 0")


def _covered(n_words: int, runs: list[dict] | None) -> np.ndarray:
    """Which of a document's words are removed."""
    step = np.zeros(n_words + 1, np.int64)
    for run in runs or ():
        starts = run["start"] + np.flatnonzero(np.unpackbits(np.array([run["mask"]], "<u4").view(np.uint8), bitorder="little"))
        np.add.at(step, starts, 1)
        np.add.at(step, starts + WINDOW, -1)
    return np.cumsum(step[:-1]) > 0


def _with_runs(docs: DataFrame) -> DataFrame:
    """All columns of `docs` and, as the last one, the repeated windows of each row.

    The list of windows is written once; it is broadcast only within the size bound, else both sides are shuffled.
    """
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    found = repeated_windows(keyed).groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "mask")).alias("windows"))
    row = row_key("text_key")
    return match_rows(docs, found.select(row.alias("row"), "windows"), "left", "windows")


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[bytes, list[dict] | None]]:
    """(text, runs) of each row."""
    column = batch.column("text").cast(pa.large_string()).cast(pa.large_binary()).fill_null(b"")
    return zip((t.as_buffer().to_pybytes() for t in column), batch.column(batch.num_columns - 1).to_pylist(), strict=True)


def dedup_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, digests = [], [], []
            for text, runs in _texts(batch):
                words = text.split()
                gone = _covered(len(words), runs) if runs else None
                kept = words if gone is None else [w for w, g in zip(words, gone, strict=True) if not g]
                counts.append(len(words))
                removed.append(len(words) - len(kept))
                digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())],
                                             ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return _with_runs(docs.select("doc_id", "text")).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_words bigint, n_removed bigint, kept_sha256 string")


def _cut(text: bytes, runs: list[dict]) -> bytes:
    """The text without its removed words; the white space before a kept word stays."""
    raw = np.frombuffer(text, np.uint8)
    start, end, _ = W.word_spans(raw, np.array([0, len(raw)]))
    gone = _covered(len(start), runs)
    keep = np.ones(len(raw), bool)
    step = np.zeros(len(raw) + 1, np.int64)
    before = np.concatenate(([0], end[:-1]))
    np.add.at(step, before[gone], 1)
    np.add.at(step, end[gone], -1)
    keep &= np.cumsum(step[:-1]) == 0
    return raw[keep].tobytes()


def remove_repeats(docs: DataFrame) -> DataFrame:
    """`docs` with repeated words cut out of `text` (and `n_chars`, if there is such a column, counted again).

    Rows of which no word is left go; rows that had no word stay.
    """
    with_runs = _with_runs(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = batch.column(batch.num_columns - 1).to_pylist()
            where = [i for i, r in enumerate(runs) if r]
            batch = batch.select(batch.schema.names[:-1])
            if where:
                texts = batch.column("text").to_pylist()
                for i in where:
                    texts[i] = _cut(texts[i].encode(), runs[i]).decode()
                batch = batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, batch.column("text").type))
                empty = [bool(r) and not texts[i].strip(" \t\n\v\f\r") for i, r in enumerate(runs)]
                batch = batch.filter(pa.array([not e for e in empty]))
            yield batch

    kept = with_runs.mapInArrow(run, docs.schema)
    return kept.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else kept
