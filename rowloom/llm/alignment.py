"""Cross-tokenizer alignment: which tokens of a byte-level vocabulary (A) and of a piece vocabulary (B) cover the same bytes.

Both tokenizers read a space and then the text, so their tokens cover the same bytes. Work on a batch is Arrow and array work:
lists of ids are flattened with the index of their document, byte lengths are looked up, and a cumulative sum that starts anew in every
document gives the end of each token. A hash join on (document, end) finds the ends that both share: these close the groups. Two tokens
are linked if their bytes overlap, so every distinct end closes exactly one link.

Ids are written once (`encode`); everything else is derived from that table. The count of a pair of ids is the number of documents
that hold it linked: `Table.group_by` counts within a task, Spark merges these counts. The pairs with the highest counts, as many as the
bound allows, go to the tasks as a sorted array; the rare rest is joined by key, so no join has a hot key.

Texts that are null or empty, or whose tokens do not give back a space and the text (a text with U+2581, for example), have no tokens.
Repeated rows and rows without an id each keep their row.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rowloom.llm.frames import bound_batches, join_counted, map_batches
from rowloom.llm.words import segments
from rowloom.session import write_stage

HEAD_PAIRS = 2_000_000     # pairs of ids that every task holds, 17 bytes each
TASK_PAIRS = 1_000_000     # counts that a task gathers before it hands them on
PIECE_TOKENS = 1 << 17     # tokens that are worked on together; a longer document is worked on alone
REMEMBERED = 100_000       # stretches between spaces whose ids a worker remembers from one piece of a batch to the next
LONG_TEXT = 1 << 22        # longer texts are encoded in parts that are cut before a single space
SPACE = "▁"


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it is printable, else the next letter from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(others)}


def _parts(text: str) -> list[str]:
    """A text cut before single spaces, where no token of either vocabulary crosses; the space stays with what follows it."""
    parts = []
    while len(text) > LONG_TEXT:
        at = text.find(" ", LONG_TEXT)
        while 0 <= at < len(text) - 1 and (text[at - 1].isspace() or text[at + 1].isspace()):
            at = text.find(" ", at + 1)
        if not 0 < at < len(text) - 1:
            break
        parts.append(text[:at])
        text = text[at:]
    return [*parts, text]


class ByteVocabulary:
    """A byte-level BPE file: ids of a space and the text, and the bytes of every id.

    If ids follow the merges, which is verified, the ranks of the file are handed to an engine that gives the same ids faster; otherwise
    the file is used as it is.
    """

    def __init__(self, spec: bytes) -> None:
        held = json.loads(spec)
        vocabulary, letters = held["model"]["vocab"], _byte_letters()
        plain = {word: bytes(letters[c] for c in word) for word in vocabulary if all(c in letters for c in word)}
        added = {t["content"]: t["id"] for t in held["added_tokens"]}
        ids = {i: plain.get(word, word.encode()) for word, i in vocabulary.items()} | {i: word.encode() for word, i in added.items()}
        self.bytes = [ids.get(i, b"") for i in range(max(ids) + 1)]
        merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in held["model"]["merges"]]
        ranked = {word: i for word, i in vocabulary.items() if word not in added}
        step = held["pre_tokenizer"] or {}
        plainly = (held["normalizer"] is None and step.get("type") == "ByteLevel" and not step.get("add_prefix_space") and step.get("use_regex")
                   and not held["model"].get("dropout") and not held["model"].get("ignore_merges"))
        if plainly and len(ranked) == 256 + len(merges) and all(ranked.get(m) == 256 + n for n, m in enumerate(merges)):
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, special_tokens={},
                                          mergeable_ranks={plain[word]: i for word, i in ranked.items()})
        else:
            self.fast, self.file = None, Tokenizer.from_str(spec.decode())
            self.file.encode_special_tokens = True

    def _encode(self, text: str) -> np.ndarray:
        if self.fast is None:
            return np.array(self.file.encode(" " + text, add_special_tokens=False).ids, np.int32)
        return np.concatenate([np.array(self.fast.encode_ordinary(p), np.int32) for p in _parts(" " + text)])

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        return [self._encode(t) for t in texts]


class PieceVocabulary:
    """A piece model: ids of the text, before which it sets a space itself, and the bytes of every id.

    If no piece holds a space behind another character, no token crosses from one stretch between single spaces to the next, so the
    ids of a text are those of its stretches, and frequent stretches are encoded once.
    """

    def __init__(self, model: bytes) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.separable = not any(SPACE in p.lstrip(SPACE) for p in pieces)
        self.known: dict[str, list[int]] = {}

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        parts = [_parts(text) if self.separable else [text] for text in texts]
        cut = [[(part[1:] if n else part).split(" ") for n, part in enumerate(row)] for row in parts]
        whole = [self.separable and all(map(all, row)) for row in cut]
        new = list({s for row, easy in zip(cut, whole, strict=True) if easy for stretches in row for s in stretches if s not in self.known})
        self.known.update(zip(new, self.model.encode(new, num_threads=1), strict=True))
        made = [np.fromiter(chain.from_iterable(map(self.known.__getitem__, chain.from_iterable(row))), np.int32) if easy else
                np.array(self.model.encode(text, num_threads=1), np.int32) for text, row, easy in zip(texts, cut, whole, strict=True)]
        if len(self.known) > REMEMBERED:
            self.known = {}
        return made


class Pair:
    """Both vocabularies, with the bytes and byte lengths of their ids as arrays."""

    def __init__(self, spec: bytes, model: bytes) -> None:
        self.sides = (ByteVocabulary(spec), PieceVocabulary(model))
        self.bytes = [pa.array(side.bytes, pa.large_binary()) for side in self.sides]
        self.lengths = [pa.array([len(b) for b in side.bytes], pa.int64()) for side in self.sides]


_pairs: dict[tuple[bytes, bytes], Pair] = {}


def pair_of(spec: bytes, model: bytes) -> Pair:
    """The vocabularies of this worker process, loaded once."""
    key = (spec, model)  # their hashes are kept with the objects
    if key not in _pairs:
        _pairs.clear()
        _pairs[key] = Pair(spec, model)
    return _pairs[key]


def _lists(ids: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, ids)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*ids, np.zeros(0, np.int32)]), pa.int32()))


def _slices(data: pa.Array, starts: np.ndarray) -> Iterator[memoryview]:
    """The joined bytes of the values from each start to the next, of a large binary or string array."""
    offsets = np.frombuffer(data.buffers()[1], np.int64)[data.offset:data.offset + len(data) + 1]
    held = memoryview(data.buffers()[2] or b"")
    at = offsets[starts].tolist()
    return (held[a:b] for a, b in zip(at[:-1], at[1:], strict=True))


def _encoded(texts: pa.Array, pair: Pair) -> list[pa.ListArray]:
    """Ids of both sides; none where a side does not give back a space and the text."""
    rows = texts.to_pylist()
    filled = np.flatnonzero([bool(t) for t in rows]).tolist()
    ids = []
    for side in pair.sides:
        made = [np.zeros(0, np.int32)] * len(rows)
        for n, found in zip(filled, side.encode_all([rows[n] for n in filled]), strict=True):
            made[n] = found
        ids.append(_lists(made))
    wanted = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts.fill_null(""), pa.scalar("", pa.large_string()))
    wanted = list(_slices(wanted, np.arange(len(rows) + 1)))
    whole = np.ones(len(rows), bool)
    for side, known in zip(ids, pair.bytes, strict=True):
        found = _slices(known.take(side.flatten()), side.offsets.to_numpy())
        whole &= np.fromiter((f == w for f, w in zip(found, wanted, strict=True)), bool, len(rows))
    keep = pa.array(whole)
    none = pa.scalar([], pa.list_(pa.int32()))
    return [pc.if_else(keep, side, none) for side in ids]


def encode(docs: DataFrame, spec: bytes, model: bytes) -> DataFrame:
    """(row, doc_id, a_ids, b_ids) of every row, written to the shared folder; `row` numbers the rows.

    `spec` and `model` are the contents of the two vocabulary files. The session is asked for small batches.
    """
    bound_batches(docs.sparkSession)

    def step(batch: pa.RecordBatch) -> dict:
        parts = [(part.column("doc_id"), *_encoded(part.column("text").cast(pa.large_string()), pair_of(spec, model))) for part in segments(batch, "text")]
        return {name: pa.concat_arrays(column) for name, column in zip(("doc_id", "a_ids", "b_ids"), zip(*parts, strict=True), strict=True)}

    made = map_batches(docs.select("doc_id", "text"), step, f"doc_id {dict(docs.dtypes)['doc_id']}, a_ids array<int>, b_ids array<int>")
    return write_stage(made.select(F.monotonically_increasing_id().alias("row"), "*"), "encoded")


def _counts_before(places: np.ndarray, total: int) -> np.ndarray:
    """How many of the given places lie before each place."""
    marks = np.zeros(total, np.int32)
    marks[places] = 1
    return np.cumsum(marks, dtype=np.int32) - marks


class Aligned:
    """Tokens, groups and links of some documents. Every token is in one group, every distinct end closes one link."""

    def __init__(self, a_ids: pa.ListArray, b_ids: pa.ListArray, pair: Pair) -> None:
        self.ids, self.parents, self.starts, ends = [], [], [], []
        for ids, lengths in zip((a_ids, b_ids), pair.lengths, strict=True):
            flat, parent = pc.list_flatten(ids), pc.list_parent_indices(ids)
            starts = np.concatenate(([0], np.cumsum(pc.list_value_length(ids).to_numpy())))
            running = pc.cumulative_sum(lengths.take(flat))
            self.ids.append(flat.to_numpy())
            self.parents.append(parent.to_numpy())
            self.starts.append(starts)
            ends.append(running.to_numpy())
        self.ends, n = ends, len(a_ids)
        # both sides cover the same bytes of each document, so running ends are places in the same bytes
        total = int(ends[0][-1]) + 1 if len(ends[0]) else 0
        cuts = np.zeros(total, bool)
        for e in ends:
            cuts[e] = True
        cuts = np.flatnonzero(cuts)
        own = [_counts_before(e, total)[cuts] for e in ends]
        self.a, self.b = (ids[at] for ids, at in zip(self.ids, own, strict=True))
        self.doc = self.parents[0][own[0]]
        self.link_starts = np.searchsorted(self.doc, np.arange(n + 1))

    def close_groups(self) -> None:
        """Find the groups: `last`, the last token of each on both sides, `group`, the group of each token, and `n_groups` of each document.

        They close where the ends within a document, a cumulative sum that starts anew in each, are shared by both sides.
        """
        tables = []
        for k, (end, parent, starts) in enumerate(zip(self.ends, self.parents, self.starts, strict=True)):
            before = np.concatenate(([0], end))[starts[:-1]]
            doc = parent.astype(np.int64)
            tables.append(pa.table({"doc": doc, "end": end - before[doc], f"at{k}": np.arange(len(end))}))
        shared = tables[0].join(tables[1], ["doc", "end"], join_type="inner", use_threads=False).sort_by("at0")
        self.last = [shared[f"at{k}"].to_numpy() for k in (0, 1)]
        self.group = [_counts_before(last, len(ids)) for last, ids in zip(self.last, self.ids, strict=True)]
        self.n_groups = np.bincount(shared["doc"].to_numpy(), minlength=len(self.starts[0]) - 1)

    def group_texts(self) -> Iterator[memoryview]:
        """`a1,a2|b1;a3|b2,b3` of each document, after `close_groups`."""
        n_a, n_b = len(self.ids[0]), len(self.ids[1])
        per_group = [np.diff(last, prepend=-1) for last in self.last]
        before = [np.concatenate(([0], np.cumsum(c))) for c in per_group]
        place_a = np.arange(n_a) + before[1][self.group[0]]  # tokens of A come behind the groups before them
        place_b = np.arange(n_b) + before[0][self.group[1] + 1]
        ids, marks = np.empty(n_a + n_b, np.int32), np.zeros(n_a + n_b, np.int8)
        ids[place_a], ids[place_b] = self.ids
        marks[place_a[self.last[0]]] = 1
        marks[place_b[self.last[1]]] = 2
        starts = self.starts[0] + self.starts[1]
        ends = starts[1:][np.diff(starts) > 0] - 1
        marks[ends] = 3
        written = pc.binary_join_element_wise(pa.array(ids).cast(pa.large_string()), pa.array([",", "|", ";", ""], pa.large_string()).take(pa.array(marks)),
                                              pa.scalar("", pa.large_string()))
        return _slices(written, starts)

    def document_sums(self, values: np.ndarray) -> np.ndarray:
        """Sum over the links of each document."""
        running = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
        return running[self.link_starts[1:]] - running[self.link_starts[:-1]]

    def pairs(self) -> pa.Table:
        """(doc, a, b, k): how often each pair of ids is linked in each document."""
        links = pa.table({"doc": self.doc.astype(np.int64), "a": self.a, "b": self.b})
        return links.group_by(["doc", "a", "b"], use_threads=False).aggregate([([], "count_all")]).rename_columns(["doc", "a", "b", "k"]).sort_by("doc")


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Row ranges with about PIECE_TOKENS tokens."""
    tokens = pc.add(pc.list_value_length(batch.column("a_ids")), pc.list_value_length(batch.column("b_ids"))).to_numpy()
    ends, at = np.cumsum(tokens), 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE_TOKENS, "right")))
        yield batch.slice(at, to - at)
        at = to


def alignments(encoded: DataFrame, spec: bytes, model: bytes) -> DataFrame:
    """(row, doc_id, a_ids, b_ids, a_last, b_last) of every row: group g ends with the tokens at places a_last[g] and b_last[g]."""

    def step(batch: pa.RecordBatch) -> dict:
        parts = []
        for part in _pieces(batch):
            found = Aligned(part.column("a_ids"), part.column("b_ids"), pair_of(spec, model))
            found.close_groups()
            bounds = pa.array(np.concatenate(([0], np.cumsum(found.n_groups))), pa.int32())
            doc = np.repeat(np.arange(part.num_rows), found.n_groups)
            parts.append([pa.ListArray.from_arrays(bounds, pa.array(last - starts[doc], pa.int32())) for last, starts in zip(found.last, found.starts, strict=True)])
        lasts = [pa.concat_arrays(column) for column in zip(*parts, strict=True)]
        return {name: batch.column(name) for name in ("row", "doc_id", "a_ids", "b_ids")} | {"a_last": lasts[0], "b_last": lasts[1]}

    kind = dict(encoded.dtypes)["doc_id"]
    return map_batches(encoded, step, f"row bigint, doc_id {kind}, a_ids array<int>, b_ids array<int>, a_last array<int>, b_last array<int>")


def pair_counts(encoded: DataFrame, spec: bytes, model: bytes) -> DataFrame:
    """(a, b, n, best): in how many documents the ids are linked, and whether no other pair of this A id has a higher count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def merged(tables: list[pa.Table]) -> pa.Table:
            return pa.concat_tables(tables).group_by(["a", "b"], use_threads=False).aggregate([("n", "sum")]).rename_columns(["a", "b", "n"])

        held: list[pa.Table] = []
        for batch in batches:
            for part in _pieces(batch):
                found = Aligned(part.column("a_ids"), part.column("b_ids"), pair_of(spec, model)).pairs()
                held.append(found.group_by(["a", "b"], use_threads=False).aggregate([([], "count_all")]).rename_columns(["a", "b", "n"]))
                if sum(t.num_rows for t in held) > TASK_PAIRS:
                    held = [merged(held)]
                    if held[0].num_rows > TASK_PAIRS // 2:
                        yield from held.pop().combine_chunks().to_batches()
        if held:
            yield from merged(held).combine_chunks().to_batches()

    partial = encoded.select("a_ids", "b_ids").mapInArrow(run, "a int, b int, n bigint")
    counts = write_stage(partial.groupBy("a", "b").agg(F.sum("n").alias("n")), "pairs")
    highest = counts.groupBy("a").agg(F.max("n").alias("highest"))  # no more rows than the vocabulary has ids
    return counts.join(F.broadcast(highest), "a").select("a", "b", "n", (F.col("n") == F.col("highest")).alias("best"))


def _head(counts: DataFrame) -> tuple[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(least, (keys, counts, flags)): the pairs with at least that count, no more than HEAD_PAIRS, in order of their keys."""
    powers = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("power")).count().orderBy(F.desc("power")).collect()
    total, least = 0, 2**62
    for r in powers:
        total += r["count"]
        if total > HEAD_PAIRS:
            break
        least = 2 ** r["power"]
    if powers and total <= HEAD_PAIRS:
        least = 1
    head = counts.filter(F.col("n") >= least).toArrow()
    keys = head["a"].to_numpy().astype(np.int64) << 32 | head["b"].to_numpy()
    order = np.argsort(keys)
    return least, (keys[order], head["n"].to_numpy()[order], head["best"].to_numpy().astype(bool)[order])


def alignment_digests(encoded: DataFrame, counts: DataFrame, spec: bytes, model: bytes) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row.

    `counts` is the written result of `pair_counts`. Pairs outside the head are handed on with their number and joined by key.
    """
    least, head = _head(counts)
    shared = encoded.sparkSession.sparkContext.broadcast(head)

    def digests(part: pa.RecordBatch) -> dict[str, np.ndarray | pa.Array]:
        keys, numbers, flags = shared.value
        found = Aligned(part.column("a_ids"), part.column("b_ids"), pair_of(spec, model))
        found.close_groups()
        wanted = found.a.astype(np.int64) << 32 | found.b
        at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
        known = keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)
        n, best = (np.where(known, x[at], 0) if len(keys) else np.zeros(len(wanted), np.int64) for x in (numbers, flags))
        n_a, n_b = (np.diff(s) for s in found.starts)
        out = {"n_a": n_a, "n_b": n_b, "n_groups": found.n_groups, "n_links": np.diff(found.link_starts), "n_best": found.document_sums(best),
               "count_sum": found.document_sums(n)}
        texts = [hashlib.sha256(t).hexdigest() if len(t) else "" for t in found.group_texts()]
        rare = np.flatnonzero(~known)
        others = pa.table({"doc": found.doc[rare].astype(np.int64), "a": found.a[rare], "b": found.b[rare]}).group_by(
            ["doc", "a", "b"], use_threads=False).aggregate([([], "count_all")]).sort_by("doc").combine_chunks()
        bounds = np.searchsorted(others["doc"].to_numpy(), np.arange(part.num_rows + 1))
        values = pa.StructArray.from_arrays([pa.array(others[c].to_numpy(), kind) for c, kind in
                                             (("a", pa.int32()), ("b", pa.int32()), ("count_all", pa.int64()))], ["a", "b", "k"])
        return {k: pa.array(v, pa.int64()) for k, v in out.items()} | {
            "groups_sha256": pa.array(texts, pa.string()), "rare": pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values)}

    def step(batch: pa.RecordBatch) -> dict:
        parts = [digests(part) for part in _pieces(batch)]
        return {"row": batch.column("row"), "doc_id": batch.column("doc_id")} | {k: pa.concat_arrays([p[k] for p in parts]) for k in parts[0]}

    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    kind = dict(encoded.dtypes)["doc_id"]
    made = map_batches(encoded, step, f"row bigint, doc_id {kind}, " + ", ".join(f"{n} bigint" for n in names) +
                       ", groups_sha256 string, rare array<struct<a:int,b:int,k:bigint>>")
    if least > 1:
        made = write_stage(made, "digests")
        links = made.select("row", F.explode("rare").alias("link")).select("row", "link.*")
        cold = join_counted(links, counts.filter(F.col("n") < least), ["a", "b"], "n")
        sums = cold.groupBy("row").agg(F.sum(F.col("k") * F.col("best").cast("int")).alias("more_best"), F.sum(F.col("k") * F.col("n")).alias("more_sum"))
        made = made.join(sums, "row", "left").withColumns({
            "n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))})
    return made.select("doc_id", *names, "groups_sha256")


def align(docs: DataFrame, spec: bytes, model: bytes) -> DataFrame:
    """`alignment_digests` of documents (doc_id, text) in one call."""
    encoded = encode(docs, spec, model)
    return alignment_digests(encoded, write_stage(pair_counts(encoded, spec, model), "counts"), spec, model)
