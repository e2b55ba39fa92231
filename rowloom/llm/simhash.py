"""SimHash near-duplicates: fingerprints, a Gray-order hierarchical index, connected components.

Fingerprint: lower-cased (A-Z) words of the whole text, 4-word shingles with repeats, XXH64 with seed 42; a bit is set if it is
set in more than half of the shingle hashes. Fewer than four words are one shingle; no word (or null) is fingerprint 0.

Linking works on distinct fingerprints. Two codes that differ in at most d of 64 bits agree on at least k - d of k
blocks, so each code is filed under every choice of k - d blocks: the masked bit pattern is the upper node of the
index. Below it the codes stand in Gray order; runs of neighbours are nodes that hold the bits all members share
(mask and pattern). Nodes are compared with nodes from the top: differences on shared bits add up to a lower
bound, and a pair of groups beyond d is dropped whole; a pair whose upper bound is within d, or whose members
are already connected, is not opened either. A node of many codes is cut into blocks and compared block by block, so
no task holds an unbounded group, and only spanning links are written.

Ids may be null: such a row has a fingerprint and the component of its equals, and never names a component.
Repeated rows each keep their row.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.frames import fresh_names, join_counted, map_batches, match_rows, row_key
from rowloom.session import write_stage

SHINGLE = 4
SEED = 42
DISTANCE = 4
LEAF = 32
FANOUT = 8
BUCKET_CODES = 64        # expected codes under one masked pattern
BLOCK_CODES = 1024       # codes of one pattern that one comparison holds on each side
_STEP = 1 << 16


def fingerprint(text: bytes) -> int:
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = len(words) - SHINGLE + 1
    if size < 1:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:size].tolist()
    ends = ends[SHINGLE - 1:].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, size, _STEP):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at:at + _STEP], ends[at:at + _STEP], strict=True)], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > size, bitorder="little").view("<u8")[0])


def _codes(column: pa.Array) -> pa.Array:
    texts = column.cast(pa.large_string()).cast(pa.large_binary()).fill_null(b"")
    return pa.array(np.fromiter((fingerprint(t.as_buffer().to_pybytes()) for t in texts), np.uint64, len(column)).view(np.int64))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, code) of every row; the code is the fingerprint as a signed long."""

    def step(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column("doc_id"), "code": _codes(batch.column("text"))}

    return map_batches(docs.select("doc_id", "text"), step, f"doc_id {dict(docs.dtypes)['doc_id']}, code bigint")


def rows_with_codes(docs: DataFrame) -> DataFrame:
    """(row, place, code): key, order (by doc_id with null last, then by text digest) and fingerprint of every row."""
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("text_key"))
    keyed = docs.select(place.alias("place"), row_key().alias("row"), "text")

    def step(batch: pa.RecordBatch) -> dict:
        return {"place": batch.column("place"), "row": batch.column("row"), "code": _codes(batch.column("text"))}

    kind = dict(docs.dtypes)["doc_id"]
    return map_batches(keyed, step, f"place struct<none:boolean,doc_id:{kind},text_key:bigint>, row struct<a:bigint,b:bigint>, code bigint")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each code in the Gray sequence."""
    rank = codes.astype(np.uint64)
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank ^ (rank >> np.uint64(shift))
    return rank


class Forest:
    """Disjoint sets with whole-array relabelling."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            la, lb = self.label[a], self.label[b]
            open_ = la != lb
            if not open_.any():
                return
            a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
            low, high = np.minimum(la, lb), np.maximum(la, lb)
            parent = np.arange(len(self.label))
            np.minimum.at(parent, high, low)
            while True:
                up = parent[parent]
                if (up == parent).all():
                    break
                parent = up
            self.label = parent[self.label]


def _tree(codes: np.ndarray) -> list[dict]:
    """Levels of the index over codes in Gray order, leaves first."""
    levels, size, n = [], LEAF, len(codes)
    full = ~np.uint64(0)
    while True:
        first = np.arange(0, n, size)
        every = np.bitwise_and.reduceat(codes, first)
        some = np.bitwise_or.reduceat(codes, first)
        levels.append({"first": first, "last": np.minimum(first + size, n), "mask": full ^ (every ^ some), "pattern": every})
        if len(first) == 1:
            return levels
        size *= FANOUT


def _one_label(label: np.ndarray, level: dict) -> np.ndarray:
    low, high = np.minimum.reduceat(label, level["first"]), np.maximum.reduceat(label, level["first"])
    return np.where(low == high, low, -1)


def link_codes(codes: np.ndarray, distance: int = DISTANCE) -> np.ndarray:
    """Label (smallest position in its set) of each of the distinct codes, given in Gray order."""
    forest, levels = Forest(len(codes)), _tree(codes)
    stack = [(len(levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        height, a, b = stack.pop()
        level = levels[height]
        if len(a) > 4096:
            stack += [(height, a[4096:], b[4096:])]
            a, b = a[:4096], b[:4096]
        one = _one_label(forest.label, level)
        keep = (one[a] < 0) | (one[a] != one[b])
        a, b = a[keep], b[keep]
        shared = level["mask"][a] & level["mask"][b]
        least = np.bitwise_count((level["pattern"][a] ^ level["pattern"][b]) & shared)
        near = least <= distance
        sure = near & (least + np.bitwise_count(~shared) <= distance)
        for x, y in zip(a[sure], b[sure], strict=True):  # all members within the distance
            members = np.arange(level["first"][x], level["last"][x])
            others = np.arange(level["first"][y], level["last"][y])
            all_ = np.concatenate((members, others))
            forest.join(all_[:-1], all_[1:])
        a, b = a[near & ~sure], b[near & ~sure]
        if not len(a):
            continue
        if height:
            below = levels[height - 1]
            left = (a[:, None] * FANOUT + np.arange(FANOUT))[:, :, None]
            right = (b[:, None] * FANOUT + np.arange(FANOUT))[:, None, :]
            left, right = (np.broadcast_to(x, (len(a), FANOUT, FANOUT)).reshape(-1) for x in (left, right))
            there = (left < len(below["first"])) & (right < len(below["first"])) & (left <= right)
            stack.append((height - 1, left[there], right[there]))
            continue
        for at in range(0, len(a), 256):
            x, y = a[at:at + 256], b[at:at + 256]
            left = level["first"][x][:, None] + np.arange(LEAF)
            right = level["first"][y][:, None] + np.arange(LEAF)
            there = (left < level["last"][x][:, None])[:, :, None] & (right < level["last"][y][:, None])[:, None, :]
            left, right = np.minimum(left, len(codes) - 1), np.minimum(right, len(codes) - 1)
            hit = there & (np.bitwise_count(codes[left][:, :, None] ^ codes[right][:, None, :]) <= distance)
            p, i, j = np.nonzero(hit)
            forest.join(left[p, i], right[p, j])
    return forest.label


def masks(count: int, distance: int = DISTANCE) -> list[int]:
    """Bit masks (as signed longs) under which any two codes within the distance share a pattern at least once."""
    blocks = distance + 1
    while blocks < 2 * distance and count > BUCKET_CODES << (64 * (blocks - distance) // blocks):
        blocks += 1
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in range(blocks)]
    chosen = [sum(c) for c in combinations(parts, blocks - distance)]
    return [m - 2**64 if m >= 2**63 else m for m in chosen]


def _link_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning links inside each group of rows with equal keys; rows come sorted by key and Gray rank."""
    keys, held = ("choice", "pattern", "i", "j"), None

    def emit(part: dict) -> pa.RecordBatch | None:
        change = np.zeros(len(part["rank"]), bool)
        change[:1] = True
        for k in keys:
            change[1:] |= part[k][1:] != part[k][:-1]
        first = np.flatnonzero(change)
        last = np.append(first[1:], len(change))
        ranks = part["rank"].view(np.uint64) ^ np.uint64(1 << 63)
        codes = ranks ^ (ranks >> np.uint64(1))
        below, above = [], []
        for a, b in zip(first[last - first > 1].tolist(), last[last - first > 1].tolist(), strict=True):
            own = codes[a:b]
            label = link_codes(own)
            moved = np.flatnonzero(label != np.arange(b - a))
            if len(moved):
                below.append(own[label[moved]])
                above.append(own[moved])
        if not below:
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (below, above)], ["u", "v"])

    for batch in batches:
        part = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in (*keys, "rank")}
        if held is not None:
            part = {k: np.concatenate((held[k], v)) for k, v in part.items()}
        n = len(part["rank"])
        if not n:
            continue
        differs = np.zeros(n, bool)
        for k in keys:
            differs |= part[k] != part[k][-1]
        whole = int(np.flatnonzero(differs)[-1]) + 1 if differs.any() else 0
        held = {k: v[whole:] for k, v in part.items()}
        if whole and (made := emit({k: v[:whole] for k, v in part.items()})) is not None:
            yield made
    if held is not None and len(held["rank"]) and (made := emit(held)) is not None:
        yield made


def near_links(codes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(u, v): links that span the sets of distinct codes within the distance; `codes` has one row per code."""
    count = codes.count()
    chosen = masks(count, distance)

    def ranked(batch: pa.RecordBatch) -> dict:
        code = batch.column("code").to_numpy(zero_copy_only=False)
        return {"code": batch.column("code"), "rank": pa.array((gray_rank(code.view(np.uint64)) ^ np.uint64(1 << 63)).view(np.int64))}

    filed = map_batches(codes.select("code"), ranked, "code bigint, rank bigint").select("rank", F.explode(F.array(*[
        F.struct(F.lit(i).alias("choice"), F.col("code").bitwiseAND(F.lit(m)).alias("pattern")) for i, m in enumerate(chosen)])).alias("k")
    ).select("k.choice", "k.pattern", "rank")
    filed = write_stage(filed, "filed")
    sizes = write_stage(filed.groupBy("choice", "pattern").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "sizes")
    placed = join_counted(filed, sizes, ["choice", "pattern"], "n")
    parts = F.ceil(F.col("n") / BLOCK_CODES).cast("int")
    own = F.pmod(F.xxhash64("rank"), F.col("parts")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: F.struct(F.least(x, "own").alias("i"), F.greatest(x, "own").alias("j")))
    placed = placed.withColumn("parts", parts).withColumn("own", own).select("choice", "pattern", "rank", F.explode(pairs).alias("p"))
    keys = ["choice", "pattern", "i", "j"]
    dealt = placed.select("choice", "pattern", "p.i", "p.j", "rank").repartition(*keys).sortWithinPartitions(*keys, "rank")
    return dealt.mapInArrow(_link_sorted, "u bigint, v bigint").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, label): smallest node reachable, for every node of the links.

    Each round takes the smallest label among neighbours, then the label's own label. Every round is written
    to the shared folder; the driver sees a few counts per round. Nodes with many links and labels with many nodes are
    counted first, and the hot ones are joined without moving their rows.
    """
    both = write_stage(links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))), "links")
    start = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label"), F.count(F.lit(1)).alias("degree"))
    labels = write_stage(start.withColumn("label", F.least("node", "label")), "labels")
    while True:
        at = labels.select(F.col("node").alias("v"), F.col("label").alias("seen"), "degree")
        least = join_counted(both, at, ["v"], "degree").groupBy(F.col("u").alias("node")).agg(F.min("seen").alias("seen"))
        hooked = write_stage(labels.join(least, "node").select("node", "degree", F.col("label").alias("old"), F.least("label", "seen").alias("label")), "hooked")
        members = hooked.groupBy("label").agg(F.count(F.lit(1)).alias("members"))
        roots = write_stage(members.join(labels.select(F.col("node").alias("label"), F.col("label").alias("root")), "label"), "roots")
        new = join_counted(hooked, roots, ["label"], "members").select("node", "degree", "old", F.least("label", "root").alias("label"))
        new = write_stage(new, "labels")
        if new.filter("label <> old").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label", "degree")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, code, component_id) of every row; component_id is the smallest doc_id reachable over links."""
    prints = write_stage(fingerprints(docs), "prints")
    codes = write_stage(prints.groupBy("code").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("copies")), "codes")
    nodes = components(near_links(codes, distance)).withColumnRenamed("node", "code")
    sets = nodes.join(codes, "code").groupBy("label").agg(F.min("least_id").alias("set_id"), F.count(F.lit(1)).alias("members"))
    named = join_counted(nodes, write_stage(sets, "sets"), ["label"], "members").select("code", "set_id")
    classes = codes.join(named, "code", "left").select("code", "copies", F.coalesce("set_id", "least_id").alias("component_id"))
    return join_counted(prints, write_stage(classes, "classes"), ["code"], "copies").select("doc_id", "code", "component_id")


def keep_one(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """`docs` with one row of every near-duplicate group: the smallest by (doc_id, digest of the text), rows without an id last.

    Of rows that are equal in both, one is kept. Only keys of rows move, texts do not while the lists are within the broadcast bound.
    """
    rows = docs.select("doc_id", "text")
    prints = write_stage(rows_with_codes(rows), "prints")
    codes = write_stage(prints.groupBy("code").agg(F.min("place").alias("least"), F.count(F.lit(1)).alias("copies")), "codes")
    nodes = components(near_links(codes.select("code"), distance)).withColumnRenamed("node", "code")
    own = codes.join(nodes, "code", "left").withColumn("label", F.coalesce("label", "code"))
    sets = write_stage(own.groupBy("label").agg(F.min("least").alias("first"), F.count(F.lit(1)).alias("members")), "sets")
    classes = write_stage(join_counted(own, sets, ["label"], "members").select("code", "copies", "first"), "classes")
    judged = write_stage(join_counted(prints, classes, ["code"], "copies").select("row", (F.col("place") == F.col("first")).alias("stays")), "judged")
    left = match_rows(docs, judged.filter("NOT stays").select("row").distinct(), "left_anti")
    twice = judged.filter("stays").groupBy("row").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("row")
    if twice.isEmpty():
        return left
    key, = fresh_names(docs, "_same")
    again = match_rows(left, twice, "left_semi").withColumn(key, row_key()).dropDuplicates([key]).drop(key)
    return match_rows(left, twice, "left_anti").unionByName(again)


def hex_digits(code: str) -> F.Column:
    return F.lower(F.lpad(F.hex(F.col(code)), 16, "0"))
