"""MinHash near-duplicates: SuperMinHash signatures, banding, verification on whole sets, union of what is linked.

Words are lower-cased (A-Z) runs of bytes other than space and 09-0D. A text's set holds its distinct 5-word shingles; a shorter text is one
shingle, and a text without words (or null) has an empty set and is linked with nothing. Shingles are told apart by digests of 64 bits,
sets by two sums of 64 bits. Rows with equal sets are one node.

SuperMinHash: every element draws one permutation of the signature's components, place by place, and at place j proposes j plus a
fraction for the component drawn; a component keeps the least proposal. So each component is tried by some element as early as possible,
which lowers the variance against independent hashes. Once all components of a text are filled no later place matters, and it stops.

Banding: BANDS keys of ROWS components each. Two sets of similarity s share no key with probability (1 - s^ROWS)^BANDS: 7e-9 at 0.85 with the
defaults. Before whole sets are compared, pairs are dropped by their sizes (exact) and if their signatures agree in less than
LEAST_AGREEMENT of the components, more than five standard deviations below the threshold.

Large groups: every key first compares its nodes with one centre only, the node that meets most others over all its keys (the original
of a group of edited copies does). After linking what that finds, only keys that still hold several components are looked at, in blocks
of bounded size: signatures tell which nodes have a partner there, whole sets of these are counted against one another as products of
element matrices, and links that span what is found are handed on. No pair is capped or sampled, and pairs never become rows.

Rows without an id belong to components but never name one; a row is kept if its id names its component (without an id: if no id does).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.frames import bound_batches, join_counted, map_batches
from rowloom.llm.simhash import Forest, components
from rowloom.llm.words import column_bytes, gram_hashes, mix, segments, word_hashes, word_spans
from rowloom.session import join_bounded, stage_small, write_stage

SHINGLE = 5
BANDS, ROWS = 32, 5
COMPONENTS = BANDS * ROWS
SIMILARITY = (17, 20)      # 0.85
LEAST_AGREEMENT = 0.68
BLOCK_NODES = 512          # nodes of one key that one comparison holds on each side, about, and
BLOCK_ITEMS = 1_000_000    # items of their sets
PRODUCT_ITEMS = 4096       # items that one product of matrices takes
HOT_SET_ITEMS = 8_000_000  # hot sets are broadcast up to this many items together
_EMPTY = np.uint32(0xFFFFFFFF)
_STRIDE = np.uint64(0x9E3779B97F4A7C15)
_FRACTION = 24             # bits of a proposal below its place
_strides = np.arange(1, COMPONENTS + 1, dtype=np.uint64) * _STRIDE


def shingle_sets(texts: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, check, starts): distinct shingle digests of each text in order, a second digest of each, and the first one's number."""
    raw, offsets = column_bytes(texts)
    raw = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)
    start, end, first = word_spans(raw, offsets)
    words = word_hashes(raw, start, end)
    counts = np.diff(first)
    text = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(text))
    found = []
    for size in range(1, shingle + 1):
        grams = gram_hashes(words, size)
        at = place[:len(grams[0])]
        fits = at + size <= first[text[at] + 1] if size == shingle else (counts[text[at]] == size) & (at == first[text[at]])
        at = at[fits]
        found.append((text[at], mix(grams[0][at] + np.uint64(size)), grams[1][at] + np.uint64(size)))
    owner, hashes, check = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((hashes, owner))
    owner, hashes, check = owner[order], hashes[order], check[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    owner, hashes, check = owner[new], hashes[new], check[new]
    return hashes, check, np.searchsorted(owner, np.arange(len(counts) + 1))


def signatures(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """SuperMinHash signature of each set, one row each; components of empty sets are all ones."""
    n = len(starts) - 1
    out = np.full(n * COMPONENTS, _EMPTY)
    owner, x, permuted = np.repeat(np.arange(n), np.diff(starts)), hashes, None
    for place in range(COMPONENTS):
        draw = mix(x + _strides[place])
        other = place + ((draw & np.uint64(0xFFFFFFFF)) * np.uint64(COMPONENTS - place) >> np.uint64(32)).astype(np.int64)
        if permuted is None:
            chosen = other
        else:
            each = np.arange(len(x))
            chosen = permuted[each, other].astype(np.int64)
            permuted[each, other] = permuted[:, place]
        np.minimum.at(out, owner * COMPONENTS + chosen, (np.uint32(place << _FRACTION) | (draw >> np.uint64(64 - _FRACTION)).astype(np.uint32)))
        open_ = (out.reshape(n, COMPONENTS) == _EMPTY).any(axis=1)[owner]
        if not open_.any():
            break
        if permuted is None:
            permuted = np.tile(np.arange(COMPONENTS, dtype=np.uint16), (int(open_.sum()), 1))
            permuted[np.arange(len(permuted)), other[open_]] = 0
        elif not open_.all():
            permuted = permuted[open_]
        owner, x = owner[open_], x[open_]
    return out.reshape(n, COMPONENTS)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One key for each band of each signature."""
    parts = signature.reshape(len(signature), BANDS, ROWS).astype(np.uint64)
    keys = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=np.uint64) * _STRIDE), parts.shape[:2])
    for r in range(ROWS):
        keys = mix(keys * np.uint64(3) + parts[:, :, r])
    return keys


def sketches(signature: np.ndarray) -> np.ndarray:
    """Eight bits of each component: equal components stay equal, so agreement is never underestimated."""
    return (mix(signature.astype(np.uint64)) & np.uint64(0xFF)).astype(np.uint8)


def _segment_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    running = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
    return running[starts[1:]] - running[starts[:-1]]


def _codes(hashes: np.ndarray, check: np.ndarray, starts: np.ndarray) -> dict[str, pa.Array]:
    """Two digests of each set."""
    return {name: pa.array(_segment_sums(mix(x ^ _STRIDE), starts).view(np.int64)) for name, x in (("code", hashes), ("code2", check))}


def signed_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, code, code2, n, bands, sketch) of every row; n is the size of its set."""

    def step(batch: pa.RecordBatch) -> dict:
        parts = []
        for part in segments(batch, "text"):
            hashes, check, starts = shingle_sets(part.column("text"))
            signature, sizes = signatures(hashes, starts), np.diff(starts)
            bands = band_keys(signature)[sizes > 0]
            bounds = np.concatenate(([0], np.cumsum((sizes > 0) * BANDS))).astype(np.int32)
            parts.append({**_codes(hashes, check, starts), "n": pa.array(sizes, pa.int64()),
                          "bands": pa.ListArray.from_arrays(pa.array(bounds), pa.array(bands.reshape(-1).view(np.int64))),
                          "sketch": pa.array([s.tobytes() for s in sketches(signature)], pa.binary())})
        return {"doc_id": batch.column("doc_id"), "text_key": batch.column("text_key")} | {
            k: pa.concat_arrays([p[k] for p in parts]) for k in parts[0]}

    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    return map_batches(keyed, step, f"doc_id {dict(docs.dtypes)['doc_id']}, text_key bigint, code bigint, code2 bigint, n bigint, bands array<bigint>, sketch binary")


def listed_sets(docs: DataFrame, listed: DataFrame) -> DataFrame:
    """(node, hashes) of the nodes in `listed` (node, code, code2, text_key)."""
    staged, fits = stage_small(listed, "listed")
    keys = staged.select("text_key").distinct()
    rows = join_bounded(docs.select(F.xxhash64("text").alias("text_key"), "text"), keys, ["text_key"], fits, "left_semi").select("text")

    def step(batch: pa.RecordBatch) -> dict:
        parts = []
        for part in segments(batch, "text"):
            hashes, check, starts = shingle_sets(part.column("text"))
            parts.append({**_codes(hashes, check, starts),
                          "hashes": pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(hashes.view(np.int64)))})
        return {k: pa.concat_arrays([p[k] for p in parts]) for k in parts[0]}

    made = map_batches(rows, step, "code bigint, code2 bigint, hashes array<bigint>")
    return join_bounded(made, staged.select("node", "code", "code2"), ["code", "code2"], fits).groupBy("node").agg(F.first("hashes").alias("hashes"))


def _with_sets(pairs: DataFrame, sets: DataFrame, side: str, name: str, other: str) -> DataFrame:
    """Attach the set of one side to every pair; sets that many pairs need are broadcast up to a bound, beyond it they are salted."""
    needed = sets.select(F.col("node").alias(side), F.col("hashes").alias(name), f"as_{side}", F.size("hashes").alias("_items")).filter(f"as_{side} > 0")
    limit = 1_000
    hot = needed.filter(F.col(f"as_{side}") > limit)
    items = hot.agg(F.coalesce(F.sum("_items"), F.lit(0))).first()[0]
    keys = hot.select(side)  # each has more than `limit` of the pairs
    if not items:
        return pairs.join(needed.select(side, name), side)
    marked = join_bounded(pairs, keys.withColumn("_hot", F.lit(True)), [side], items <= HOT_SET_ITEMS, "left")
    cold = marked.filter("_hot IS NULL").drop("_hot").join(needed.filter(F.col(f"as_{side}") <= limit).select(side, name), side)
    warm = join_bounded(marked.filter("_hot").drop("_hot"), hot.select(side, name), [side], items <= HOT_SET_ITEMS, spread=other)
    return cold.unionByName(warm)


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (u, v) that are similar enough on their whole sets."""
    degrees = pairs.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("as_u"), F.lit(0).alias("as_v")),
                                             F.struct(F.col("v").alias("node"), F.lit(0).alias("as_u"), F.lit(1).alias("as_v")))).alias("e"))
    degrees = degrees.groupBy("e.node").agg(F.sum("e.as_u").alias("as_u"), F.sum("e.as_v").alias("as_v"))
    degrees = write_stage(degrees.join(nodes.select("node", "code", "code2", "text_key"), "node"), "degrees")
    sets = listed_sets(docs, degrees.select("node", "code", "code2", "text_key"))
    sets = write_stage(sets.join(degrees.select("node", "as_u", "as_v"), "node"), "sets")
    both = _with_sets(_with_sets(pairs, sets, "v", "b", "u"), sets, "u", "a", "v")
    over, under = SIMILARITY
    common = F.size(F.array_intersect("a", "b"))
    return both.filter((over + under) * common >= over * (F.size("a") + F.size("b"))).select("u", "v")


def _agreeing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Do rows of two arrays of sketches agree well enough?"""
    return (x == y).sum(axis=1) >= LEAST_AGREEMENT * x.shape[1]


def _rows_of(sketch: pa.Array) -> np.ndarray:
    width = len(sketch[0].as_py()) if len(sketch) else 1
    return np.frombuffer(b"".join(sketch.to_pylist()), np.uint8).reshape(len(sketch), width)


def agreeing_pairs(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (u, v) whose signatures agree well enough. `pairs` is a written table with few pairs of one v, u may be hot."""
    degrees = write_stage(pairs.groupBy("u").agg(F.count(F.lit(1)).alias("as_u")).join(
        nodes.select(F.col("node").alias("u"), F.col("sketch").alias("a")), "u"), "centres_seen")
    both = join_counted(pairs, degrees, ["u"], "as_u").join(nodes.select(F.col("node").alias("v"), F.col("sketch").alias("b")), "v")

    def step(batch: pa.RecordBatch) -> dict:
        keep = pa.array(_agreeing(_rows_of(batch.column("a")), _rows_of(batch.column("b"))))
        return {"u": batch.column("u").filter(keep), "v": batch.column("v").filter(keep)}

    return map_batches(both.select("u", "v", "a", "b"), step, "u bigint, v bigint")


def _sorted_groups(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[pa.Table]:
    """One table for each group of rows with equal values; rows come sorted by them."""
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        if not rows.num_rows:
            continue
        change = np.any([np.diff(rows[c].to_numpy()) != 0 for c in names], axis=0)
        first = np.concatenate(([0], np.flatnonzero(change) + 1)).tolist()
        for a, b in zip(first[:-1], first[1:], strict=True):
            yield rows.slice(a, b - a)
        held = rows.slice(first[-1]).combine_chunks()
    if held is not None and held.num_rows:
        yield held


def _sides(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    own = rows["own"].to_numpy()
    return tuple(np.flatnonzero(own == rows[c][0].as_py()) for c in ("i", "j"))


def _fitting(rows: pa.Table, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which pairs are of different components and have sizes that allow the similarity."""
    (over, under), n, label = SIMILARITY, rows["n"].to_numpy(), rows["label"].to_numpy()
    low, high = np.minimum.outer(n[left], n[right]), np.maximum.outer(n[left], n[right])
    return (under * low >= over * high) & (label[left][:, None] != label[right][None, :])


def _with_partner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, node) of the nodes that have a partner in their block whose signature agrees."""
    for rows in _sorted_groups(batches, ("key", "i", "j")):
        left, right = _sides(rows)
        sketch, node = _rows_of(rows["sketch"].combine_chunks()), rows["node"].to_numpy()
        found = np.zeros(rows.num_rows, bool)
        fits = _fitting(rows, left, right)
        for at, others in zip(left.tolist(), fits, strict=True):
            near = right[others]
            near = near[_agreeing(sketch[near], sketch[at][None, :])]
            found[near] = True
            found[at] |= len(near) > 0
        if found.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(int(found.sum()), rows["key"][0].as_py())), pa.array(node[found])], ["key", "node"])


def _common(items: np.ndarray, owner: np.ndarray, count: int) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets; an item that stands in one set only is left out first."""
    _, item, times = np.unique(items, return_inverse=True, return_counts=True)
    item, owner = item[times[item] > 1], owner[times[item] > 1]
    _, item = np.unique(item, return_inverse=True)
    order = np.argsort(item, kind="stable")
    item, owner = item[order], owner[order]
    common = np.zeros((count, count), np.float32)  # whole numbers up to 2^24 are exact
    for low in range(0, int(item[-1]) + 1 if len(item) else 0, PRODUCT_ITEMS):
        part = slice(*np.searchsorted(item, (low, low + PRODUCT_ITEMS)))
        held = np.zeros((count, PRODUCT_ITEMS), np.float32)
        held[owner[part], item[part] - low] = 1
        common += held @ held.T
    return common.astype(np.int64)


def _link_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v): links that span what is similar enough inside each block, on whole sets."""
    over, under = SIMILARITY
    for rows in _sorted_groups(batches, ("key", "i", "j")):
        left, right = _sides(rows)
        sets = rows["hashes"].combine_chunks()
        common = _common(sets.flatten().to_numpy(), pc.list_parent_indices(sets).to_numpy(), rows.num_rows)[np.ix_(left, right)]
        n, node = rows["n"].to_numpy(), rows["node"].to_numpy()
        x, y = np.nonzero(_fitting(rows, left, right) & ((over + under) * common >= over * np.add.outer(n[left], n[right])))
        forest = Forest(rows.num_rows)
        forest.join(left[x], right[y])
        moved = np.flatnonzero(forest.label != np.arange(rows.num_rows))
        if len(moved):
            yield pa.RecordBatch.from_arrays([pa.array(node[forest.label[moved]]), pa.array(node[moved])], ["u", "v"])


def centre_pairs(placed: DataFrame) -> DataFrame:
    """(u, v): for every key its centre u with each other node of a fitting size."""
    over, under = SIMILARITY
    met = placed.groupBy("node").agg(F.sum("m").alias("met"))
    best = F.max_by(F.struct("node", "n"), F.struct("met", -F.col("node"))).alias("centre")
    centres = write_stage(placed.join(met, "node").groupBy("key").agg(best, F.count(F.lit(1)).alias("m")).select(
        "key", "m", F.col("centre.node").alias("u"), F.col("centre.n").alias("u_n")), "centres")
    fits = under * F.least("n", "u_n") >= over * F.greatest("n", "u_n")
    joined = join_counted(placed.drop("m"), centres, ["key"], "m")
    return joined.filter(fits & (F.col("u") != F.col("node"))).select("u", F.col("node").alias("v")).distinct()


def _dealt(rows: DataFrame, keys: DataFrame, *more: str) -> DataFrame:
    """Rows of (key, node, n, label) in blocks: every two blocks i <= j of a key meet once. `keys` has (key, m, items)."""
    parts = F.greatest(F.ceil(F.col("m") / BLOCK_NODES), F.ceil(F.col("items") / BLOCK_ITEMS)).cast("int")
    dealt = join_counted(rows, write_stage(keys, "keys"), ["key"], "m").withColumn("parts", parts)
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    blocks = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: F.struct(F.least(x, "own").alias("i"), F.greatest(x, "own").alias("j")))
    return dealt.select("key", "node", "n", "label", "own", F.explode(blocks).alias("p")).select("key", "p.i", "p.j", "own", "node", "n", "label")


def _in_order(dealt: DataFrame) -> DataFrame:
    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def block_links(placed: DataFrame, labels: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(u, v): links between different components that share a key."""
    bound_batches(docs.sparkSession)
    named = placed.join(labels.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").select(
        "key", "node", "n", F.coalesce("label", "node").alias("label"))
    named = write_stage(named, "labelled")

    def mixed(rows: DataFrame) -> DataFrame:
        sums = rows.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("items"), F.min("label").alias("low"), F.max("label").alias("high"))
        return sums.filter("low < high").select("key", "m", "items")

    dealt = _dealt(named, mixed(named)).join(nodes.select("node", "sketch"), "node")
    met = _in_order(dealt).mapInArrow(_with_partner, "key bigint, node bigint").distinct()
    met = write_stage(met.join(named, ["key", "node"]), "met")
    if met.isEmpty():
        return met.select(F.col("node").alias("u"), F.col("node").alias("v"))
    sets = listed_sets(docs, met.select("node").distinct().join(nodes.select("node", "code", "code2", "text_key"), "node"))
    dealt = _dealt(met, mixed(met)).join(write_stage(sets, "met_sets"), "node")
    return _in_order(dealt).mapInArrow(_link_blocks, "u bigint, v bigint").distinct()


def near_links(docs: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((u, v), (node, label)): links between different sets that span their components, and the components."""
    filed = nodes.select("node", "n", F.explode("bands").alias("key"))
    shared = write_stage(filed.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"), "shared")
    placed = write_stage(join_counted(filed, shared, ["key"], "m"), "placed")
    first = write_stage(centre_pairs(placed), "star")
    links = write_stage(verified(write_stage(agreeing_pairs(first, nodes), "star_near"), docs, nodes), "links")
    labels = components(links)
    more = write_stage(block_links(placed, labels, nodes, docs), "more_links")
    if more.isEmpty():
        return links, labels
    links = links.unionByName(more)
    return links, components(links)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id, kept) of every row."""
    rows = write_stage(signed_rows(docs), "signed")
    sets = rows.filter("n > 0").groupBy("code", "code2").agg(
        F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.min("text_key").alias("text_key"),
        F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("copies"))
    nodes = write_stage(sets.select(F.monotonically_increasing_id().alias("node"), "*"), "nodes")
    _, labels = near_links(docs, nodes)
    own = nodes.select("node", "code", "code2", "least_id", "copies").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = write_stage(own.groupBy("label").agg(F.min("least_id").alias("component_id"), F.count(F.lit(1)).alias("members")), "named")
    classes = write_stage(join_counted(own, named, ["label"], "members").select("code", "code2", "copies", "component_id"), "classes")
    narrow = rows.select("doc_id", "text_key", "code", "code2", "n")
    linked = join_counted(narrow.filter("n > 0"), classes, ["code", "code2"], "copies").select("doc_id", "text_key", "n", "component_id")
    alone = narrow.filter("n = 0").select("doc_id", "text_key", "n", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).select("doc_id", "text_key", F.col("n").alias("n_shingles"), "component_id",
                                            F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
