"""Conversation prefix trie: which openings conversations share, and how many words storing each opening once would save.

Every distinct sequence of first d turns (role, text) is a node; the root has no turn. Turns are told apart by 128 bits of SHA-256, nodes
by their depth and sums of hashes of (turn, place). Narrow rows move, texts do not.

Nodes with one member are rows of a single conversation and need no search. The others are put together to segments: a run of nodes
with the same members, which the smallest member and the number of members name. Segments are sorted by their path
(range partitions, so an opening that a third of all conversations share is spread over many tasks), and each batch of sorted rows is a shard:

* its segments are written as balanced parentheses, with a pair `()` for the childless ones and for each bundle of lone continuations,
* findclose searches blocks of excess minima for the end of each subtree,
* rank counts the pairs `()` before a place, and cumulative arrays over pairs and opening parentheses give leaves and savings of a subtree.

Segments that are open where a shard begins (its spine) get a share of their subtree from every shard; Spark adds up these shares.

Turns are ordered by turn (null first), then by role, then by digest. Rows without conv_id belong to no conversation. Null role or text is
empty. Rows that are equal in all columns are turns of their own. No conversation at all: no node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowloom.llm.frames import join_counted, map_batches
from rowloom.session import join_bounded, stage_small, write_stage

CHUNK_TURNS = 4096     # turns of one conversation that one window holds
ID_BLOCK_BITS = 12     # ids are put into one text for each 4096 consecutive numbers
EXCESS_BLOCK = 64      # parentheses of one block of the excess index
WORD = r"[^\x20\x09-\x0D]+"


def narrow_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, words) of every turn that belongs to a conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    written = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return conversations.filter("conv_id IS NOT NULL").select(
        "conv_id", "turn", role.alias("role"), F.substring(F.unhex(F.sha2(written, 256)), 1, 16).alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("words"))


def _count_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add `nth`, the place of each row among the rows of its conversation in this partition; rows come sorted."""
    last, seen = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("conv_id").to_numpy()
        new = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
        nth = np.arange(len(ids)) - np.repeat(new, np.diff(np.append(new, len(ids))))
        head = int(new[1]) if len(new) > 1 else len(ids)
        if last is not None and ids[0] == last:
            nth[:head] += seen
        last, seen = ids[-1], int(nth[-1]) + 1
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("digest"), batch.column("words"), pa.array(nth, pa.int64())],
                                         ["conv_id", "digest", "words", "nth"])


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, digest, words): turns with their place from 0. A conversation of any length is spread over several partitions."""
    order = ["conv_id", "turn", "role", "digest"]
    ordered = write_stage(narrow_turns(conversations), "turns").repartitionByRange(*order).sortWithinPartitions(*order)
    local = ordered.mapInArrow(_count_sorted, "conv_id bigint, digest binary, words bigint, nth bigint")
    local = write_stage(local.withColumn("part", F.spark_partition_id()), "local")
    edges = local.groupBy("part").agg(F.min("conv_id").alias("low"), F.max("conv_id").alias("high"))
    edges = edges.select(F.explode(F.array("low", "high")).alias("conv_id")).distinct()  # at most two for each partition
    counts = local.join(F.broadcast(edges), "conv_id").groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part")) - F.col("n")
    offsets = counts.select("conv_id", "part", before.alias("before")).filter("before > 0")
    placed = local.join(F.broadcast(offsets), ["conv_id", "part"], "left")
    return placed.select("conv_id", (F.col("nth") + F.coalesce("before", F.lit(0))).alias("pos"), "digest", "words")


def spliced(turns: DataFrame, group: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first turns are replaced by those of the first one of their group of ids.

    Conversation c takes the first h turns of c - c % group and its own turns after its first h; h is the unsigned crc32 of its number in
    decimal modulo `most` + 1. Gives (conv_id, pos, length, digest, words) and (conv_id, length).
    """
    turns = write_stage(turns, "numbered")
    heads = turns.filter(F.col("pos") < most).groupBy(F.col("conv_id").alias("donor")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "digest", "words"))).alias("head"))
    taken = (F.crc32(F.col("conv_id").cast("string")) % (most + 1)).cast("int")
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).withColumn("donor", F.col("conv_id") - F.col("conv_id") % group)
    convs = convs.join(heads, "donor", "left").withColumn("taken", taken)
    convs = convs.withColumn("head", F.coalesce(F.slice("head", F.lit(1), F.col("taken")), F.slice("head", 1, 0), F.array().cast(heads.schema["head"].dataType)))
    length = F.size("head") + F.greatest(F.col("n") - F.col("taken"), F.lit(0))
    convs = write_stage(convs.select("conv_id", "n", "taken", "head", length.alias("length")), "spliced")
    own = join_counted(turns, convs.select("conv_id", "n", "taken", F.size("head").alias("given"), "length"), ["conv_id"], "n")
    own = own.filter(F.col("pos") >= F.col("taken")).select("conv_id", (F.col("pos") - F.col("taken") + F.col("given")).alias("pos"), "length", "digest", "words")
    given = convs.select("conv_id", "length", F.explode("head").alias("t")).select("conv_id", "t.pos", "length", "t.digest", "t.words")
    return own.unionByName(given), convs.select("conv_id", "length")


def _node_key(depth: Column, sums: list[Column]) -> list[Column]:
    return [F.xxhash64(F.lit(salt), depth, *sums) for salt in (1, 2)]


def prefix_rows(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, depth, k1, k2, p1, p2, words, before, ends): the nodes on the path of every conversation, the root among them.

    k names the node, p its parent, `before` counts the words above it, `ends` tells whether the conversation ends here.
    A node's name is made of sums over its turns. They are taken in chunks of bounded length, so a long conversation is no window.
    """
    low = F.lit(0xFFFFFFFF)
    rows = rows.withColumn("chunk", F.floor(F.col("pos") / CHUNK_TURNS).cast("bigint"))
    for name, salt in (("x", 11), ("y", 23)):
        hashed = F.xxhash64(F.lit(salt), "digest", "pos")
        rows = rows.withColumns({f"{name}1": F.shiftrightunsigned(hashed, 32), f"{name}2": hashed.bitwiseAND(low)})
    names = ["x1", "x2", "y1", "y2", "words"]
    running = Window.partitionBy("conv_id", "chunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = rows.select("conv_id", "pos", "length", "chunk", *names, *[F.sum(c).over(running).alias(f"s_{c}") for c in names])
    if not convs.filter(F.col("length") > CHUNK_TURNS).isEmpty():
        totals = rows.filter(F.col("length") > CHUNK_TURNS).groupBy("conv_id", "chunk").agg(*[F.sum(c).alias(f"t_{c}") for c in names])
        earlier = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
        offsets = totals.select("conv_id", "chunk", *[F.sum(f"t_{c}").over(earlier).alias(f"o_{c}") for c in names]).filter("chunk > 0")
        offsets, fits = stage_small(offsets, "offsets")
        summed = join_bounded(summed, offsets, ["conv_id", "chunk"], fits, "left")
        summed = summed.withColumns({f"s_{c}": F.col(f"s_{c}") + F.coalesce(f"o_{c}", F.lit(0)) for c in names})
    depth = F.col("pos") + 1
    sums, above = [F.col(f"s_{c}") for c in names[:4]], [F.col(f"s_{c}") - F.col(c) for c in names[:4]]
    (k1, k2), (p1, p2) = _node_key(depth, sums), _node_key(F.col("pos"), above)
    below = summed.select("conv_id", depth.alias("depth"), k1.alias("k1"), k2.alias("k2"), p1.alias("p1"), p2.alias("p2"), "words",
                          (F.col("s_words") - F.col("words")).alias("before"), (depth == F.col("length")).alias("ends"))
    zero, nothing = F.lit(0).cast("bigint"), F.lit(None).cast("bigint")
    r1, r2 = _node_key(zero, [zero] * 4)
    roots = convs.select("conv_id", zero.alias("depth"), r1.alias("k1"), r2.alias("k2"), nothing.alias("p1"), nothing.alias("p2"), zero.alias("words"),
                         zero.alias("before"), (F.col("length") == 0).alias("ends"))
    return below.unionByName(roots)


def node_table(paths: DataFrame) -> DataFrame:
    """One row per node with its members (n), smallest member (m), children, lone children, and smallest member and members of its parent."""
    nodes = write_stage(paths.groupBy("k1", "k2").agg(
        F.min("conv_id").alias("m"), F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in ("depth", "p1", "p2", "words", "before")]), "nodes")
    children = nodes.filter("depth > 0").groupBy("p1", "p2").agg(F.count(F.lit(1)).alias("n_children"), F.sum((F.col("n") == 1).cast("bigint")).alias("lone"))
    named = nodes.join(children.select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), "n_children", "lone"), ["k1", "k2"], "left")
    named = write_stage(named.fillna(0, ["n_children", "lone"]), "named")
    parents = named.filter("n_children > 0").select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("m").alias("parent_m"), F.col("n").alias("parent_n"),
                                                    F.col("n_children").alias("siblings"))
    below = join_counted(named.filter("depth > 0"), parents, ["p1", "p2"], "siblings").drop("siblings", "p1", "p2")
    nothing = F.lit(None).cast("bigint")
    root = named.filter("depth = 0").drop("p1", "p2").withColumns({"parent_m": nothing, "parent_n": nothing})
    return below.unionByName(root)


def segment_table(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """One row per segment (m, n): its path from the root as an array of segments, saving, lone children, childless or not.

    A path has one entry for every place where members drop, not for every turn. It is read off the path of the smallest member.
    """
    shared = nodes.filter("n > 1")
    segments = shared.groupBy("m", "n").agg(
        F.sum("words").alias("words"), F.min("before").alias("top_before"), F.count(F.lit(1)).alias("turns"), F.sum("lone").alias("lone"),
        (F.min("n_children") == 0).alias("childless"))
    tops = shared.filter("parent_n IS NULL OR parent_n <> n").select("k1", "k2", "m", "n")
    met = join_counted(paths.select("conv_id", "depth", "k1", "k2"), write_stage(tops, "tops"), ["k1", "k2"], "n")
    lists = met.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("depth", "m", "n"))).alias("all"), F.bool_or(F.col("m") == F.col("conv_id")).alias("names"))
    each = lists.filter("names").select("conv_id", "all", F.posexplode("all").alias("i", "e")).filter("e.m = conv_id")
    path = F.transform(F.slice("all", F.lit(1), F.col("i") + 1), lambda x: F.struct(x["m"].alias("m"), x["n"].alias("n")))
    return segments.join(each.select("e.m", "e.n", path.alias("path")), ["m", "n"])


class Parentheses:
    """Balanced parentheses (1 opens) with an index of excess minima: pairs of blocks, pairs of these, and so on."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits
        self.excess = np.cumsum(np.where(bits, 1, -1))
        blocks = -(-len(bits) // EXCESS_BLOCK)
        self.padded = np.full(blocks * EXCESS_BLOCK, np.iinfo(np.int64).max)
        self.padded[:len(bits)] = self.excess
        self.levels = [self.padded.reshape(blocks, EXCESS_BLOCK).min(axis=1)]
        while len(self.levels[-1]) > 1:
            low = self.levels[-1]
            low = np.append(low, np.iinfo(np.int64).max) if len(low) % 2 else low
            self.levels[-1] = low
            self.levels.append(np.minimum(low[::2], low[1::2]))
        pairs = np.zeros(len(bits), bool)
        pairs[:-1] = bits[:-1] & ~bits[1:]
        self.pairs = np.flatnonzero(pairs)
        self.pair_rank = np.concatenate(([0], np.cumsum(pairs)))
        self.open_rank = np.concatenate(([0], np.cumsum(bits)))

    def _first_in_block(self, block: np.ndarray, start: np.ndarray, below: np.ndarray) -> np.ndarray:
        """First place from `start` on inside the block whose excess is below the bound, or -1."""
        at = block[:, None] * EXCESS_BLOCK + np.arange(EXCESS_BLOCK)
        hit = (self.padded[at] < below[:, None]) & (at >= start[:, None])
        return np.where(hit.any(axis=1), at[:, 0] + hit.argmax(axis=1), -1)

    def findclose(self, opens: np.ndarray) -> np.ndarray:
        """The place that closes each opening parenthesis: the next one with a lower excess than its own."""
        found = np.empty(len(opens), np.int64)
        for lo in range(0, len(opens), 4096):
            start = opens[lo:lo + 4096]
            below = self.excess[start]
            block = start // EXCESS_BLOCK
            close = self._first_in_block(block, start, below)
            left = np.flatnonzero(close < 0)
            node, height = block[left], np.zeros(len(left), np.int64)
            rising = np.ones(len(left), bool)  # up until a right neighbour holds a lower excess, then down to its first such block
            while rising.any():
                for h in np.unique(height[rising]):
                    here = np.flatnonzero(rising & (height == h))
                    right = node[here] + 1
                    ok = (node[here] % 2 == 0) & (self.levels[h][np.minimum(right, len(self.levels[h]) - 1)] < below[left[here]])
                    node[here[ok]] += 1
                    rising[here[ok]] = False
                    node[here[~ok]] //= 2
                    height[here[~ok]] += 1
            while (height > 0).any():
                for h in np.unique(height[height > 0]):
                    here = np.flatnonzero(height == h)
                    child = node[here] * 2
                    node[here] = np.where(self.levels[h - 1][child] < below[left[here]], child, child + 1)
                    height[here] -= 1
            if len(left):
                close[left] = self._first_in_block(node, start[left], below[left])
            found[lo:lo + 4096] = close
        return found


def subtree_shares(depths: np.ndarray, lone: np.ndarray, childless: np.ndarray, saving: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(leaves, saved) of the spine and then of each segment of a shard; segments come in preorder with their depths from 1."""
    spine = int(depths[0]) - 1
    bundle = lone > 0
    closes = np.concatenate(([0], depths[:-1] - depths[1:] + 1))
    place = spine + np.cumsum(closes) + np.arange(len(depths)) + 2 * (np.cumsum(bundle) - bundle)
    bits = np.zeros(int(place[-1]) + 1 + 2 * int(bundle[-1]) + int(depths[-1]), bool)
    bits[:spine] = True
    bits[place] = True
    bits[place[bundle] + 1] = True
    index = Parentheses(bits)
    weight = np.zeros(len(bits), np.int64)
    weight[place[childless]] = 1
    weight[place[bundle] + 1] = lone[bundle]
    leaves = np.concatenate(([0], np.cumsum(weight[index.pairs])))
    own = np.zeros(len(bits), np.int64)
    own[place] = saving
    saved = np.concatenate(([0], np.cumsum(own[bits])))
    opens = np.concatenate((np.arange(spine), place))
    ends = index.findclose(opens)
    return leaves[index.pair_rank[ends]] - leaves[index.pair_rank[opens]], saved[index.open_rank[ends]] - saved[index.open_rank[opens]]


def subtree_totals(segments: DataFrame) -> DataFrame:
    """(m, n, n_leaves, saved) of every segment: shares of the shards, added up."""

    def step(batch: pa.RecordBatch) -> dict:
        path = batch.column("path")
        depths = np.diff(path.offsets.to_numpy())
        first = path[0].as_py()[:-1]
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("lone", "childless", "saving")]
        leaves, saved = subtree_shares(depths.astype(np.int64), *columns)
        names = {c: np.concatenate(([e[c] for e in first], batch.column(c).to_numpy())).astype(np.int64) for c in ("m", "n")}
        return names | {"n_leaves": leaves, "saved": saved}

    sorted_ = segments.select("path", "m", "n", "lone", "childless", ((F.col("n") - 1) * F.col("words")).alias("saving")) \
        .repartitionByRange("path").sortWithinPartitions("path")
    shares = map_batches(sorted_, step, "m bigint, n bigint, n_leaves bigint, saved bigint")
    return shares.groupBy("m", "n").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))


def _digest_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the joined texts of each (k1, k2); rows come sorted, and one text is held at a time."""
    key, state = None, None
    for batch in batches:
        done = []
        for k1, k2, ids in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "ids")), strict=True):
            if (k1, k2) != key:
                if key is not None:
                    done.append((*key, state.hexdigest()))
                key, state = (k1, k2), hashlib.sha256(ids.encode())
            else:
                state.update(f",{ids}".encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], ["k1", "k2", "ends_sha256"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, state.hexdigest())], ["k1", "k2", "ends_sha256"])


def end_digests(paths: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256) of the nodes where conversations end: SHA-256 of their numbers in order, joined by commas.

    Numbers are first joined to texts of at most 4096 of them, so what is digested in sequence is a few rows even for a hot node.
    """
    block = F.shiftright("conv_id", ID_BLOCK_BITS)
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    texts = paths.filter("ends").groupBy("k1", "k2", block.alias("block")).agg(ids.alias("ids"))
    return texts.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "block").select("k1", "k2", "ids").mapInArrow(
        _digest_sorted, "k1 bigint, k2 bigint, ends_sha256 string")


def prefix_trie(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    `rows` are turns (conv_id, pos, length, digest, words), `convs` all conversations (conv_id, length), those without turns among them.
    Leaves are childless nodes of the subtree; saved_tokens sums (members - 1) * words of the last turn over the subtree, its top included.
    """
    paths = write_stage(prefix_rows(rows, convs), "paths")
    nodes = write_stage(node_table(paths), "trie")
    segments = write_stage(segment_table(nodes, paths), "segments")
    totals = write_stage(segments.select("m", "n", "turns", "top_before").join(subtree_totals(segments), ["m", "n"]), "totals")
    shared = join_counted(nodes.filter("n > 1"), totals, ["m", "n"], "turns")
    shared = shared.withColumn("saved_tokens", F.col("saved") - (F.col("n") - 1) * (F.col("before") - F.col("top_before")))
    shared = shared.join(end_digests(paths), ["k1", "k2"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))
    members = F.when(F.col("n_children") == 0, F.col("m").cast("string")).otherwise("")
    lone = nodes.filter("n = 1").withColumns({"n_leaves": F.lit(1).cast("bigint"), "saved_tokens": F.lit(0).cast("bigint"), "ends_sha256": F.sha2(members, 256)})
    columns = [F.col("m").alias("conv_id"), "depth", F.col("parent_m").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", "n_leaves",
               "saved_tokens", "ends_sha256"]
    return shared.select(*columns).unionByName(lone.select(*columns))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """`prefix_trie` of a table (conv_id, turn, role, text) as it is."""
    turns = write_stage(numbered(conversations), "numbered")
    convs = write_stage(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("length")), "lengths")
    return prefix_trie(join_counted(turns, convs, ["conv_id"], "length"), convs)
