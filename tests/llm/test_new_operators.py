"""Alignment, conversation trie and MinHash near-duplicates against brute force, and on awkward input."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rowloom.llm import alignment, conversations, frames, minhash
from rowloom.llm.queries import MOST_TURNS, TURN_GROUP

SF = "/root/testdata/sf0.001"
SPEC = open(public_tokenizers.path("byte_bpe_50k.json"), "rb").read()
MODEL = open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()
CLASH = ["doc_id * 0 AS node", "'x' AS key", "'y' AS row", "1 AS n", "2 AS label", "3 AS u", "'z' AS hashes", "4 AS code", "5 AS text_key", "6 AS a_ids"]


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def documents(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id bigint, text string")


AWKWARD = [None, "", "  \t\n", "x", "a▁b", "<|endoftext|> <s> </s> <0x41> é 🙂  \n\t x  ", " two  spaces ", "ﬁ​字字 \x00 x", "A b", "a  B", "a b", "a b",
           " ".join(f"w{n % 977}" for n in range(40_000)), "q" * 5_000]
AWKWARD_IDS = [0, 1, 2, None, 4, 5, 5, 7, 8, 9, None, 11, 12, 13]


def brute_alignment(rows):
    first = Tokenizer.from_str(SPEC.decode())
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    letters = alignment._byte_letters()
    plain = {i: bytes(letters[c] for c in w) if all(c in letters for c in w) else w.encode() for w, i in first.get_vocab().items()}

    def piece(i):
        p = second.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()

    made, counts = [], {}
    for doc_id, text in rows:
        sides = [[], []]
        if text:
            sides = [[(i, plain[i]) for i in first.encode(" " + text, add_special_tokens=False).ids], [(i, piece(i)) for i in second.encode(text)]]
            if any(b"".join(b for _, b in side) != (" " + text).encode() for side in sides):
                sides = [[], []]
        spans = []
        for side in sides:
            at, own = 0, []
            for i, b in side:
                own.append((at, at + len(b), i))
                at += len(b)
            spans.append(own)
        links, low = [], 0
        for a in spans[0]:
            while low < len(spans[1]) and spans[1][low][1] <= a[0]:
                low += 1
            for b in spans[1][low:]:
                if b[0] >= a[1]:
                    break
                links.append((a[2], b[2]))
        for pair in set(links):
            counts[pair] = counts.get(pair, 0) + 1
        ends, groups = sorted({x[1] for x in spans[0]} & {x[1] for x in spans[1]}), []
        places = [0, 0]
        for end in ends:
            ids = []
            for k in (0, 1):
                begin = places[k]
                while places[k] < len(spans[k]) and spans[k][places[k]][1] <= end:
                    places[k] += 1
                ids.append(",".join(str(x[2]) for x in spans[k][begin:places[k]]))
            groups.append("|".join(ids))
        made.append((doc_id, *map(len, sides), len(ends), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if ends else ""))
    best = {}
    for (a, _), n in counts.items():
        best[a] = max(best.get(a, 0), n)
    return sorted(((d, a, b, g, len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), digest)
                   for d, a, b, g, links, digest in made), key=repr)


@pytest.mark.parametrize("head", [2_000_000, 3_000, 0])
def test_alignment_against_brute_force(spark, monkeypatch, head):
    """With a small head the rare pairs, or all, are joined by key."""
    monkeypatch.setattr(alignment, "HEAD_PAIRS", head)
    monkeypatch.setattr(alignment, "TASK_PAIRS", 5_000)
    monkeypatch.setattr(alignment, "PIECE_TOKENS", 2_000)
    monkeypatch.setattr(frames, "HOT_ROWS", 20)
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) < 1500").select("doc_id", "text").union(documents(spark, AWKWARD, AWKWARD_IDS))
    got = rows_of(alignment.align(docs.selectExpr("*", *CLASH), SPEC, MODEL))
    assert got == brute_alignment([tuple(r) for r in docs.collect()])


def test_alignment_gives_groups(spark):
    docs = documents(spark, ["Hello wonderful world", None])
    encoded = alignment.encode(docs, SPEC, MODEL)
    row = next(r for r in alignment.alignments(encoded, SPEC, MODEL).collect() if r.doc_id == 0)
    assert len(row.a_last) == len(row.b_last) and row.a_last[-1] == len(row.a_ids) - 1 and row.b_last[-1] == len(row.b_ids) - 1
    pair = alignment.Pair(SPEC, MODEL)
    covered = [[b"".join(side.bytes[i] for i in ids[:last + 1]) for last in lasts] for side, ids, lasts in zip(pair.sides, (row.a_ids, row.b_ids), (row.a_last, row.b_last), strict=True)]
    assert covered[0] == covered[1] and covered[0][-1] == b" Hello wonderful world"


def test_long_texts_are_cut_where_no_token_crosses(monkeypatch):
    pair = alignment.Pair(SPEC, MODEL)
    texts = ["one two  three\n four, five six 7 8  ", " lead", "no", "é ü 日本 字 " * 9, "tail  "]
    whole = [side.encode_all(texts) for side in pair.sides]
    assert pair.sides[0].fast is not None
    file = Tokenizer.from_str(SPEC.decode())
    assert [list(x) for x in whole[0]] == [file.encode(" " + t, add_special_tokens=False).ids for t in texts]
    model = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    assert [list(x) for x in whole[1]] == [model.encode(t) for t in texts]
    monkeypatch.setattr(alignment, "LONG_TEXT", 4)
    for side, want in zip(pair.sides, whole, strict=True):
        assert [list(x) for x in side.encode_all(texts)] == [list(x) for x in want]


def brute_trie(rows, splice):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest()[:16], text or ""))
    own = {c: [(t[2], t[4]) for t in sorted(turns)] for c, turns in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % (MOST_TURNS + 1) if splice else 0
        built[c] = tuple(own.get(c - c % TURN_GROUP, [])[:h] + own[c][h:])
    nodes, below, totals = {}, {}, {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    for k in nodes:
        if k:
            below.setdefault(k[:-1], []).append(k)
    for k in sorted(nodes, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        parts = [totals[x] for x in below.get(k, [])]
        totals[k] = (sum(p[0] for p in parts) or 1, (len(nodes[k]) - 1) * words + sum(p[1] for p in parts))
    return sorted(((min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), len(below.get(k, [])), *totals[k],
                    hashlib.sha256(",".join(map(str, sorted(c for c in m if len(built[c]) == len(k)))).encode()).hexdigest()) for k, m in nodes.items()), key=repr)


def dialogues():
    draw = np.random.default_rng(3)
    roles, texts = ["a", None, "b"], ["x y", "z", None, "x  y ", "é ü"]
    rows = [(c, t, roles[draw.integers(3)], texts[draw.integers(5)]) for c in range(5_000, 5_200) for t in range(draw.integers(1, 9))]
    for c, n in ((9_000, 300), (9_001, 280), (9_002, 150), (40, 90), (41, 1), (-7, 2)):  # long openings in common
        rows += [(c, t, "a", "w w") for t in range(n)]
    rows += [(60 + c, t, "a", f"s{t}") for c in range(64) for t in range(c % 9 + 1)]  # one conversation is the opening of another
    return rows + [(9_100, None, "a", "w")] * 3 + [(None, 1, "a", "b"), (9_003, 3, "a", "q"), (9_003, 3, "a", "q"), (9_003, 3, None, "q"), (9_003, None, "b", "")]


@pytest.mark.parametrize("batch", [10_000, 7])
def test_trie_against_brute_force(spark, monkeypatch, batch):
    """Small batches make many shards, whose spines are merged; small chunks split long conversations."""
    monkeypatch.setattr(conversations, "CHUNK_TURNS", 4096 if batch > 7 else 32)
    monkeypatch.setattr(conversations, "ID_BLOCK_BITS", 12 if batch > 7 else 3)
    monkeypatch.setattr(frames, "HOT_ROWS", 1_000 if batch > 7 else 5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        rows = dialogues()
        table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "1 AS pos", "2 AS digest", "3 AS k1", "4 AS n", "5 AS words")
        assert rows_of(conversations.conversation_trie(table)) == brute_trie(rows, False)
        assert rows_of(conversations.prefix_trie(*conversations.spliced(conversations.numbered(table), TURN_GROUP, MOST_TURNS))) == brute_trie(rows, True)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)


def test_no_conversations(spark):
    none = spark.createDataFrame([(None, 1, "a", "b")], "conv_id bigint, turn bigint, role string, text string")
    assert conversations.conversation_trie(none).count() == 0
    assert conversations.prefix_trie(*conversations.spliced(conversations.numbered(none.limit(0)), TURN_GROUP, MOST_TURNS)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_findclose_against_a_stack(seed):
    draw, bits, depth = np.random.default_rng(seed), [], 0
    lean = (0.5, 0.8, 0.3, 0.6)[seed]
    while len(bits) < 3_000:
        up = depth == 0 or draw.random() < lean
        bits.append(up)
        depth += 1 if up else -1
    bits += [False] * depth
    stack, want = [], {}
    for i, up in enumerate(bits):
        if up:
            stack.append(i)
        else:
            want[stack.pop()] = i
    opens = np.flatnonzero(bits)
    assert conversations.Parentheses(np.array(bits)).findclose(opens).tolist() == [want[i] for i in opens.tolist()]


def shingles(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if len(words) < 5:
        return frozenset([b" ".join(words)] if words else [])
    return frozenset(b" ".join(words[i:i + 5]) for i in range(len(words) - 4))


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 20 * min(len(a), len(b)) >= 17 * max(len(a), len(b)):
                common = len(a & b)
                if 100 * common >= 85 * (len(a) + len(b) - common):
                    parent[top(i)] = top(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[top(i)] = min(least.get(top(i), doc_id), doc_id)
    return sorted(((d, len(s), least.get(top(i)), d == least.get(top(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def edited_copies():
    """Families: edits of one original (alike to it, not all to one another), chains of edits, and neighbours just below the threshold."""
    draw = np.random.default_rng(5)

    def edit(words, n):
        words = list(words)
        for at in draw.choice(len(words), n, replace=False):
            words[at] = f"e{draw.integers(10**9)}"
        return words

    texts = []
    for family in range(4):
        base = [f"f{family}w{n}" for n in range(200)]
        texts += [base, *[edit(base, 2) for _ in range(30)], *[edit(base, 4) for _ in range(20)]]
        last = base
        for _ in range(12):
            last = edit(last, 2)
            texts.append(last)
    return [" ".join(t) for t in texts]


@pytest.mark.parametrize("block", [512, 3])
def test_minhash_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK_NODES", block)
    monkeypatch.setattr(frames, "HOT_ROWS", 1_000 if block > 3 else 3)
    if block == 3:
        monkeypatch.setattr(minhash, "HOT_SET_ITEMS", 0)
    sample = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = sample.union(documents(spark, edited_copies(), range(20_000, 20_252))).union(documents(spark, AWKWARD, [None if i is None else 30_000 + i for i in AWKWARD_IDS]))
    got = rows_of(minhash.near_duplicates(docs.selectExpr("*", *CLASH)).drop("text_key"))
    assert got == brute_components([tuple(r) for r in docs.collect()])


def test_minhash_without_rows(spark):
    assert minhash.near_duplicates(documents(spark, ["a"]).limit(0)).count() == 0
    assert rows_of(minhash.near_duplicates(documents(spark, [None, ""])).drop("text_key")) == [(0, 0, 0, True), (1, 0, 1, True)]


@pytest.mark.parametrize("n", [1, 3, 20, 100, 1000])
def test_signatures_estimate_similarity(n):
    """Agreement is unbiased, and varies less than that of independent hashes."""
    draw, errors = np.random.default_rng(n), []
    for _ in range(100):
        items = draw.integers(0, 2**63, size=2 * n, dtype=np.uint64)
        a, b = np.sort(items[:int(1.5 * n) or 1]), np.sort(items[n // 2:])
        signature = minhash.signatures(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)]))
        similarity = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        errors.append(np.mean(signature[0] == signature[1]) - similarity)
    independent = np.sqrt(similarity * (1 - similarity) / minhash.COMPONENTS)
    assert abs(np.mean(errors)) < 0.4 * independent and np.std(errors) < 1.1 * independent


def test_hot_originals_need_few_comparisons(spark):
    """Edits of one original meet it first: the pairs compared grow with the texts, not with their square."""
    draw = np.random.default_rng(9)
    base = [f"w{n}" for n in range(300)]
    texts = []
    for _ in range(400):
        words = list(base)
        for at in draw.choice(300, 4, replace=False):
            words[at] = f"e{draw.integers(10**9)}"
        texts.append(" ".join(words))
    docs = documents(spark, [" ".join(base), *texts])
    rows = minhash.signed_rows(docs).withColumn("node", F.col("doc_id"))
    placed = rows.select("node", "n", F.explode("bands").alias("key"))
    placed = placed.join(placed.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1"), "key")
    assert minhash.centre_pairs(placed).count() < 6 * len(texts)
    assert {r.component_id for r in minhash.near_duplicates(docs).collect()} == {0}
