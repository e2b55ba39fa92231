"""Operators of rowloom.llm against brute force, and their results on awkward input."""

import hashlib
import math
import os
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
import zstandard

import __spark_entry__ as entry
import corpus_pipeline
from rowloom.llm import decontaminate, frames, language, licenses, mixing, revisits, search, simhash, substrings, tokens, toxicity
from rowloom.llm import words as W
from rowloom.llm.oracle import SQL
from rowloom import session

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
MODEL = open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()


def frame(spark, texts, ids=None, extra=None):
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en", "a" if n % 3 else None, len(t or "")) for n, (i, t) in enumerate(zip(ids, texts, strict=True))]
    df = spark.createDataFrame(rows, DOCS)
    return df.selectExpr("*", *(extra or []))


def prose(seed, n, vocabulary=400):
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(vocabulary)}" for _ in range(n))


AWKWARD = [None, "", "  \t\n", "x", "é ü 日本", prose(1, 30_000), prose(2, 120), prose(2, 120), "\x00 \x1f", "All Rights\nReserved. CC-BY"]
AWKWARD_IDS = [0, 1, 2, None, 4, 5, 6, 6, 8, 9]


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "pages", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")

    def table(df):
        rows = df[sorted(df.columns)].astype(object).where(df.notna(), None).values.tolist()
        return sorted((tuple(float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r) for r in rows), key=repr)

    assert table(entry.queries()[name](spark, SF).toPandas()) == table(con.execute(SQL[name]).fetchdf())


def every_operator(spark, docs, labels, items):
    model = toxicity.learn_lexicon(docs, labels)
    yield "licenses", licenses.scan_licenses(docs)
    yield "mixing", mixing.mix(mixing.quality_weights(docs, labels))
    yield "mixed", mixing.mixed_documents(docs, labels)
    yield "substrings", substrings.dedup_digests(docs)
    yield "cut", substrings.remove_repeats(docs)
    yield "simhash", simhash.near_duplicates(docs)
    yield "one", simhash.keep_one(docs)
    yield "tokens", tokens.token_counts(docs, MODEL)
    yield "search", search.search_top_k(docs, docs.selectExpr("doc_id AS query_id", "text"), 3)
    yield "contaminated", decontaminate.contaminated(docs, items)
    yield "clean", decontaminate.keep_clean(docs, items)
    yield "toxicity", toxicity.score_toxicity(docs, model)
    yield "civil", toxicity.keep_civil(docs, model)
    yield "language", language.classify_language(docs, language.learn_dictionaries(docs))


def test_awkward_rows(spark):
    clash = ["1 AS score", "'x' AS size", "2 AS _listed_", "'k' AS label", "true AS taken"]
    docs = frame(spark, AWKWARD, AWKWARD_IDS, clash)
    labels = spark.createDataFrame([(5, 1, 1), (6, None, None), (None, 1, 0), (5, 0, 0)], "doc_id bigint, quality int, toxic int")
    items = spark.createDataFrame([(1, prose(2, 40)), (2, None), (3, ""), (1, prose(2, 40)), (None, "x")], "item_id bigint, text string")
    got = {name: df.collect() for name, df in every_operator(spark, docs, labels, items)}
    for name in ("mixing", "substrings", "simhash", "tokens", "toxicity", "language"):
        assert len(got[name]) == len(AWKWARD), name
    assert len(got["licenses"]) == len(AWKWARD) - 1            # the repeated row is one document
    assert {r.doc_id: r.n_tokens for r in got["tokens"]}[1] == 0
    assert {(r.doc_id, r.lang_pred) for r in got["language"]} >= {(0, "und"), (1, "und"), (8, "und")}
    assert [r.doc_id for r in got["one"]].count(6) == 1        # of equal rows with one id, one stays
    assert {(r.doc_id, r.item_id) for r in got["contaminated"]} == {(6, 1), (None, None)}
    assert not {6, None} & {r.doc_id for r in got["clean"]}
    assert sum(r.n_removed for r in got["substrings"]) == 0     # equal ids do not remove from each other
    assert [r.base_labels for r in got["licenses"] if r.doc_id == 9] == ["cc-by,reserved"]


def test_empty_tables(spark):
    docs, labels = frame(spark, []), spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    for name, df in every_operator(spark, docs, labels, spark.createDataFrame([], "item_id bigint, text string")):
        assert df.collect() == [], name
    empty = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert revisits.resolve_revisits(revisits.records_of_pages(empty)).collect() == []


def test_word_hashes_follow_words():
    import pyarrow as pa
    texts = ["a bc  d", None, "", "bc", "d\ta", "é x"]
    raw, offsets = W.column_bytes(pa.array(texts))
    start, end, first = W.word_spans(raw, offsets)
    found = [raw[a:b].tobytes().decode() for a, b in zip(start, end, strict=True)]
    assert found == [w for t in texts for w in WORD.findall(t or "")]
    assert np.diff(first).tolist() == [len(WORD.findall(t or "")) for t in texts]
    hashes = W.word_hashes(raw, start, end)[0]
    assert len(set(hashes.tolist())) == len(set(found))
    assert W.sliding_min(np.arange(20)[::-1], 6).tolist() == [min(range(19 - i - 5, 20 - i)) for i in range(15)]


def test_substrings_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(substrings, "SEND_BYTES", 1000)
    shared, draw = [prose(s, 90) for s in range(4)], random.Random(5)
    texts = [" ".join(x for _ in range(4) for x in (prose(draw.random(), draw.randrange(40)), draw.choice(shared)[draw.randrange(60):])) for _ in range(60)]
    texts += ["a " * 400, "a " * 300, shared[0]]
    first = {}
    words = [WORD.findall(t) for t in texts]
    for i, w in enumerate(words):
        for j in range(len(w) - 49):
            first.setdefault(tuple(w[j:j + 50]), i)
    got = {r.doc_id: r for r in substrings.dedup_digests(frame(spark, texts)).collect()}
    cut = {r.doc_id: r.text for r in substrings.remove_repeats(frame(spark, texts)).collect()}
    for i, w in enumerate(words):
        gone = {p for j in range(len(w) - 49) if first[tuple(w[j:j + 50])] < i for p in range(j, j + 50)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        assert (got[i].n_removed, got[i].kept_sha256) == (len(gone), hashlib.sha256(kept.encode()).hexdigest())
        assert " ".join(WORD.findall(cut.get(i, ""))) == kept


def brute_labels(codes, distance=4):
    label = list(range(len(codes)))
    for i, a in enumerate(codes):
        for j in range(i):
            if bin(a ^ codes[j]).count("1") <= distance and label[i] != label[j]:
                label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    return label


@pytest.mark.parametrize("seed", range(4))
def test_gray_index_against_brute_force(seed):
    draw = random.Random(seed)
    centres = [draw.getrandbits(64) for _ in range(4)]
    codes = {draw.getrandbits(64) for _ in range(100)} | {draw.choice(centres) ^ sum({1 << draw.randrange(64) for _ in range(draw.randrange(7))}) for _ in range(300)}
    codes = np.array(sorted(codes), np.uint64)
    codes = codes[np.argsort(simhash.gray_rank(codes))]
    assert simhash.link_codes(codes).tolist() == brute_labels([int(c) for c in codes])


def test_masks_cover_all_pairs():
    for count in (10, 10**6, 10**9, 10**13):
        chosen = simhash.masks(count)
        draw = random.Random(count)
        for _ in range(200):
            change = sum({1 << draw.randrange(64) for _ in range(4)})
            assert any(change & (m % 2**64) == 0 for m in chosen)


def test_near_duplicates_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK_CODES", 8)
    draw, texts = random.Random(3), []
    for s in range(6):
        base = prose(s, 300).split()
        for _ in range(12):
            copy = list(base)
            for _ in range(draw.randrange(3)):
                copy[draw.randrange(300)] = "edit"
            texts.append(" ".join(copy).upper())
    texts += ["", "  ", "one two", "One TWO"]
    codes = []
    for t in texts:
        w = WORD.findall(t.lower())
        s = [" ".join(w[i:i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] * bool(w)
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        codes.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    got = {r.doc_id: r for r in simhash.near_duplicates(frame(spark, texts)).collect()}
    assert [got[i].code % 2**64 for i in range(len(texts))] == codes
    assert [got[i].component_id for i in range(len(texts))] == brute_labels(codes)
    assert sorted(r.doc_id for r in simhash.keep_one(frame(spark, texts)).collect()) == sorted(set(brute_labels(codes)))


def test_token_counts_and_cache(spark, tmp_path):
    library = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    draw = random.Random(1)
    parts = ["a", " ", "  ", "▁", "\n", "the", "<s>", "é", "\x00", "😀", "ﬁ", "x y"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randrange(30))) for _ in range(300)]
    for half in (texts[:200], texts):                          # the second run finds most counts in the cache
        got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in tokens.token_counts(frame(spark, half), MODEL, str(tmp_path / "cache")).collect()}
        assert got == {i: (len(t.encode()), len(library.encode(t))) for i, t in enumerate(half)}
    cached = spark.read.parquet(str(tmp_path / "cache"))
    assert cached.count() == cached.select("content").distinct().count() == len({t.replace("▁", " ") for t in texts})


def test_mix_reaches_its_targets(spark):
    docs = frame(spark, [prose(i, 20 + i % 50) for i in range(600)])
    docs = docs.selectExpr("doc_id", "text", "CASE WHEN doc_id < 200 THEN 'hot' WHEN doc_id < 210 THEN 'small' WHEN doc_id % 2 = 0 THEN 'é' END AS source")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(0, 600, 3)], "doc_id bigint, quality int, toxic int")
    rows = mixing.mix(mixing.quality_weights(docs, labels)).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, mixing.mix(mixing.quality_weights(docs.repartition(7), labels)).collect()))
    for source in {r.source for r in rows}:
        own = [r for r in rows if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own)
        assert all(r.taken <= 3 * r.size for r in own) and own[0].target <= 3 * own[0].source_size
        assert len({r.taken // r.size for r in own}) <= 2       # whole epochs first, then one more of some
    small = next(r for r in rows if r.source == "small")
    assert small.target == 3 * small.source_size
    assert abs(sum({r.source: r.target for r in rows}.values()) - sum(r.size for r in rows)) < 1e-6


def test_toxicity_folds_and_spares(spark):
    lexicon = ({}, {"vequ": 5.0})
    texts = ["you 1D10T", "you іdiоt", "st​upid", "$tupid", "the trash can is full", "trash", "vequance!", "xvequ", "idiotic notion", "fine"]
    got = [r.predicted for r in toxicity.score_toxicity(frame(spark, texts), lexicon).orderBy("doc_id").collect()]
    assert got == [1, 1, 1, 0, 0, 1, 1, 0, 0, 0]


def test_lexicon_counts_add_up(spark, monkeypatch):
    texts = [prose(n, 80, 60) + " Fünf" * (n % 2) for n in range(40)] + [None, ""]
    labelled = spark.createDataFrame([(t, n % 3 % 2) for n, t in enumerate(texts)], "text string, toxic int")
    want = sorted(map(tuple, toxicity.lexicon_counts(labelled).collect()))
    monkeypatch.setattr(toxicity, "HELD_ENTRIES", 10)
    assert want and sorted(map(tuple, toxicity.lexicon_counts(labelled).collect())) == want


def test_held_out_toxicity_and_language(spark):
    sf = "/root/testdata/sf0.01"
    found = entry.queries()["op8_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in found)
    assert sum(r.predicted == r.toxic for r in found) / len(found) > 0.9
    found = entry.queries()["op9_language_id"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").filter("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in found) / len(found) > 0.95


def test_search_prunes_nothing_that_counts(spark, monkeypatch):
    monkeypatch.setattr(search, "SHARD_BYTES", 3000)
    monkeypatch.setattr(search, "QUERY_BLOCK_TERMS", 100)
    monkeypatch.setattr(search, "BLOCK", 4)
    texts = [prose(i, 5 + i % 60, 60) for i in range(300)] + [prose(7, 12, 60)] * 3
    docs = frame(spark, texts)
    queries = docs.filter("doc_id % 30 = 0").selectExpr("doc_id AS query_id", "text")
    got = search.search_top_k(docs, queries, 5).collect()
    counts = [{w: t.split().count(w) for w in t.split()} for t in texts]
    mean = sum(len(t.split()) for t in texts) / len(texts)
    df = {w: sum(w in c for c in counts) for c in counts for w in c}
    for q in range(0, len(texts), 30):
        scores = []
        for i, c in enumerate(counts):
            s = sum(n * np.log(1 + (len(texts) - df[w] + .5) / (df[w] + .5)) * c[w] * 2.2 / (c[w] + 1.2 * (.25 + .75 * len(texts[i].split()) / mean)) for w, n in counts[q].items() if w in c)
            scores.append((-round(s, 8), i))
        assert [r.doc_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == [i for _, i in sorted(scores)[:5]]


def test_revisits(spark):
    schema = "record_id bigint, url string, captured_at bigint, kind string, status int, etag string, last_modified string, headers map<string,string>"
    stored = {"content-type": "text/html", "date": "1", "x": "old"}
    rows = [(1, "http://www.A.com/p/?b=2&utm_source=f&a=1#z", 10, "response", 200, 'W/"t"', None, stored), (2, "https://a.com:443/p?a=1&b=2", 20, "response", 206, '"t"', None, stored),
            (3, "a.com/p?a=1&b=2", 30, "revisit", 304, '"t"', None, {"date": "3", "content-type": "none"}), (4, "a.com/p?a=1&b=2", 10, "revisit", 304, '"t"', None, {}),
            (5, "a.com/p?a=1&b=2", 40, "revisit", 304, '"u"', None, None), (6, "a.com/p?b=2&a=1", 50, "revisit", 304, None, "d", {}), (7, None, 60, "revisit", 304, '"t"', None, {}),
            (3, "a.com/p?a=1&b=2", 30, "revisit", 304, '"t"', None, {"date": "3", "content-type": "none"}), (8, "a.com/p?b=2&a=1", None, "revisit", 304, None, "d", {})]
    got = revisits.resolve_revisits(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.record_id, r.response_id, r.outcome) for r in got if r.response_id) == [(3, 1, "resolved")] * 2 + [(5, 1, "validators_differ"), (6, 1, "no_validator")]
    assert sorted(r.record_id for r in got if r.outcome == "no_response") == [4, 7, 8]
    assert next(r for r in got if r.record_id == 3).headers == {"content-type": "text/html", "date": "3", "x": "old"}


def plain_toxic(rows, labels):
    """Ids that reach the threshold; counts and matches are made word by word."""
    def starts(text):
        folded = toxicity.fold(text or "")
        return folded, [m.start() for m in re.finditer(r"[^\W_]+", folded)]

    known = {}
    for i, toxic in labels:
        if i is not None and toxic is not None and zlib.crc32(str(i).encode()) % 3 != 1:
            known[i] = max(known.get(i, 0), toxic)
    learned = [(known[i], set(re.findall(r"[^\W_]+", toxicity.fold(t or "")))) for i, t in rows if i in known]
    total = [sum(1 for k in known.values() if k == side) for side in (0, 1)]
    count = {}
    for toxic, words in learned:
        for feature in {(w, True) for w in words} | {(w[:n], False) for w in words for n in toxicity.STEMS if len(w) > n}:
            count.setdefault(feature, [0, 0])[toxic] += 1
    weigh = lambda c: math.log((c[1] + 0.5) / (total[1] + 1)) - math.log((c[0] + 0.5) / (total[0] + 1))
    entries = {f: weigh(c) for f, c in count.items() if c[1] >= toxicity.MIN_SUPPORT and weigh(c) >= toxicity.MIN_WEIGHT}
    for word, weight in toxicity.LEXICON.items():
        for ending in toxicity.ENDINGS:
            entries[word + ending, True] = max(weight, entries.get((word + ending, True), 0))
    exceptions = [toxicity.fold(p + e) for p in toxicity.EXCEPTIONS for e in ("", "s")]
    found = set()
    for i, text in rows:
        folded, at = starts(text)
        ends = lambda e: e == len(folded) or not folded[e].isalnum()
        begins = [s for s in range(len(folded)) if folded[s].isalnum() and not (s and folded[s - 1].isalnum())]
        spared = [(s, s + len(p)) for s in begins for p in exceptions if folded.startswith(p, s) and ends(s + len(p))]
        weights = []
        for s in begins:
            word = re.match(r"\w*", folded[s:])[0]
            own = [entries.get((word[:n], False), 0) for n in toxicity.STEMS if len(word) >= n]
            own += [entries.get((word[:n], True), 0) for n in range(1, len(word) + 1) if ends(s + n)]
            if any(own) and not any(a <= s < b for a, b in spared):
                weights.append(max(own))
        if weights:
            costs = toxicity.TEXT_COST + toxicity.WORD_COST * len(at)
            if 1 / (1 + math.exp((costs - sum(weights)) / toxicity.SLOPE)) >= toxicity.THRESHOLD:
                found.add(i)
    return found


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i:i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def plain_groups(rows):
    """Smallest id of the near-duplicate group of each row."""
    codes = [plain_fingerprint(t) for _, t in rows]
    label = brute_labels(codes)
    least = {}
    for (i, _), own in zip(rows, label, strict=True):
        least[own] = min(least.get(own, i), i)
    return set(least.values())


def test_pipeline_stages(spark):
    """Every stage against plain Python or SQL over its own input; run() gives the rows of the last stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = [tuple(r) for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic").collect()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "mixing":
            assert out.columns == docs.columns
        before = docs.toPandas()
        rows = [(int(i), t) for i, t in before[["doc_id", "text"]].itertuples(index=False)]
        after = out.toPandas()
        found = dict(zip(after["doc_id"], after["text"], strict=True))
        con = duckdb.connect()
        con.execute("create view documents as select * from before")
        for t in ("benchmark", "labels"):
            con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
        if name == "toxicity":
            gone = plain_toxic(rows, labels)
            assert gone and set(found) == {i for i, _ in rows} - gone
        elif name == "near_duplicates":
            assert set(found) == plain_groups(rows) and len(found) < len(rows)
        elif name == "repeated_passages":
            want = {i: h for i, h, n, gone in con.execute(f"select doc_id, kept_sha256, n_words, n_removed from ({SQL['op3_substring_dedup']})").fetchall() if n == 0 or gone < n}
            assert {i: hashlib.sha256(" ".join(WORD.findall(t or "")).encode()).hexdigest() for i, t in found.items()} == want
        elif name == "decontamination":
            gone = {r[0] for r in con.execute(f"select doc_id from ({SQL['op7_decontamination']})").fetchall()}
            assert gone and set(found) == {i for i, _ in rows} - gone
        else:
            want = con.execute(f"select doc_id, taken from ({SQL['op2_mix_sources']}) where taken > 0").fetchall()
            assert sorted(zip(after["doc_id"], after["taken"], strict=True)) == sorted(want)
            assert (after["copies"] * after["size"] == after["taken"]).all()
        docs = out
    held = set(os.listdir(session.shared_folder(spark)))
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, out.collect()))
    assert [n.partition("-")[0] for n in set(os.listdir(session.shared_folder(spark))) - held] == ["mixing"]  # intermediate tables are gone


INTERNAL = ["_id", "_key", "_runs", "_row", "_values", "_same", "_mix", "_listed", "mixed", "windows", "row", "place", "code", "text_key", "stays", "first", "label", "taken", "weight"]


def test_stages_keep_columns_of_any_name(spark):
    """Documents may have columns that are named like the operators' own; ids may be absent or repeated."""
    texts = [*AWKWARD, "you idiot moron scum", "w1 w2 w3 w4 w5", prose(2, 120) + " end"]
    docs = frame(spark, texts, [*AWKWARD_IDS, 10, None, 12], [f"concat('{c}', doc_id) AS `{c}`" for c in INTERNAL])
    for make in (lambda: toxicity.keep_civil(docs, ({}, {})), lambda: simhash.keep_one(docs), lambda: substrings.remove_repeats(docs),
                 lambda: decontaminate.keep_clean(docs, spark.read.parquet(f"{SF}/benchmark.parquet"))):
        out = make()
        assert out.columns == docs.columns
        rows = [r.asDict() for r in out.collect()]
        assert rows and all(r[c] == (None if r["doc_id"] is None else f"{c}{r['doc_id']}") for r in rows for c in INTERNAL)
    labels = spark.createDataFrame([(4, 1, 0)], "doc_id bigint, quality int, toxic int")
    mixed = [r.asDict() for r in mixing.mixed_documents(docs, labels).collect()]
    assert mixed and all(r[c] == (None if r["doc_id"] is None else f"{c}{r['doc_id']}") for r in mixed for c in INTERNAL)


def test_one_row_of_each_group_stays(spark, monkeypatch):
    """Rows are told apart by id and text: absent, repeated and odd ids lose no group and leave no copy."""
    texts = ["a b c d e"] * 5 + [None, "", "z y x w v", "z y x w v", "other words of a text", "other words of a text"]
    ids = [5, 3, 3, None, 9, None, 7, None, None, 3, 3]
    for bound in (1_000_000, 0):
        monkeypatch.setattr(frames, "stage_small", lambda df, name="small", n=bound: session.stage_small(df, name, n))
        kept = sorted(((r.doc_id, r.text) for r in simhash.keep_one(frame(spark, texts, ids)).collect()), key=repr)
        assert kept == sorted([(3, "a b c d e"), (7, ""), (None, "z y x w v"), (3, "other words of a text")], key=repr)


def test_ids_of_other_types(spark, monkeypatch):
    """Items and documents may have INT or text ids; several blocks of items find what one finds."""
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) < 4000")
    want = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()}
    monkeypatch.setattr(decontaminate, "ITEM_BLOCK", -(-items.count() // 5))
    for kind in ("int", "string"):
        found = decontaminate.contaminated(docs.withColumn("doc_id", docs.doc_id.cast(kind)), items.withColumn("item_id", items.item_id.cast(kind)))
        assert dict(found.dtypes)["item_id"] == kind and {(int(r.doc_id), int(r.item_id)) for r in found.collect()} == want
    assert want
    queries = docs.filter("doc_id % 20 = 0").selectExpr("doc_id AS query_id", "text")
    plain = {(r.query_id, r["rank"], r.doc_id) for r in search.search_top_k(docs, queries, 3).collect()}
    named = search.search_top_k(docs.selectExpr("concat('d', lpad(doc_id, 9, '0')) AS doc_id", "text"), queries.selectExpr("concat('q', query_id) AS query_id", "text"), 3)
    assert {(int(r.query_id[1:]), r["rank"], int(r.doc_id[1:])) for r in named.collect()} == plain and plain


def test_long_items_have_passages_of_their_own(spark, monkeypatch):
    """An item of 3,000 words is found whole, and so are short ones in the same documents, in one pass or several."""
    long, short = prose(51, 3_000, 4_000), prose(52, 20, 4_000)
    items = spark.createDataFrame([(1, long), (2, short), (3, prose(53, 70, 4_000))], "item_id bigint, text string")
    docs = frame(spark, [prose(54, 500) + " " + long + " " + prose(55, 40), prose(56, 300) + " " + short, long[:6_000] + " " + short, prose(57, 200)])
    for size in (64 * 2**20, 1):
        monkeypatch.setattr(decontaminate, "PASS_BYTES", size)
        assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()} == {(0, 1), (1, 2), (2, 2)}
        assert {r.doc_id for r in decontaminate.keep_clean(docs, items).collect()} == {3}
    sizes = {i.passage for i in decontaminate.item_indexes(items)}
    assert sizes == {128, 256, 8192} and all(decontaminate.passage_words(n) >= 2 * n for n in range(1, 5_000))


def test_canonical_urls_keep_pages_apart(spark):
    urls = ["a.com/p?a=2&a=1", "a.com/p?a=1&a=2", "a.com/p?ref=x", "a.com/p", "a.com/%7Eu", "a.com/~u", "a.com/p?b=1&a=2", "a.com/p?a=2&b=1", "a.com/p?utm_x=1"]
    keys = [r.k for r in spark.createDataFrame(list(enumerate(urls)), "i int, url string").select("i", revisits.canonical_url("url").alias("k")).orderBy("i").collect()]
    assert len(set(keys)) == 6 and keys[4] == keys[5] and keys[6] == keys[7] and keys[3] == keys[8] and keys[0] != keys[1] and keys[2] != keys[3]


def test_one_url_within_one_second(spark, monkeypatch):
    """Nine tenths of the records are of one URL and one second; others lack a URL, a time or both, or have odd values."""
    monkeypatch.setattr(frames, "HOT_ROWS", 20)
    schema = "record_id string, url string, captured_at bigint, kind string, status int, etag string, last_modified string, headers map<string,string>, slice int, here string"
    rows = [(f"r{i}", "u.com/a", 100, "response" if i % 3 == 0 else "revisit", 200, '"t"', None, {"x": str(i)}, 1, "e") for i in range(300)]
    rows += [(f"s{i}", "u.com/a", t, "response", 200, '"t"', None, {"x": "o" * 10_000}, 1, "e") for i, t in enumerate((50, 50, 60))]
    rows += [(f"v{i}", "u.com/a", 101 + i, "revisit", 304, '"t"', "d", None, None, None) for i in range(5)]
    rows += [(f"n{i}", None if i % 2 else "u.com/a", None if i % 3 else 70, "revisit", 304, '"t"', None, {}, 1, "e") for i in range(12)] + [("n0", None, None, "response", 200, None, None, {}, 1, "e")]
    stored = [(t, r) for r, u, t, k, *_ in rows if k == "response" and u and t is not None]
    want = []
    for r, u, t, kind, *_ in rows:
        if kind == "revisit":
            best = max(((a, b) for a, b in stored if u and t is not None and a < t), default=None)
            want.append((r, best and best[1], "resolved" if best else "no_response"))
    got = revisits.resolve_revisits(spark.createDataFrame(rows, schema))
    assert sorted(((r.record_id, r.response_id, r.outcome) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_languages_against_plain_compression(spark):
    """The choice is the smallest sum of compressed pieces; dictionaries hold stretches of training texts only."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    made = language.learn_dictionaries(docs)
    rows = docs.select("doc_id", "text", "lang").collect()
    for lang, content in made.items():
        own = {language.plain(r.text) for r in rows if r.lang == lang and r.text and zlib.crc32(str(r.doc_id).encode()) % 5}
        words = {w for t in own for w in t.split()}
        assert sum(w in words for w in content.split()) > 0.95 * len(content.split())
    compressors = {lang: zstandard.ZstdCompressor(level=language.LEVEL, write_content_size=False, write_dict_id=False,
                                                  dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for lang, content in made.items()}
    for r in language.classify_language(docs.limit(60), made).collect():
        text = next(x.text for x in rows if x.doc_id == r.doc_id)
        if not text or not re.search(r"[^\W\d_]", text):
            assert r.lang_pred == "und"
            continue
        data = language.plain(text)
        size = {lang: sum(len(c.compress(data[i:i + language.PIECE])) for i in range(0, len(data), language.PIECE)) for lang, c in compressors.items()}
        assert size[r.lang_pred] <= min(size.values()) * 1.002


def test_absent_ids_are_no_id(spark):
    """A row without an id and a row whose text id looks like a mark for that are counted both."""
    docs = spark.createDataFrame([("-", "same"), (None, "same"), ("a", "other")], "doc_id string, text string")
    assert len(tokens.token_counts(docs, MODEL).collect()) == 3


@pytest.mark.parametrize("text, labels", [
    ("Released under the BSD license.", "bsd"), ("under the terms of the GNU General Public License", "gpl"), ("Licensed under CC BY 4.0.", "cc-by"),
    ("subject to the terms of the GNU General Public License", "gpl"), ("Licensed under the license, version 2.0", ""),
    ("Released under the MIT license.", "mit"), ("under the terms of the GNU Lesser General Public License", "gpl,lgpl"),
    ("subject to the terms of the Mozilla Public License, v. 2.0", "mpl"), ("Licensed under the Apache License, Version 2.0", "apache")])
def test_licenses_are_told_apart(spark, text, labels):
    assert licenses.scan_licenses(frame(spark, [text])).first().labels == labels


def test_toxicity_is_graded(spark):
    docs = frame(spark, ["idiots and morons are losers", "stupid " + "word " * 20_000, "one stupid remark " + prose(5, 150), "a trash can, two trash cans"])
    scores = [r.score for r in sorted(toxicity.score_toxicity(docs, ({}, {})).collect(), key=lambda r: r.doc_id)]
    assert scores[0] > 0.9 and scores[1] < 0.01 and scores[1] < scores[2] < 0.7 and scores[3] == 0


def test_languages_that_open_with_digits_are_learned(spark):
    french, german = "le chat dort sur la table et la souris danse", "der hund schläft unter dem tisch und die katze spielt"
    rows = [(i, "1234567890 " * 200 + " ".join([french] * 20), "fr") for i in range(40)] + [(100 + i, " ".join([german] * 20), "de") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert {r.doc_id // 100: r.lang_pred for r in language.classify_language(docs, language.learn_dictionaries(docs)).collect()} == {0: "fr", 1: "de"}


def test_hot_keys_join_like_others(spark, monkeypatch):
    big = spark.createDataFrame([(k, n) for k, size in ((1, 50), (2, 3), (3, 20), (4, 1), (None, 9)) for n in range(size)], "k int, n int")
    small = spark.createDataFrame([(1, 50, "a"), (2, 3, "b"), (3, 20, "c"), (5, 0, "e")], "k int, rows bigint, name string")
    want = sorted(map(tuple, big.join(small, "k").collect()))
    for hot in (1, 10, 30, 1_000):
        monkeypatch.setattr(frames, "HOT_ROWS", hot)
        monkeypatch.setattr(frames, "HOT_KEYS", 1_000)
        assert sorted(map(tuple, frames.join_counted(big, small, ["k"], "rows").collect())) == want
    assert frames.join_counted(big, small.limit(0), ["k"], "rows").count() == 0


def test_results_do_not_depend_on_what_is_hot(spark, monkeypatch):
    shared = prose(11, 90)
    texts = [prose(n, 60) + " " + shared + " " + prose(n + 100, 20) if n % 2 else shared for n in range(24)] + ["", None, ""]
    docs = frame(spark, texts)

    def results():
        return [sorted(map(tuple, df.collect())) for df in (substrings.dedup_digests(docs), simhash.near_duplicates(docs), tokens.token_counts(docs, MODEL))]

    want = results()
    monkeypatch.setattr(frames, "HOT_ROWS", 2)
    assert results() == want


def test_queries_are_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14))
