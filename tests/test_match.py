import numpy as np
import pytest
from pyspark.sql import functions as F

from rowloom import session
from rowloom.config import RetrievalConfig
from rowloom.operators import cells, match, workload


def f32(x):
    return np.float32(x)


def holds(row, cond):
    _, _, field, kind, op, num, value = cond
    if kind == "categorical":
        return row["cats"].get(field) is not None and row["cats"][field] == value
    x = row["nums"].get(field)
    if x is None:
        return False
    if op == "==":
        return bool(abs(f32(x) - f32(num)) < np.float32(1e-6))
    return bool(f32(x) > f32(num)) if op == ">" else bool(f32(x) < f32(num))


def brute(rows, conds):
    by_query = {}
    for c in conds:
        if c[3] == "categorical" or c[4] in ("==", ">", "<"):
            by_query.setdefault(c[0], []).append(c)
    return {(q, r["idx"]) for q, cs in by_query.items() for r in rows if all(holds(r, c) for c in cs)}


@pytest.fixture(scope="module")
def corpus(spark):
    """Two tables that share column names; `size` is numeric in one and categorical in the other."""
    rows = []
    for i in range(400):
        nums = {"size": float(i % 7), "price": None if i % 11 == 0 else i * 0.25 - 20, "tiny": (i % 3 - 1) * 1e-7}
        rows.append((i, 0, nums, {"colour": "red" if i % 3 else "blue", "shape": None if i % 5 else "x"}))
    for i in range(400, 520):
        rows.append((i, 1, {"price": float(i)}, {"size": str(i % 4), "colour": "red"}))
    for i in range(520, 560):
        rows.append((i, 2, {}, {"note": f"n{i % 2}"}))
    schema = "idx bigint, dataset_pos int, nums map<string,double>, cats map<string,string>"
    return [dict(zip(("idx", "pos", "nums", "cats"), r)) for r in rows], spark.createDataFrame(rows, schema)


CONDS = [
    ("a", 1, "size", "numeric", "==", 3.0, None), ("b", 1, "size", "categorical", "==", None, "3"),
    ("c", 1, "price", "numeric", ">", 10.0, None), ("c", 2, "colour", "categorical", "==", None, "red"),
    ("d", 1, "price", "numeric", "<", 5.5, None), ("d", 2, "size", "numeric", ">", 2.0, None), ("d", 3, "tiny", "numeric", "==", 0.0, None),
    ("e", 1, "price", "numeric", "!=", 5.5, None), ("e", 2, "shape", "categorical", "==", None, "x"),
    ("f", 1, "price", "numeric", "!=", 5.5, None), ("g", 1, "nothing", "numeric", ">", 0.0, None),
    ("h", 1, "colour", "categorical", ">", None, "blue"), ("i", 1, "price", "numeric", "==", -20.0, None),
    ("j", 1, "price", "numeric", ">", -1000.0, None), ("j", 2, "price", "numeric", "<", 1e9, None),
]


@pytest.mark.parametrize("bound", [1_000_000, 0])
def test_both_forms_match_brute_force(spark, corpus, monkeypatch, bound):
    """With a bound of 0 nothing may be broadcast, so the salted joins run."""
    original = session.stage_small
    limited = lambda df, name="small", max_rows=bound, **k: original(df, name, bound)
    monkeypatch.setattr(session, "stage_small", limited)
    monkeypatch.setattr(match, "stage_small", limited)
    rows, df = corpus
    conds = spark.createDataFrame(CONDS, match.CONDITION_SCHEMA)
    want = brute(rows, CONDS)
    anchor = match.match_anchor(df, conds).collect()
    division = match.match_division(df, conds).collect()
    assert len(anchor) == len(want) and {tuple(r) for r in anchor} == want
    assert len(division) == len(want) and {tuple(r) for r in division} == want
    assert not any(q in ("f", "g") for q, _ in want)


def test_unknown_operators(spark, corpus):
    _, corpus = corpus
    number = corpus.select(F.explode("nums").alias("c", "v")).filter("v IS NOT NULL").first()["c"]
    held = [("a", 1, number, "numeric", ">", -1e9, None), ("b", 1, number, "numeric", ">", -1e9, None),
            ("b", 2, number, "numeric", ">=", 0.0, None), ("c", 1, number, "numeric", ">", -1e9, None),
            ("c", 2, "no_such_field", "numeric", ">=", 0.0, None)]
    conds = spark.createDataFrame(held, match.CONDITION_SCHEMA)
    for form in (match.match_anchor, match.match_division):
        found = {r["query_id"]: r["n"] for r in form(corpus, conds).groupBy("query_id").agg(F.count("*").alias("n")).collect()}
        assert set(found) == {"a", "b"} and found["a"] == found["b"] > 0


def test_counted_conditions_choose_the_anchor(spark, corpus):
    rows, df = corpus
    conds = match.with_row_counts(df, spark.createDataFrame(CONDS, match.CONDITION_SCHEMA))
    rarest = {}
    for r in conds.collect():
        cond = (r["query_id"], r["pos"], r["field"], r["type"], r["operator"], r["num"], r["str"])
        equal = r["type"] == "categorical" or r["operator"] == "=="
        assert r["n_rows"] == (sum(holds(row, cond) for row in rows) if equal else None)
        if equal:
            rarest[r["query_id"]] = min(rarest.get(r["query_id"], (10**9, "")), (r["n_rows"], r["field"]))
    first = {r["query_id"]: r["f0"] for r in match.anchored(conds, 3).collect()}
    assert {q: first[q] for q in "cd"} == {q: rarest[q][1] for q in "cd"}
    assert {tuple(r) for r in match.match_anchor(df, conds).collect()} == brute(rows, CONDS)


def test_cells_and_pools(spark, corpus):
    rows, df = corpus
    made = cells.cells(df).collect()
    assert len(made) == sum(v is not None for r in rows for v in (*r["nums"].values(), *r["cats"].values()))
    assert {(r["kind"]) for r in made if r["column"] == "size"} == {"numeric", "categorical"}
    pools = {r["query_type"]: r["n_rows"] for r in cells.seed_pools(df).collect()}
    assert pools == {"numeric": 520, "categorical": 560, "mixed": 520}
    stats = {r["kind"]: r["n_columns"] for r in cells.index_stats(df).collect()}
    assert stats == {"numeric": 3, "categorical": 4}


def test_ground_truth_blocks(spark):
    qrels = spark.range(1000).select(F.lit("q").alias("query_id"), (F.col("id") * 3).alias("idx"))
    blocks = match.ground_truth_blocks(qrels, 256).orderBy("block").collect()
    assert all(len(b["matching_indices"]) <= 256 for b in blocks)
    assert [i for b in blocks for i in b["matching_indices"]] == [3 * i for i in range(1000)]


def test_quotas():
    rows = workload.quota_rows(RetrievalConfig(num_queries_per_type=10, max_conditions=3))
    assert rows == [("numeric", 1, 4), ("numeric", 2, 3), ("numeric", 3, 3), ("categorical", 1, 4), ("categorical", 2, 3),
                    ("categorical", 3, 3), ("mixed", 2, 5), ("mixed", 3, 5)]
    assert workload.quota_rows(RetrievalConfig(num_queries_per_type=5, max_conditions=1)) == [("numeric", 1, 5), ("categorical", 1, 5)]


def test_query_workload(spark, corpus):
    rows, df = corpus
    config = RetrievalConfig(num_queries_per_type=7, min_matches=5)
    queries, conds = workload.build_queries(df, config)
    made, listed = queries.collect(), conds.collect()
    truth = brute(rows, [(c["query_id"], c["pos"], c["field"], c["type"], c["operator"], c["num"], c["str"]) for c in listed])
    sizes = {}
    for q, _ in truth:
        sizes[q] = sizes.get(q, 0) + 1
    assert {q["query_id"]: q["num_matches"] for q in made} == sizes
    assert all(n >= 5 for n in sizes.values())
    per_type = {}
    for q in made:
        per_type.setdefault(q["query_type"], []).append(q["query_id"])
    for kind, ids in per_type.items():
        assert sorted(ids) == [f"retrieval_{kind}_{i:06d}" for i in range(1, len(ids) + 1)]
    for q in made:
        own = sorted((c for c in listed if c["query_id"] == q["query_id"]), key=lambda c: c["pos"])
        assert len(own) == q["num_conditions"] and len({(c["field"], c["type"]) for c in own}) == len(own)
        kinds = {c["type"] for c in own}
        assert kinds == ({"numeric", "categorical"} if q["query_type"] == "mixed" else {q["query_type"]})
        assert q["query_text"].startswith("find records where ") and q["query_text"].count(" and ") == len(own) - 1
    again = {tuple(r) for r in workload.build_queries(df.repartition(3), config)[0].collect()}
    assert again == {tuple(r) for r in made}


def test_empty_corpus(spark, corpus):
    none = corpus[1].limit(0)
    queries, conds = workload.build_queries(none)
    assert queries.count() == 0 and match.match_anchor(none, conds).count() == 0
