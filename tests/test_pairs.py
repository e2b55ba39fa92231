"""Pairs of query and row in packed form, and search where the corpus lies."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowloom.operators import match, metrics, search
from rowloom.plans import evaluate
from rowloom.sources import store

PAIRS = [(f"q{i % 5}" if i % 11 else None, i * 7919 % 3000 if i % 13 else None) for i in range(2000)] + [("q1", 70_000), ("q1", 70_000), ("q2", 2**40), ("q3", -5)]


def pairs_table(spark):
    return spark.createDataFrame(PAIRS * 2, "query_id string, idx bigint").repartition(7)


@pytest.mark.parametrize("packed", [100, match.PACKED_PAIRS])
def test_ground_truth_is_packed_before_it_moves(spark, monkeypatch, packed):
    monkeypatch.setattr(match, "PACKED_PAIRS", packed)
    made = match.ground_truth_blocks(pairs_table(spark), 256)
    want = {}
    for q, i in PAIRS * 2:
        want.setdefault((q, None if i is None else i // 256), []).append(i)
    want = {k: sorted(v) if k[1] is not None else [] for k, v in want.items()}
    assert {(r["query_id"], r["block"]): r["matching_indices"] for r in made.collect()} == want
    assert "collect_list(idx" not in made._jdf.queryExecution().executedPlan().toString()


def test_distinct_pairs_and_counts(spark):
    table = pairs_table(spark)
    assert sorted(map(repr, map(tuple, match.distinct_pairs(table).collect()))) == sorted(map(repr, set(PAIRS)))
    counts = Counter(q for q, _ in set(PAIRS))
    judged = metrics.judged_counts(table)
    assert {r["query_id"]: r["num_matches"] for r in judged.collect()} == counts
    assert "MapInArrow" in judged._jdf.queryExecution().executedPlan().toString()


def test_first_pairs(spark):
    made = match.first_pairs(pairs_table(spark), 3)
    want = {}
    for q, i in sorted(PAIRS * 2, key=lambda p: (p[1] is not None, p[1] or 0)):
        want.setdefault(q, []).append(i)
    got = {}
    for r in made.orderBy("place").collect():
        got.setdefault(r["query_id"], []).append(r["idx"])
    assert got == {q: v[:3] for q, v in want.items()}
    assert match.first_pairs(pairs_table(spark).limit(0), 3).count() == 0


def test_few_queries_go_to_the_corpus(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vectors = [(i, rng.integers(-2, 3, 6).astype(float).tolist()) for i in range(700)]
    corpus = spark.createDataFrame(vectors, "idx bigint, embedding array<float>").repartition(5)
    queries = spark.createDataFrame(vectors[:9], "query_id bigint, embedding array<float>")
    found = search.topk_flat(queries, corpus, 20)
    assert "FlatMapCoGroups" not in found._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(search, "SCAN_BYTES", 2000)
    small = search.topk_flat(queries, corpus, 20)
    rows = {tuple(r) for r in found.collect()}
    assert rows == {tuple(r) for r in small.collect()}
    monkeypatch.setattr(search, "SCAN_HITS", 0)
    assert rows == {tuple(r) for r in search.topk_flat(queries, corpus, 20).collect()} and len(rows) == 180


def test_corpus_vectors_of_a_flat_search_are_not_written(spark, monkeypatch):
    staged, write = [], evaluate.write_stage
    monkeypatch.setattr(evaluate, "write_stage", lambda df, name, *a, **b: (staged.append(name), write(df, name, *a, **b))[1])
    corpus = spark.createDataFrame([(i, f"the number is {i}") for i in range(50)], "idx bigint, text string")
    queries = spark.createDataFrame([("q", "number 7", "mixed", 1, 1)], "query_id string, query_text string, query_type string, num_conditions int, num_matches int")
    made = evaluate.evaluate_retrieval(queries, corpus, spark.createDataFrame([("q", 7)], "query_id string, idx bigint"))
    assert made.filter("metric = 'mrr' AND k = 100 AND breakdown = 'overall'").first()["mean"] == 1.0
    assert "corpus_vectors" not in staged


def test_retrieval_files_are_packed(spark, tmp_path):
    corpus = spark.range(40).select(F.col("id").alias("idx"), F.lit("t").alias("text"), F.lit("l").alias("label"), F.lit("d").alias("dataset"), F.lit("b").alias("benchmark"))
    queries = spark.createDataFrame([("retrieval", "q", "x", "numeric", 1, 2)], "task string, query_id string, query_text string, query_type string, num_conditions int, num_matches bigint")
    conds = spark.createDataFrame([("q", 1, "a", "numeric", ">", 1.0, None)], match.CONDITION_SCHEMA)
    store.write_retrieval(str(tmp_path), corpus, queries, conds, spark.createDataFrame([("q", 3), ("q", 3), ("q", 9)], "query_id string, idx bigint"))
    for name in ("corpus", "ground_truth"):
        assert list((tmp_path / f"retrieval/{name}.jsonl").glob("part-*.json.gz")) and not list((tmp_path / f"retrieval/{name}.jsonl").glob("part-*.json"))
    _, qrels, loaded = store.load_retrieval(spark, str(tmp_path))
    assert sorted(map(tuple, qrels.collect())) == [("q", 3), ("q", 9)] and loaded.count() == 40
