"""Loaders, sinks and metrics on input that is easily lost or counted twice."""

import csv
import gzip
import io
import json

import pytest

from rowloom.operators.samples import retrieval_stats
from rowloom.operators.metrics import compute_retrieval_metrics, hits_rel, judged_counts
from rowloom.operators.search import topk_ivf, train_centroids
from rowloom.plans.evaluate import evaluate
from rowloom.sources import store
from rowloom.sources.tables import row_digest, scan_csv, split_quotes

JUDGED = "query_id string, idx bigint"
HITS = "query_id string, rank int, idx bigint"


def split_rows(spark, names):
    rows = [(f"text {i}", f"{i % 2}", "clf", f"b/{n}", "b", "", n, s) for n in names for s in ("train", "test") for i in range(4)]
    return spark.createDataFrame(rows, store.SPLIT_SCHEMA)


def test_repeated_judgements_count_once(spark):
    hits = spark.createDataFrame([("q", 1, 5), ("q", 2, 6)], HITS)
    judged = spark.createDataFrame([("q", 5), ("q", 5), ("q", 9)], JUDGED)
    assert sorted((r.idx, r.rel) for r in hits_rel(hits, judged).collect()) == [(5, 1), (6, 0)]
    assert judged_counts(judged).first()["num_matches"] == 2
    queries = spark.createDataFrame([("q", "numeric", 1, 77)], "query_id string, query_type string, num_conditions int, num_matches bigint")
    overall = {r.metric: r["mean"] for r in compute_retrieval_metrics(queries, hits, judged, [10]).filter("breakdown = 'overall'").collect()}
    assert overall["recall"] == 0.5 and max(overall.values()) <= 1.0
    unnamed = queries.selectExpr("query_id", "query_type", "num_conditions", "CAST(NULL AS bigint) AS num_matches")
    assert compute_retrieval_metrics(unnamed, hits, judged, [10]).count() > 0


def test_dataset_names_stay_text(spark, tmp_path):
    store.write_splits(split_rows(spark, ["007", "12", "a b+c"]), str(tmp_path))
    got = store.load_splits(spark, str(tmp_path)).groupBy("dataset").count().collect()
    assert {r["dataset"]: r["count"] for r in got} == {"007": 8, "12": 8, "a b+c": 8}
    assert store.load_splits(spark, str(tmp_path), datasets=["007"], split="train").count() == 4


def test_splits_are_packed_and_keep_their_order(spark, tmp_path):
    """Files are compressed; plain files beside them, of an earlier run, are read too."""
    store.write_splits(split_rows(spark, ["one"]), str(tmp_path))
    files = sorted(p for p in (tmp_path / "classification").rglob("part-*") if p.is_file())
    assert files and all(p.name.endswith(".json.gz") for p in files)
    want = split_rows(spark, ["one"]).filter("split = 'test'").withColumn("d", store.final_draw(identity="text")).orderBy("d")
    lines = [json.loads(line)["text"] for p in files if "split=test" in str(p) for line in gzip.decompress(p.read_bytes()).decode().splitlines()]
    assert lines == [r["text"] for r in want.collect()]
    plain = tmp_path / "classification" / "benchmark=b" / "sub_benchmark=__HIVE_DEFAULT_PARTITION__" / "dataset=two"
    for split in ("train", "test"):
        (plain / f"split={split}").mkdir(parents=True)
        (plain / f"split={split}" / "part-0.json").write_text('{"text": "t", "label": "l", "task_type": "clf", "dataset_key": "b/two"}\n')
    assert {r["dataset"]: r["count"] for r in store.load_splits(spark, str(tmp_path)).groupBy("dataset").count().collect()} == {"one": 8, "two": 2}


CSV = ('id,"te\nxt",n\r\n1,"a ""b"", c",7\r\n2,"line\none\r\n\n""two""",8\r\n3,plain,9\r\n4,"",10\r\n'
       '5,"\n",11\r\n\r\n6,"ends, ""here""\n",12\r\n7,"x\ny\nz",13')


@pytest.mark.parametrize("size", [7, 11, 29, 1000])
def test_records_that_span_lines_are_read_from_any_split(spark, tmp_path, size):
    """Splits of few bytes begin at every place: inside cells, between doubled quotes, at line breaks. Each is read by a task of its own."""
    (tmp_path / "t.csv").write_bytes(CSV.encode())
    (tmp_path / "u.csv").write_bytes(CSV.replace("plain", "other").encode())
    settings = {"spark.sql.files.maxPartitionBytes": f"{size}b", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        assert size == 1000 or split_quotes(spark, str(tmp_path)).count() > 2
        rows = [tuple(r) for r in scan_csv(spark, str(tmp_path)).collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    parsed = [r for r in csv.reader(io.StringIO(CSV, newline="")) if r]
    want = [(int(a), V, int(n)) for a, V, n in parsed[1:]]
    want += [(a, "other" if t == "plain" else t, n) for a, t, n in want]
    assert sorted((a, t or "", n) for a, t, n in rows) == sorted(want)
    assert scan_csv(spark, str(tmp_path)).columns == ["id", "te\nxt", "n"]


def test_broken_line_is_an_error(spark, tmp_path):
    folder = tmp_path / "retrieval"
    folder.mkdir()
    (folder / "queries.jsonl").write_text('{"query_id": "q"}\n{"query_id": \n')
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        store.load_retrieval(spark, str(tmp_path))[0].collect()


def test_white_space_survives_csv(spark, tmp_path):
    rows = spark.createDataFrame([("  x ", "y")], "a string, label string").selectExpr("struct(a, label) AS csv")
    store.write_csv(rows, str(tmp_path / "c"))
    text = "".join(p.read_text() for p in (tmp_path / "c").glob("*.csv"))
    assert "  x ,y" in text


def test_row_digest_tells_cells_apart(spark):
    rows = spark.createDataFrame([("a|", "b"), ("a", "|b"), (None, "z"), ("", "z")], "x string, y string")
    assert rows.select(row_digest(rows, ["x", "y"]).alias("d")).distinct().count() == 4


def test_plain_layout_is_evaluated(spark, tmp_path):
    for split in ("train", "test"):
        folder = tmp_path / "in" / "classification" / "bench" / "sub" / "name"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{split}.jsonl").write_text("".join(f'{{"text": "{"good" if i % 2 else "bad"} {i}", "label": "{i % 2}", "task_type": "clf"}}\n' for i in range(20)))
    found = evaluate(spark, str(tmp_path / "in"), str(tmp_path / "out"), "hash")["classification_datasets"].collect()
    assert [(r.dataset_key, r.train_samples, r.test_samples) for r in found] == [("bench/sub/name", 20, 20)]


def test_centroids_come_from_all_rows_and_probes_from_nlist(spark):
    rows = spark.createDataFrame([(i, [1.0, float(i % 7)]) for i in range(600)], "idx bigint, embedding array<float>")
    assert train_centroids(rows, 2).shape == (2, 2)
    queries = rows.filter("idx < 3").selectExpr("CAST(idx AS string) AS query_id", "embedding")
    assert topk_ivf(queries, rows, 3, nlist=4).count() == 9


def test_published_numbers_are_numbers(spark, tmp_path):
    """Numeric values are JSON numbers as they were searched for; they come back unchanged."""
    conds = spark.createDataFrame([("q", 2, "b", "categorical", "==", None, "1.50"), ("q", 1, "a", "numeric", ">", 1.23456, None),
                                   ("r", 1, "a", "numeric", "==", 45.0, None)], "query_id string, pos int, field string, type string, operator string, num double, str string")
    queries = spark.createDataFrame([("q", "t"), ("r", "t")], "query_id string, query_text string")
    corpus = spark.createDataFrame([(0, "t", "l", "d", "b")], store.CORPUS_SCHEMA)
    store.write_retrieval(str(tmp_path), corpus, queries, conds, spark.createDataFrame([("q", 0)], JUDGED))
    lines = [json.loads(line) for p in (tmp_path / "retrieval" / "queries.jsonl").glob("*.json") for line in p.read_text().splitlines()]
    values = {line["query_id"]: [c["value"] for c in line["conditions"]] for line in lines}
    assert values == {"q": [1.23456, "1.50"], "r": [45.0]}
    back = store.loaded_conditions(store.load_retrieval(spark, str(tmp_path))[0])
    assert sorted((r.query_id, r.pos, r.num, r.str) for r in back.collect()) == [("q", 1, 1.23456, None), ("q", 2, None, "1.50"), ("r", 1, 45.0, None)]


def test_totals_without_queries(spark):
    corpus = spark.range(7)
    queries = spark.createDataFrame([], "query_id string, query_type string")
    assert [tuple(r) for r in retrieval_stats(corpus, queries).collect()] == [(None, 0, 7)]
