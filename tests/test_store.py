import json
import os

import pytest
from pyspark.sql import functions as F

from rowloom import session
from rowloom.config import BuildConfig, ClassificationConfig, EvalConfig, RetrievalConfig
from rowloom.plans import build, evaluate
from rowloom.sources import catalog, store
from rowloom.sources.tables import DatasetSpec, load_table, scan_csv, write_dataset
from rowloom.streaming.serialize import stream_samples


def put(folder, name, rows, features, yaml="x.yaml"):
    folder.mkdir(parents=True)
    (folder / name).write_text("\n".join(rows) + "\n")
    if yaml:
        (folder / yaml).write_text("label_values: []\n")
    if features is not None:
        (folder / "feature_list.jsonl").write_text("\n".join(json.dumps(f) if isinstance(f, dict) else f for f in features) + "\n")


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    table = ["a,b,y"] + [f"{i * 0.5},{'u' if i % 3 else 'NA'},{'yes' if i % 2 else 'no'}" for i in range(150)]
    features = [{"name": "a", "kind": "float"}, {"name": "b", "kind": "category"}, {"name": "y", "is_target": True}, {"name": "b", "is_target": True}]
    put(root / "openml_cc18" / "d 1", "one.csv", table, features)
    put(root / "grinsztajn" / "num_clf" / "d2", "two.csv", table, features, "two.yaml")
    put(root / "grinsztajn" / "other" / "d3", "three.csv", table, features)
    put(root / "unipredict" / "u1" / "d4", "same.csv", table, features)
    put(root / "unipredict" / "u2" / "d4", "same.csv", table[:80], features)
    put(root / "openml_ctr23" / "noyaml", "n.csv", table, features, None)
    put(root / "openml_ctr23" / "nolist", "n.csv", table, None)
    put(root / "openml_ctr23" / "notarget", "n.csv", table, features[:2])
    put(root / "openml_ctr23" / "broken", "n.csv", table, [*features, "{not json"])
    put(root / "openml_ctr23" / "reg", "b.csv", table, features)
    (root / "openml_ctr23" / "reg" / "a.csv").write_text("\n".join(table) + "\n")
    return str(root)


def test_discovery(spark, tree):
    found = catalog.discover_datasets(spark, tree)
    got = {r["dataset_key"]: (r["task_type"], r["data_type"], r["target"]) for r in found.collect()}
    assert got == {
        "openml_cc18/one": ("clf", "mixed", "y"), "grinsztajn/num_clf/two": ("clf", "num", "y"),
        "unipredict/u1/same": ("clf", "mixed", "y"), "unipredict/u2/same": ("clf", "mixed", "y"), "openml_ctr23/a": ("reg", "mixed", "y")}
    assert [s.key for s in catalog.specs(found)] == [
        "grinsztajn/num_clf/two", "openml_cc18/one", "openml_ctr23/a", "unipredict/u1/same", "unipredict/u2/same"]
    only = catalog.discover_datasets(spark, tree, ["openml_cc18"])
    assert [r["name"] for r in only.collect()] == ["one"]
    assert {r["benchmark"]: r["n_datasets"] for r in catalog.catalog_counts(found).collect()}["unipredict"] == 2


def test_only_folders_of_the_layout_are_listed(spark, tree, tmp_path):
    """Three files for each folder of the benchmark asked for; nothing of the others, nothing beside the layout."""
    listed = catalog.list_files(spark, tree, ["openml_cc18"])
    assert sorted(r["rel"] for r in listed.collect()) == ["openml_cc18/d 1/feature_list.jsonl", "openml_cc18/d 1/one.csv", "openml_cc18/d 1/x.yaml"]
    assert not any("other/d3" in r["rel"] for r in catalog.list_files(spark, tree).collect())
    assert catalog.list_files(spark, str(tmp_path)).count() == 0 and catalog.discover_datasets(spark, str(tmp_path)).count() == 0
    odd = tmp_path / "a {b}, [c]"
    put(odd / "openml_cc18" / "d", "t.csv", ["a,y", "1,x"], [{"name": "y", "is_target": True}])
    assert [r["dataset_key"] for r in catalog.discover_datasets(spark, str(odd)).collect()] == ["openml_cc18/t"]


def test_scan(spark, tree, tmp_path):
    spec = next(s for s in catalog.specs(catalog.discover_datasets(spark, tree)) if s.name == "one")
    df = load_table(spark, spec)
    assert dict(df.dtypes) == {"a": "double", "b": "string", "y": "string"}
    assert df.filter("b is null").count() == 50
    path = tmp_path / "lines.csv"
    path.write_text('s,n\n"two\nlines, ""quoted""",1\nplain,NA\n')
    rows = {r["s"]: r["n"] for r in scan_csv(spark, str(path)).collect()}
    assert rows == {'two\nlines, "quoted"': 1, "plain": None}


def test_whole_build_and_evaluation(spark, tree, tmp_path):
    out = str(tmp_path / "out")
    config = BuildConfig(retrieval=RetrievalConfig(num_queries_per_type=6, max_samples_per_dataset=120),
                         classification=ClassificationConfig(max_samples_per_dataset=140))
    held = set(os.listdir(session.shared_folder(spark)))
    build.build(spark, tree, out, config)
    assert set(os.listdir(session.shared_folder(spark))) == held  # intermediate tables are gone
    rows = store.load_splits(spark, out)
    sizes = {r["dataset_key"]: r["count"] for r in rows.groupBy("dataset_key").count().collect()}
    assert sizes == {k: 140 for k in ("openml_cc18/one", "grinsztajn/num_clf/two", "openml_ctr23/a", "unipredict/u1/same")}
    assert store.load_splits(spark, out, benchmarks=["openml_cc18"], split="test").count() < 140
    assert store.load_splits(spark, out, datasets=["two"]).select("sub_benchmark").distinct().first()[0] == "num_clf"
    csv = spark.read.option("header", True).csv(f"{out}/classification_csv/openml_cc18/one")
    assert csv.columns == ["a", "b", "y", "split"] and csv.count() == 140
    assert csv.filter("a rlike '[.]0$'").count() == 0
    train = csv.filter("split = 'train'").count()
    assert train == rows.filter("dataset_key = 'openml_cc18/one' and split = 'train'").count()
    queries, qrels, corpus = store.load_retrieval(spark, out)
    assert corpus.count() == 480 and corpus.agg(F.max("idx")).first()[0] == 479
    per_query = {r["query_id"]: r["count"] for r in qrels.groupBy("query_id").count().collect()}
    assert per_query == {r["query_id"]: r["num_matches"] for r in queries.collect()} and per_query
    conds = store.loaded_conditions(queries)
    from rowloom.operators.match import match_anchor
    made = build.retrieval_corpus(spark, build.discovered_tables(spark, tree, config), config)
    again = match_anchor(made, conds)
    assert again.exceptAll(qrels).count() == 0 and qrels.exceptAll(again).count() == 0
    results = evaluate.evaluate(spark, out, str(tmp_path / "res"), "hash", EvalConfig(retrieval_top_k=(1, 10)))
    assert set(results) == {"classification_datasets", "classification_summary", "retrieval_metrics"}
    back = store.load_results(spark, str(tmp_path / "res"), "retrieval_metrics")
    assert back.filter("metric = 'recall' and breakdown = 'overall'").count() == 2
    assert results["classification_summary"].filter("benchmark is null").first()["num_datasets"] == 4


def test_plain_layouts(spark, tmp_path):
    base = tmp_path / "classification"
    for folder, names in {"b1/d1": ["train", "test"], "b1/sub/d2": ["train", "test"], "b2/d3": ["train"]}.items():
        (base / folder).mkdir(parents=True)
        for name in names:
            (base / folder / f"{name}.jsonl").write_text('{"text": "t", "label": "l", "task_type": "clf"}\n\n{"text": "u", "label": "l"}\n')
    got = store.load_split_files(spark, str(tmp_path))
    keys = {(r["dataset_key"], r["split"], r["count"]) for r in got.groupBy("dataset_key", "split").count().collect()}
    assert keys == {("b1/d1", "train", 2), ("b1/d1", "test", 2), ("b1/sub/d2", "train", 2), ("b1/sub/d2", "test", 2)}
    assert store.load_split_files(spark, str(tmp_path), ["b1"], ["d2"]).count() == 4
    (tmp_path / "retrieval").mkdir()
    (tmp_path / "retrieval" / "queries.jsonl").write_text(json.dumps({
        "query_id": "q1", "query_text": "t", "query_type": "mixed", "num_conditions": 2, "matching_indices": [4, 9], "num_matches": 2,
        "conditions": [{"field": "f", "operator": ">", "value": 1.5, "type": "numeric"}, {"field": "g", "operator": "==", "value": "x", "type": "categorical"}]}) + "\n")
    queries, qrels, corpus = store.load_retrieval(spark, str(tmp_path))
    assert {tuple(r) for r in qrels.collect()} == {("q1", 4), ("q1", 9)} and corpus.count() == 0
    conds = [(r["pos"], r["field"], r["num"], r["str"]) for r in store.loaded_conditions(queries).orderBy("pos").collect()]
    assert conds == [(1, "f", 1.5, None), (2, "g", None, "x")]
    assert store.load_retrieval(spark, str(tmp_path), load_corpus=False)[2] is None


def test_missing_folders_are_empty(spark, tmp_path):
    assert store.load_splits(spark, str(tmp_path)).count() == 0
    queries, qrels, corpus = store.load_retrieval(spark, str(tmp_path))
    assert queries.count() == qrels.count() == corpus.count() == 0
    assert evaluate.evaluate(spark, str(tmp_path), str(tmp_path / "r"), "m") == {}
    with pytest.raises(ValueError):
        evaluate.evaluate(spark, str(tmp_path), str(tmp_path / "r"), "m", EvalConfig(retrieval_index_type="tree"))


def test_written_dataset_is_found_again(spark, tmp_path):
    df = spark.createDataFrame([(i, f"n{i % 5}", float(i)) for i in range(120)], "k int, c string, x double")
    write_dataset(df, DatasetSpec("made", "openml_cc18", "c", {"x": "float"}), str(tmp_path / "openml_cc18" / "f"))
    (spec,) = catalog.specs(catalog.discover_datasets(spark, str(tmp_path)))
    assert spec.key == "openml_cc18/made" and spec.kinds["x"] == "float" and load_table(spark, spec).count() == 120


def test_stream_of_rows(spark, tmp_path):
    df = spark.createDataFrame([(i, 0.5 * i, "y") for i in range(20)], "k int, x double, t string")
    df.write.parquet(str(tmp_path / "in"))
    spec = DatasetSpec("s", "b", "t", {"x": "float"}, id_columns=("k",))
    stream = stream_samples(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), spec, 14336)
    query = stream.select("row_id", "text").writeStream.format("memory").queryName("texts").trigger(availableNow=True).start()
    query.awaitTermination(60)
    got = {r["row_id"]: r["text"] for r in spark.table("texts").collect()}
    assert len(got) == 20 and got["3"] == "The x is 1.5."
