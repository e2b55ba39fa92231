import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from rowloom.config import BuildConfig, ClassificationConfig
from rowloom.operators import cells, rank, samples
from rowloom.sources.tables import DatasetSpec, cast_inferred, project_samples, promote_integers, union_samples, with_row_id


def draw(key, row_id):
    return hashlib.md5(f"42|{key}|{row_id}".encode()).hexdigest()[:16]


def toy(spark):
    """One hot dataset with two thirds of the rows and a hot label, and some small ones."""
    rows = [("hot", "a" if i % 10 else "b", str(i)) for i in range(2000)]
    rows += [("mid", f"c{i % 4}", str(i)) for i in range(600)]
    rows += [("tiny", f"t{i % 2}", str(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "dataset_key string, label string, row_id string")
    return rows, df.withColumn("dataset_pos", F.when(F.col("dataset_key") == "hot", 0).when(F.col("dataset_key") == "mid", 1).otherwise(2))


@pytest.mark.parametrize("digits", [1, 2, 3])
def test_group_cut_is_the_nth_row(spark, digits):
    rows, df = toy(spark)
    drawn = samples.with_draw(df, 42, "d")
    cut = rank.group_cut(drawn, ["dataset_key"], "d", "row_id", F.least(F.col("_total"), F.lit(150)), digits).collect()
    groups = defaultdict(list)
    for key, _, row_id in rows:
        groups[key].append((draw(key, row_id), row_id))
    for r in cut:
        ordered = sorted(groups[r["dataset_key"]])
        n = min(len(ordered), 150)
        assert (r["_cut_digest"], r["_cut_id"]) == ordered[n - 1]
        assert r["_total"] == len(ordered)
    assert len(cut) == 3


@pytest.mark.parametrize("rows_in_bucket", [10, 1])
def test_cut_buckets_are_refined(spark, monkeypatch, rows_in_bucket):
    """A bucket that holds the cut is split by further digits; a group of equal digests cannot be, and is still cut right."""
    monkeypatch.setattr(rank, "BUCKET_ROWS", rows_in_bucket)
    rows, df = toy(spark)
    same = spark.createDataFrame([("same", f"{i:03}", "ab" * 8) for i in range(50)], "dataset_key string, row_id string, d string")
    drawn = samples.with_draw(df, 42, "d").select("dataset_key", "row_id", "d").union(same)
    cut = rank.group_cut(drawn, ["dataset_key"], "d", "row_id", F.least(F.col("_total"), F.lit(33)), 1).collect()
    groups = defaultdict(list, same=[("ab" * 8, f"{i:03}") for i in range(50)])
    for key, _, row_id in rows:
        groups[key].append((draw(key, row_id), row_id))
    assert {r["dataset_key"]: (r["_total"], (r["_cut_digest"], r["_cut_id"])) for r in cut} == {k: (len(g), sorted(g)[32]) for k, g in groups.items()}


def test_rows_without_a_key_stay_where_they_are(spark):
    """Only digests are shuffled: every exchange that carries the cells is one of repeated rows."""
    df = spark.range(1000).selectExpr("id % 990 AS a", "repeat('x', 50) AS wide")
    made = with_row_id(df)
    assert made.select("_row_id").distinct().count() == 1000
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "LeftAnti" in plan and "SortMergeJoin" not in plan


def test_sample_and_gates(spark):
    rows, df = toy(spark)
    kept = samples.sample_per_dataset(df, 150).collect()
    assert Counter(r["dataset_key"] for r in kept) == {"hot": 150, "mid": 150, "tiny": 40}
    want = sorted((draw("hot", i), i) for k, _, i in rows if k == "hot")[:150]
    assert {r["row_id"] for r in kept if r["dataset_key"] == "hot"} == {i for _, i in want}
    assert {r[0] for r in samples.gate_min_samples(df, 100).select("dataset_key").distinct().collect()} == {"hot", "mid"}
    assert samples.sample_per_dataset(df, None) is df


@pytest.mark.parametrize("partitions", ["1", "4", "33"])
def test_stratified_split(spark, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rows, df = toy(spark)
        got = samples.stratified_split(df.repartition(int(partitions)), 0.8).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    groups = defaultdict(list)
    for key, label, row_id in rows:
        groups[key, label].append((draw(key, row_id), row_id))
    train = {(k, i) for (k, _), members in groups.items()
             for _, i in sorted(members)[:min(max(1, int(len(members) * 0.8)), len(members) - 1)]}
    assert {(r["dataset_key"], r["row_id"]) for r in got if r["split"] == "train"} == train
    assert len(got) == len(rows)


def test_small_classes_keep_a_row_on_either_side(spark):
    df = spark.createDataFrame([("d", "x", str(i)) for i in range(2)] + [("d", "y", str(i)) for i in range(2, 5)],
                               "dataset_key string, label string, row_id string")
    counts = {(r["label"], r["split"]): r["n_rows"] for r in samples.split_class_counts(samples.stratified_split(df, 0.99)).collect()}
    assert counts == {("x", "train"): 1, ("x", "test"): 1, ("y", "train"): 2, ("y", "test"): 1}
    counts = {(r["label"], r["split"]): r["n_rows"] for r in samples.split_class_counts(samples.stratified_split(df, 0.1)).collect()}
    assert counts == {("x", "train"): 1, ("x", "test"): 1, ("y", "train"): 1, ("y", "test"): 2}


def test_class_gates_in_order(spark):
    rows = [("one", "a")] * 120 + [("many", f"l{i}") for i in range(60)] + [("ratio", f"l{i % 11}") for i in range(100)]
    rows += [("edge", f"l{i % 50}") for i in range(500)] + [("rare", "a" if i else "b") for i in range(100)]
    rows += [("good", f"l{i % 3}") for i in range(100)]
    df = spark.createDataFrame(rows, "dataset_key string, label string")
    got = {r["dataset_key"]: r["verdict"] for r in samples.gate_classes(samples.label_stats(df)).collect()}
    assert got == {"one": "single_class", "many": "too_many_classes", "ratio": "label_ratio", "edge": "kept",
                   "rare": "rare_class", "good": "kept"}
    config = BuildConfig(classification=ClassificationConfig(max_num_labels=2))
    assert samples.keep_classifiable(df, config).select("dataset_key").distinct().collect() == []


def test_dense_positions(spark):
    rows, df = toy(spark)
    got = cells.number_corpus(df).collect()
    order = {"hot": 0, "mid": 1, "tiny": 2}
    want = sorted(((order[k], draw(k, i), i) for k, _, i in rows))
    assert [r["row_id"] for r in sorted(got, key=lambda r: r["idx"])] == [w[2] for w in want]
    assert sorted(r["idx"] for r in got) == list(range(len(rows)))


def test_rows_without_key_keep_every_copy(spark):
    df = spark.createDataFrame([("a", 1.0)] * 7 + [("b", None)] * 2 + [(None, 2.0)], "s string, d double")
    got = with_row_id(df).collect()
    assert Counter((r["s"], r["d"]) for r in got) == {("a", 1.0): 7, ("b", None): 2, (None, 2.0): 1}
    assert len({r["_row_id"] for r in got}) == 10
    again = {r["_row_id"] for r in with_row_id(df.repartition(3)).collect()}
    assert again == {r["_row_id"] for r in got}


def test_many_copies_are_listed_in_chunks(spark, monkeypatch):
    monkeypatch.setattr("rowloom.sources.tables.COPY_CHUNK", 4)
    df = spark.createDataFrame([("a",)] * 11 + [("b",)] * 3, "s string")
    got = with_row_id(df).collect()
    assert Counter(r["s"] for r in got) == {"a": 11, "b": 3}
    assert len({r["_row_id"] for r in got}) == 14


def test_inferred_types(spark):
    raw = spark.createDataFrame([("1", "1.5", "True", "x", None, "1"), ("-2", " 2", "False", "3", None, "2.0"), (None, None, None, None, None, None)],
                                "i string, f string, b string, s string, n string, m string")
    types = dict(cast_inferred(raw).dtypes)
    assert types == {"i": "double", "f": "double", "b": "boolean", "s": "string", "n": "double", "m": "double"}
    assert dict(cast_inferred(raw.limit(2)).dtypes) == {**types, "i": "bigint"}
    numbers = spark.createDataFrame([(1, 2.0)], "i int, d double")
    assert dict(promote_integers(numbers).dtypes) == {"i": "double", "d": "double"}
    mixed = spark.createDataFrame([(1, 2.0, "x")], "i int, d double, s string")
    assert promote_integers(mixed) is mixed


def test_canonical_samples(spark):
    df = spark.createDataFrame([(1, 2.345, "red.", None, "12.5"), (2, float("nan"), None, "L", "n/a")],
                               "id int, price double, colour string, size string, code string")
    spec = DatasetSpec("shop", "b", "size", {"price": "float", "code": "int"}, id_columns=("id",))
    got = {r["row_id"]: r for r in project_samples(df, spec).collect()}
    assert got["1"]["text"] == f"The price is {round(2.345, 2)}. The colour is red. The code is 12.5."
    assert got["1"]["label"] == "nan" and got["2"]["label"] == "L"
    assert got["2"]["text"] == "The price is unknown. The colour is unknown. The code is n/a."
    assert got["1"]["nums"] == {"price": 2.345, "code": 12.5} and got["2"]["nums"] == {"price": None, "code": None}
    assert got["1"]["cats"] == {"colour": "red."}


def test_no_tables(spark):
    empty = union_samples(spark, [])
    assert empty.count() == 0 and "text" in empty.columns


def test_ordering_takes_as_many_tasks_as_its_rows_need(spark, monkeypatch):
    """Rows of one task are bounded whatever the number of shuffle partitions, and written tables are packed tightly."""
    from pyspark.sql import functions as F

    from rowloom.operators import rank
    from rowloom.session import WIDE_CODEC, write_stage

    monkeypatch.setattr(rank, "SORTED_ROWS", 100)
    rows = spark.range(3000).select((F.col("id") % 2).alias("g"), F.md5(F.col("id").cast("string")).alias("draw"), F.col("id").cast("string").alias("row_id"))
    made = rank.dense_position(rows, "g", "draw", "row_id")
    sizes = made.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert sizes < 300 and made.rdd.getNumPartitions() == 30
    want = sorted((r["g"], r["draw"], r["row_id"]) for r in rows.collect())
    assert [(r["g"], r["draw"], r["row_id"]) for r in made.orderBy("idx").collect()] == want
    assert all(".zstd.parquet" in name for name in write_stage(rows, "packed", codec=WIDE_CODEC).inputFiles())


def test_corpus_is_written_once_and_numbered_like_its_samples(spark, monkeypatch):
    """Rows are moved as their tables have them: only the corpus itself is written as sentences. Columns may be named like helper columns."""
    import os

    from pyspark.sql import functions as F

    from rowloom.config import RetrievalConfig, SerializerConfig
    from rowloom.operators import rank
    from rowloom.plans import build
    from rowloom.session import temporary_stages

    monkeypatch.setattr(rank, "PLACE_BUCKET", 10)
    monkeypatch.setattr(rank, "TASK_ROWS", 50)
    keyed = spark.range(300).select(F.col("id"), (F.col("id") % 7 / 3).alias("_bucket"), F.concat(F.lit("t"), "id").alias("text"),
                                    F.when(F.col("id") % 5 > 0, F.repeat(F.lit("x"), (F.col("id") % 90).cast("int"))).alias("row_id"), (F.col("id") % 2 == 0).alias("y"))
    twice = spark.createDataFrame([(i % 40, None if i % 4 else "d", "ab"[i % 2]) for i in range(120)], "v int, dataset_key string, `c.d` string")
    small = spark.createDataFrame([(1, "a")] * 20, "v int, y string")
    digests = keyed.withColumn("id", F.md5(F.col("id").cast("string")))
    tables = [(DatasetSpec("keyed", "b", "y", {"_bucket": "float"}, id_columns=("id",)), keyed), (DatasetSpec("twice", "b", "c.d", {"v": "int"}), twice),
              (DatasetSpec("small", "b", "y", {"v": "int"}), small), (DatasetSpec("digests", "b", "y", {"_bucket": "float"}, id_columns=("id",)), digests)]
    tables = [(spec, with_row_id(df, spec.id_columns)) for spec, df in tables]
    for cap in (None, 110):
        config = BuildConfig(retrieval=RetrievalConfig(max_samples_per_dataset=cap), serializer=SerializerConfig(model_max_len_tokens=30))
        want = cells.number_corpus(samples.build_samples(union_samples(spark, tables), config, cap)).drop("n_chars", "draw_42")
        with temporary_stages(spark) as folder:
            made = build.retrieval_corpus(spark, tables, config)
            wide = [name for name in os.listdir(folder) if "text" in spark.read.parquet(f"{folder}/{name}").columns]
            assert [name.split("-")[0] for name in wide] == ["corpus"]
            assert sorted(made.columns) == sorted(want.columns)
            got = sorted(made.select(want.columns).collect(), key=lambda r: r["idx"])
        assert got == sorted(want.collect(), key=lambda r: r["idx"]) and 200 < len(got) < 640
    none = build.retrieval_corpus(spark, [], BuildConfig())
    assert none.count() == 0 and "idx" in none.columns
