"""The default encoder against Spark ML's own stages, and evaluation on the sparse form of its vectors."""

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from rowloom.operators import encode
from rowloom.plans import evaluate

TEXTS = ["The a is 1.5. The b is X-y_z.", "ΑΣ ΣΑΣ ß İstanbul 中文，字 ١٢٣ n²", "", None, "... --", "x" * 500 + " " + "Y" * 67 + "\t" + "é" * 40, "A-b_C.d 1e5;x\ty\nz w"]


def test_vectors_are_those_of_spark_ml(spark, monkeypatch):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS * 3)], "id int, text string")
    named = df.withColumn("_text", F.coalesce("text", F.lit("")))
    stages = [RegexTokenizer(inputCol="_text", outputCol="_terms", pattern=encode.TOKEN_BREAK), HashingTF(inputCol="_terms", outputCol="_counts", numFeatures=64),
              Normalizer(inputCol="_counts", outputCol="_unit")]
    want = {r["id"]: r["v"] for r in Pipeline(stages=stages).fit(named).transform(named).select("id", vector_to_array("_unit", dtype="float32").alias("v")).collect()}
    assert {r["id"]: r["embedding"] for r in encode.encode_text(df, dim=64).collect()} == want
    for r in encode.encode_sparse(df, dim=64).collect():
        dense = np.zeros(64)
        dense[r["embedding"]["indices"]] = r["embedding"]["values"]
        assert dense.tolist() == want[r["id"]]


def test_classification_writes_sparse_vectors(spark, monkeypatch):
    words = ["red", "green", "blue"]
    rows = spark.createDataFrame([("d", "b", str(i), f"the colour is {words[i % 3]} {i}", words[i % 3], "test" if i % 5 == 0 else "train") for i in range(90)],
                                 "dataset_key string, benchmark string, row_id string, text string, label string, split string")
    staged, write = {}, evaluate.write_stage
    monkeypatch.setattr(evaluate, "write_stage", lambda df, name, *a, **b: staged.setdefault(name, write(df, name, *a, **b)))
    score = evaluate.evaluate_classification(rows)[0].first()
    assert (score["train_samples"], score["test_samples"], score["num_classes"], score["test_accuracy"]) == (72, 18, 3, 1.0)
    assert "array" not in dict(staged["embedded"].dtypes)["embedding"] and "text" not in staged["embedded"].columns
