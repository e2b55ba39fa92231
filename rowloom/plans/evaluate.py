"""Scoring embeddings on classification and retrieval sets."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.config import EvalConfig
from rowloom.operators import classify
from rowloom.operators.encode import Encoder, encode_sparse, encode_text
from rowloom.operators.metrics import Judgements, compute_retrieval_metrics
from rowloom.operators.search import INDEX_TYPES, scans, search
from rowloom.session import WIDE_CODEC, write_stage
from rowloom.sources import store


def classify_embedded(rows: DataFrame) -> DataFrame:
    """Predictions for rows (dataset_key, benchmark, split, label, embedding, ...), one model per dataset."""
    train = rows.filter(F.col("split") == "train")
    coded = classify.label_encode(rows, classify.class_index(train))
    models = classify.fit_classifiers(coded.filter(F.col("split") == "train"))
    return classify.predict(coded, models)


def evaluate_classification(rows: DataFrame, config: EvalConfig = EvalConfig(),
                            encoder_factory: Callable[[], Encoder] | None = None) -> tuple[DataFrame, DataFrame]:
    """(scores per dataset, summary) of split samples; all datasets are encoded in one pass."""
    kept = ["dataset_key", "benchmark", "label", "split", "embedding"]
    if encoder_factory is None:
        sparse = encode_sparse(rows).select(*kept)
        vectors = T.StructType([f if f.name != "embedding" else T.StructField(f.name, VectorUDT()) for f in sparse.schema.fields])
        embedded = write_stage(sparse, "embedded", codec=WIDE_CODEC, schema=vectors)
    else:
        embedded = write_stage(encode_text(rows, "text", encoder_factory, config.batch_size).select(*kept), "embedded")
    scores = write_stage(classify.dataset_scores(classify_embedded(embedded)), "scores")
    return scores, classify.clf_summary(scores)


def evaluate_retrieval(queries: DataFrame, corpus: DataFrame, qrels: Judgements, config: EvalConfig = EvalConfig(),
                       encoder_factory: Callable[[], Encoder] | None = None) -> DataFrame:
    """Metric table of an embedding search with the query texts over the corpus texts.

    An empty query set or corpus gives an empty table.
    """
    q = write_stage(encode_text(queries.select("query_id", "query_text"), "query_text", encoder_factory, config.batch_size)
                    .select("query_id", "embedding"), "query_vectors")
    c = encode_text(corpus.select("idx", "text"), "text", encoder_factory, config.batch_size).select("idx", "embedding")
    if config.retrieval_index_type != "flat" or not scans(q, max(config.retrieval_top_k)):  # else the vectors are read once
        c = write_stage(c, "corpus_vectors")
    return evaluate_search(queries, q, c, qrels, config)


def evaluate_search(queries: DataFrame, query_vectors: DataFrame, corpus_vectors: DataFrame, qrels: Judgements,
                    config: EvalConfig = EvalConfig()) -> DataFrame:
    """Metric table for vectors that already exist."""
    hits = write_stage(
        search(query_vectors, corpus_vectors, max(config.retrieval_top_k), config.retrieval_index_type), "hits")
    return compute_retrieval_metrics(queries, hits, qrels, config.retrieval_top_k)


def evaluate(spark: SparkSession, benchmark_root: str, output_root: str, model: str, config: EvalConfig = EvalConfig(),
             encoder_factory: Callable[[], Encoder] | None = None) -> dict[str, DataFrame]:
    """Load both sets, score them, and write the result tables under the model's name and the time."""
    if config.retrieval_index_type not in INDEX_TYPES:
        raise ValueError(f"retrieval_index_type must be one of {', '.join(INDEX_TYPES)}, not {config.retrieval_index_type!r}")
    results: dict[str, DataFrame] = {}
    if "classification" in config.tasks:
        rows = store.load_splits(spark, benchmark_root, config.benchmarks, config.datasets)
        if rows.isEmpty():  # the plain layout of published sets
            rows = store.load_split_files(spark, benchmark_root, config.benchmarks, config.datasets)
        if not rows.isEmpty():
            scores, summary = evaluate_classification(rows, config, encoder_factory)
            results |= {"classification_datasets": scores, "classification_summary": summary}
    if "retrieval" in config.tasks:
        queries, qrels, corpus = store.load_retrieval(spark, benchmark_root)
        if not queries.isEmpty() and not corpus.isEmpty():
            results["retrieval_metrics"] = evaluate_retrieval(queries, corpus, qrels, config, encoder_factory)
    run_ts = datetime.now(timezone.utc).strftime("%Y%m%d_%H%M%S")
    store.write_results(results, output_root, model, run_ts)
    return results
