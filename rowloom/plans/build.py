"""Building classification and retrieval sets from source tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.config import BuildConfig
from rowloom.operators.cells import PLACE, number_corpus, number_placed, place_rows
from rowloom.operators.match import match_anchor
from rowloom.operators.samples import (
    build_samples, class_cuts, clf_stats, dataset_sizes, keep_classifiable, keep_sampled, length_filter, mark_split, retrieval_stats,
    sample_cuts, sample_per_dataset, split_metadata,
)
from rowloom.operators.workload import build_queries
from rowloom.session import WIDE_CODEC, stage_small, temporary_stages, write_stage
from rowloom.sources import store
from rowloom.sources.catalog import discover_datasets, specs
from rowloom.sources.tables import (
    SAMPLE_SCHEMA, DatasetSpec, load_table, project_samples, samples_of_cells, typed_cells, union_samples, with_row_id,
)

TABLES_AT_ONCE = 8       # tables that the driver loads side by side
Tables = Sequence[tuple[DatasetSpec, DataFrame]]


@dataclass(frozen=True)
class RetrievalSet:
    corpus: DataFrame
    queries: DataFrame
    conditions: DataFrame
    qrels: DataFrame


def discovered_tables(spark: SparkSession, root: str, config: BuildConfig = BuildConfig()) -> list[tuple[DatasetSpec, DataFrame]]:
    """Typed, identified tables of a folder tree, in catalog order.

    Each is written once, so that both sets and all their passes read columns of it; TABLES_AT_ONCE tables are loaded side by side.
    """
    catalog = discover_datasets(spark, root, list(config.benchmarks) if config.benchmarks else None)
    found = specs(catalog)

    def load(spec: DatasetSpec) -> tuple[DatasetSpec, DataFrame]:
        return spec, write_stage(with_row_id(load_table(spark, spec)), "table")

    if not found:
        return []
    with ThreadPool(min(TABLES_AT_ONCE, len(found))) as pool:
        return pool.map(inheritable_thread_target(spark)(load), found)


def classification_cuts(spark: SparkSession, tables: Tables, config: BuildConfig = BuildConfig()) -> tuple[DataFrame, DataFrame]:
    """(samples, class cuts).

    Class cuts exist for the datasets that passed every gate, so marking rows with them also drops
    the other datasets.
    """
    raw = union_samples(spark, tables, config.serializer.numeric_precision)
    samples = build_samples(raw, config, config.classification.max_samples_per_dataset)
    cuts = class_cuts(keep_classifiable(samples, config), config.classification.train_ratio, config.random_seed)
    return samples, stage_small(cuts, "class_cuts")[0]


def classification_set(spark: SparkSession, tables: Tables, config: BuildConfig = BuildConfig()) -> DataFrame:
    """Samples of all classifiable datasets with their split."""
    samples, cuts = classification_cuts(spark, tables, config)
    return mark_split(samples, cuts, config.random_seed)


def retrieval_corpus(spark: SparkSession, tables: Tables, config: BuildConfig = BuildConfig()) -> DataFrame:
    """Numbered samples of all tables, after row cap, size gate and length filter.

    Rows are moved to their place as the tables have them and written as sentences there, once: a sample is several times as wide as its
    row. `idx` is told from their places. The driver sees one count for each dataset.
    """
    seed, precision, cap = config.random_seed, config.serializer.numeric_precision, config.retrieval.max_samples_per_dataset
    cuts, placed = None, []
    if cap:
        raw = union_samples(spark, tables, precision)
        cuts = stage_small(sample_cuts(raw, cap, seed), "sample_cuts")[0]
        sampled = [keep_sampled(raw, cuts, seed)]
    else:
        sampled = [df.select(F.lit(spec.key).alias("dataset_key")) for spec, df in tables]
    sizes = {r["dataset_key"]: r["n_rows"] for r in dataset_sizes(reduce(DataFrame.unionByName, sampled)).collect()} if sampled else {}
    for position, (spec, df) in enumerate(tables):
        if sizes.get(spec.key, 0) < config.min_samples:
            continue
        rows = project_samples(df, spec, position, precision, carry=[typed_cells(df, spec)])
        rows = length_filter(keep_sampled(rows, cuts, seed) if cap else rows, config.serializer.max_chars)
        rows = place_rows(rows.select("dataset_pos", "dataset_key", "row_id", "cells"), sizes[spec.key], seed)
        placed.append(samples_of_cells(rows, df, spec, position, precision, PLACE))
    if not placed:
        return number_corpus(spark.createDataFrame([], SAMPLE_SCHEMA), seed)
    return number_placed(write_stage(reduce(DataFrame.unionByName, placed), "corpus", codec=WIDE_CODEC))


def retrieval_set(spark: SparkSession, tables: Tables, config: BuildConfig = BuildConfig()) -> RetrievalSet:
    """Corpus, queries, their conditions and their exact matching rows."""
    corpus = retrieval_corpus(spark, tables, config)
    queries, conditions = build_queries(corpus, config.retrieval, config.random_seed)
    qrels = match_anchor(corpus, conditions, config.retrieval.max_conditions)
    return RetrievalSet(corpus, queries, conditions, qrels)


def write_classification(spark: SparkSession, tables: Tables, root: str, config: BuildConfig = BuildConfig()) -> None:
    """Splits as JSON lines and as CSV per dataset, with metadata and totals."""
    samples, cuts = classification_cuts(spark, tables, config)
    store.write_splits(mark_split(samples, cuts, config.random_seed), root)
    written = store.load_splits(spark, root)
    about = spark.createDataFrame([(s.key, s.target, s.data_type) for s, _ in tables],
                                  "dataset_key string, target_column string, data_type string")
    store.write_jsonl(split_metadata(written).join(F.broadcast(about), "dataset_key"), f"{root}/classification_metadata")
    store.write_jsonl(clf_stats(written), f"{root}/classification_stats")
    kept = {r["dataset_key"] for r in cuts.select("dataset_key").distinct().collect()}
    cap = config.classification.max_samples_per_dataset
    for spec, df in tables:
        if spec.key in kept:
            rows = project_samples(df, spec, 0, config.serializer.numeric_precision, with_csv=True)
            rows = sample_per_dataset(rows, cap, config.random_seed)
            rows = mark_split(length_filter(rows, config.serializer.max_chars), cuts, config.random_seed)
            store.write_csv(rows, f"{root}/classification_csv/{spec.key}", ("split",))


def write_retrieval(spark: SparkSession, tables: Tables, root: str, config: BuildConfig = BuildConfig()) -> None:
    """Corpus, queries, ground truth and totals."""
    made = retrieval_set(spark, tables, config)
    store.write_retrieval(root, made.corpus, made.queries, made.conditions, made.qrels)
    store.write_jsonl(retrieval_stats(made.corpus, made.queries), f"{root}/retrieval/stats")


def build(spark: SparkSession, input_root: str, output_root: str, config: BuildConfig = BuildConfig()) -> None:
    """Both sets from a folder tree. Intermediate tables are deleted when both are written."""
    with temporary_stages(spark):
        tables = discovered_tables(spark, input_root, config)
        if tables:
            write_classification(spark, tables, output_root, config)
            write_retrieval(spark, tables, output_root, config)
