"""Training corpus pipeline: documents in, a cleaned and mixed corpus out.

Each stage gets the documents its predecessor kept, and what it returns is written as Parquet and read again. Removed: toxic documents,
all but one of each group of near-duplicates (fingerprints of 4-word shingles, at most 4 bits apart), repeated 50-word passages, documents with
benchmark items. The last stage takes the documents of the mix and adds how often each is taken. Stages that pass texts to Python ask the session for small batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rowloom.llm import decontaminate, mixing, simhash, substrings, toxicity
from rowloom.llm.frames import bound_batches, table
from rowloom.session import delete_folder, scratch_path, temporary_stages


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    lexicon = toxicity.learn_lexicon(toxicity.training_docs(docs), toxicity.training_docs(table(spark, sf_dir, "labels")))
    return toxicity.keep_civil(docs, lexicon)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return simhash.keep_one(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return substrings.remove_repeats(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs, table(spark, sf_dir, "labels"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", drop_repeated_passages),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

# Fingerprints cannot be expressed in SQL; tests compare every stage with plain Python or SQL of its own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed corpus. A stage's intermediate tables are deleted when it is written, its result when the next stage is."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        with temporary_stages(spark):
            made = stage(spark, docs, sf_dir)
            made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
        if before:
            delete_folder(spark, before)
        before = path
    return docs
