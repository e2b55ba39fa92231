"""The operators of this folder as queries over whole test tables."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.llm import alignment, conversations, decontaminate, language, licenses, minhash, mixing, revisits, search, simhash, substrings, tokens, toxicity
from rowloom.llm.frames import id_bucket, table

TOKENIZER = "piece_bpe_32k.model"
BYTE_TOKENIZER = "byte_bpe_50k.json"
TOP_K = 10
TURN_GROUP, MOST_TURNS = 20, 3  # conversations of 20 consecutive ids share up to 3 opening turns


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = mixing.quality_weights(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return mixing.mix(sized).select("doc_id", "size", "source_size", "target", "taken")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_digests(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits("code").alias("fingerprint"), "component_id")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = Path(public_tokenizers.path(TOKENIZER)).read_bytes()
    return tokens.token_counts(table(spark, sf_dir, "documents"), model)


def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    queries = docs.filter("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "text")
    return search.search_top_k(docs, queries, TOP_K).withColumn("score", F.round("score", 6))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("score", F.round("score", 6))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lexicon = toxicity.learn_lexicon(toxicity.training_docs(docs), toxicity.training_docs(table(spark, sf_dir, "labels")))
    scored = toxicity.score_toxicity(docs, lexicon)
    return scored.select("doc_id", (id_bucket("doc_id", 3) == 1).alias("held_out"), "score", "predicted", "n_matches")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.classify_language(docs, language.learn_dictionaries(docs))
    return found.select("doc_id", (id_bucket("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "rejected")


def op10_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = revisits.resolve_revisits(revisits.records_of_pages(table(spark, sf_dir, "pages")))
    listed = F.array_join(F.transform(F.sort_array(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "; ")
    return found.select("record_id", "url_key", "captured_at", "response_id", "response_at", "outcome", listed.alias("headers"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = [Path(public_tokenizers.path(name)).read_bytes() for name in (BYTE_TOKENIZER, TOKENIZER)]
    return alignment.align(table(spark, sf_dir, "documents"), *files)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversations.numbered(table(spark, sf_dir, "conversations"))
    return conversations.prefix_trie(*conversations.spliced(turns, TURN_GROUP, MOST_TURNS))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_license_scan, op2_mix_sources, op3_substring_dedup, op4_simhash, op5_token_counts, op6_topk_search,
                            op7_decontamination, op8_toxicity, op9_language_id, op10_revisits, op11_alignment, op12_prefix_trie, op13_minhash)}
