"""Sampling, gates and stratified splits over canonical samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.config import BuildConfig
from rowloom.functions.draws import seed_hash
from rowloom.operators.rank import group_cut, up_to_cut
from rowloom.session import WIDE_CODEC, join_small, write_stage


def row_draw(seed: int) -> Column:
    """The draw of a row, 64 random bits as hex digits."""
    return F.substring(seed_hash(seed, F.col("dataset_key"), F.col("row_id")), 1, 16)


def with_draw(samples: DataFrame, seed: int, name: str = "_draw") -> DataFrame:
    """Add the row's draw; a written table already carries it as draw_{seed}."""
    if f"draw_{seed}" in samples.columns:
        return samples.withColumn(name, F.col(f"draw_{seed}"))
    return samples.withColumn(name, row_draw(seed))


def sample_cuts(samples: DataFrame, max_samples: int, seed: int = 42) -> DataFrame:
    """(dataset_key, _cut_digest, _cut_id): last drawn row of every dataset."""
    size = F.least(F.col("_total"), F.lit(max_samples))
    return group_cut(with_draw(samples, seed, "_draw"), ["dataset_key"], "_draw", "row_id", size).drop("_total")


def keep_sampled(rows: DataFrame, cuts: DataFrame, seed: int = 42) -> DataFrame:
    marked = join_small(with_draw(rows, seed, "_draw"), cuts, ["dataset_key"])
    return marked.filter(up_to_cut("_draw", "row_id")).select(*rows.columns)


def sample_per_dataset(samples: DataFrame, max_samples: int | None, seed: int = 42) -> DataFrame:
    """At most max_samples rows of each dataset, drawn without replacement.

    The cut of each dataset is found on (draw, row_id) alone; rows are then kept or dropped where
    they are, without moving.
    """
    return keep_sampled(samples, sample_cuts(samples, max_samples, seed), seed) if max_samples else samples


def dataset_sizes(samples: DataFrame) -> DataFrame:
    return samples.groupBy("dataset_key").agg(F.count(F.lit(1)).alias("n_rows"))


def gate_min_samples(samples: DataFrame, min_samples: int = 100) -> DataFrame:
    """Drop datasets with fewer rows than min_samples."""
    large = dataset_sizes(samples).filter(F.col("n_rows") >= min_samples).select("dataset_key")
    return join_small(samples, large, ["dataset_key"], "left_semi")


def length_filter(samples: DataFrame, max_chars: int) -> DataFrame:
    """Drop rows whose text is longer than max_chars characters."""
    size = F.col("n_chars") if "n_chars" in samples.columns else F.length("text")
    return samples.filter(size <= max_chars)


def build_samples(samples: DataFrame, config: BuildConfig = BuildConfig(), max_samples: int | None = None) -> DataFrame:
    """Row cap, then size gate, then length filter.

    The rows are serialised once, into a written table that also keeps their length and draw. Later
    passes (counts, ranks, the length filter itself) read a few of its columns.
    """
    sampled = sample_per_dataset(samples, max_samples, config.random_seed)
    gated = gate_min_samples(sampled, config.min_samples)
    seed = config.random_seed
    timed = with_draw(gated.withColumn("n_chars", F.length("text")), seed, f"draw_{seed}")
    return length_filter(write_stage(timed, "samples", codec=WIDE_CODEC), config.serializer.max_chars)


def class_counts(samples: DataFrame) -> DataFrame:
    return samples.groupBy("dataset_key", "label").agg(F.count(F.lit(1)).alias("n_rows"))


def label_stats(samples: DataFrame) -> DataFrame:
    """Classes, rows, rows of the rarest class and classes per row, for each dataset.

    Counts by (dataset, label) first, so neither a hot label nor a target with countless labels
    gathers in one task.
    """
    per_class = class_counts(samples)
    return per_class.groupBy("dataset_key").agg(
        F.count(F.lit(1)).alias("num_labels"),
        F.sum("n_rows").alias("num_samples"),
        F.min("n_rows").alias("rarest"),
        (F.count(F.lit(1)) / F.sum("n_rows")).alias("label_ratio"),
    )


def gate_classes(stats: DataFrame, max_num_labels: int = 50, max_label_ratio: float = 0.1) -> DataFrame:
    """Verdict per dataset; the tests apply in this order."""
    verdict = (
        F.when(F.col("num_labels") < 2, "single_class")
        .when(F.col("num_labels") > max_num_labels, "too_many_classes")
        .when(F.col("label_ratio") > max_label_ratio, "label_ratio")
        .when(F.col("rarest") < 2, "rare_class")
        .otherwise("kept")
    )
    return stats.withColumn("verdict", verdict)


def keep_classifiable(samples: DataFrame, config: BuildConfig = BuildConfig()) -> DataFrame:
    """Rows of the datasets that pass all class gates."""
    c = config.classification
    verdicts = gate_classes(label_stats(samples), c.max_num_labels, c.max_label_ratio)
    kept = verdicts.filter(F.col("verdict") == "kept").select("dataset_key")
    return join_small(samples, kept, ["dataset_key"], "left_semi")


def class_cuts(samples: DataFrame, train_ratio: float = 0.8, seed: int = 42) -> DataFrame:
    """(dataset_key, label, _cut_digest, _cut_id): last training row of every class.

    The training share is rounded down, but leaves at least one row on either side.
    """
    drawn = with_draw(samples, seed, "_draw")
    share = F.greatest(F.lit(1), F.floor(F.col("_total") * F.lit(train_ratio)))
    cut = group_cut(drawn, ["dataset_key", "label"], "_draw", "row_id", F.least(share, F.col("_total") - 1))
    return cut.drop("_total")


def mark_split(rows: DataFrame, cuts: DataFrame, seed: int = 42) -> DataFrame:
    """Add `split`, train or test, to rows with dataset_key, label and row_id."""
    marked = join_small(with_draw(rows, seed, "_draw"), cuts, ["dataset_key", "label"])
    split = F.when(up_to_cut("_draw", "row_id"), F.lit("train")).otherwise(F.lit("test"))
    return marked.withColumn("split", split).select(*rows.columns, "split")


def stratified_split(samples: DataFrame, train_ratio: float = 0.8, seed: int = 42) -> DataFrame:
    """Add `split`: a random train share of every class.

    Classes must have two rows or more. Cuts are found on (draw, row_id) alone and broadcast; the
    rows stay where they are.
    """
    return mark_split(samples, class_cuts(samples, train_ratio, seed), seed)


def split_class_counts(split_samples: DataFrame) -> DataFrame:
    return split_samples.groupBy("dataset_key", "split", "label").agg(F.count(F.lit(1)).alias("n_rows"))


def split_metadata(split_samples: DataFrame) -> DataFrame:
    """One row per dataset: sorted class list, split sizes and class distributions.

    Datasets have passed the class gates, so the lists and maps are short.
    """
    about = ["dataset_key", "benchmark", "sub_benchmark", "dataset", "task_type"]
    counts = split_samples.groupBy(*about, "label").agg(*[
        F.count(F.when(F.col("split") == s, 1)).alias(s) for s in ("train", "test")])
    entries = {s: F.sort_array(F.collect_list(F.when(F.col(s) > 0, F.struct("label", s)))) for s in ("train", "test")}
    return counts.groupBy(*about).agg(
        F.sort_array(F.collect_list("label")).alias("label_values"),
        F.count(F.lit(1)).alias("num_labels"),
        F.sum("train").alias("train_samples"), F.sum("test").alias("test_samples"),
        F.map_from_entries(entries["train"]).alias("train_label_distribution"),
        F.map_from_entries(entries["test"]).alias("test_label_distribution"))


def clf_stats(samples: DataFrame) -> DataFrame:
    """Datasets and rows, over all (benchmark null) and per benchmark."""
    sizes = samples.groupBy("benchmark", "dataset_key").agg(F.count(F.lit(1)).alias("n_rows"))
    return sizes.groupingSets([[F.col("benchmark")], []], F.col("benchmark")).agg(
        F.count(F.lit(1)).alias("datasets"), F.sum("n_rows").alias("samples"))


def retrieval_stats(corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """Corpus size and number of queries, over all (query_type null) and per type. Without any query there is the row over all, with 0."""
    size = corpus.agg(F.count(F.lit(1)).alias("corpus_size"))
    total = queries.agg(F.count(F.lit(1)).alias("num_queries")).select(F.lit(None).cast("string").alias("query_type"), "num_queries")
    per_type = queries.groupBy("query_type").agg(F.count(F.lit(1)).alias("num_queries"))
    counts = total.unionByName(per_type)
    return counts.withColumn("_one", F.lit(1)).join(F.broadcast(size.withColumn("_one", F.lit(1))), "_one").drop("_one")
