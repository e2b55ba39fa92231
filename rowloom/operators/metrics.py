"""Ranking metrics from hits(query_id, rank, idx) and judgements: qrels(query_id, idx), or classes of queries and rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowloom.functions.vectors import discount, ideal_gain
from rowloom.operators.match import anchored, condition_width, distinct_counts, row_holds, settled_conditions, usable_conditions
from rowloom.session import join_small

TOP_K = (1, 5, 10, 20, 50, 100)
METRICS = ["recall", "precision", "ndcg", "mrr", "map"]


@dataclass(frozen=True)
class ClassJudgements:
    """Judgements given by classes: a row is relevant to a query with which it shares a class, unless both have the same id.

    `queries` (query_id, class) and `rows` (idx, class) may name several classes for one id; a missing id or class judges nothing. The pairs
    are as many as the square of a class, so they are looked up and counted but never listed.
    """

    queries: DataFrame
    rows: DataFrame

    def listed(self) -> DataFrame:
        """(query_id, idx): the pairs."""
        pairs = self.queries.join(self.rows, "class").filter("query_id <> idx")
        return pairs.select("query_id", "idx").distinct()

    def query_sets(self) -> DataFrame:
        return _class_sets(self.queries, "query_id").withColumnRenamed("_classes", "_asked")

    def row_sets(self) -> DataFrame:
        return _class_sets(self.rows, "idx").withColumnRenamed("_classes", "_held")


def _class_sets(df: DataFrame, name: str) -> DataFrame:
    """One row for each id, with its classes in order."""
    named = df.filter(F.col(name).isNotNull() & F.col("class").isNotNull())
    return named.groupBy(name).agg(F.sort_array(F.collect_set("class")).alias("_classes"))


Judgements = DataFrame | ClassJudgements


def hits_rel(hits: DataFrame, qrels: Judgements) -> DataFrame:
    """Hits with `rel`, 1 when the row is relevant.

    The judgements may be far larger than the hits, so they are reduced to the retrieved pairs first; those given by classes are
    looked up for the two ids of a hit. A judgement that is given twice counts once.
    """
    if isinstance(qrels, ClassJudgements):
        both = join_small(join_small(hits, qrels.query_sets(), ["query_id"], "left"), qrels.row_sets(), ["idx"], "left")
        related = F.arrays_overlap("_asked", "_held") & (F.col("query_id") != F.col("idx"))
        return both.select(*hits.columns, F.coalesce(related, F.lit(False)).cast("int").alias("rel"))
    pairs = hits.select("query_id", "idx")
    found = join_small(qrels.select("query_id", "idx"), pairs, ["query_id", "idx"], "left_semi")
    found = found.dropDuplicates(["query_id", "idx"]).withColumn("rel", F.lit(1))
    return join_small(hits, found, ["query_id", "idx"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))


def hits_rel_by_condition(hits: DataFrame, corpus: DataFrame, conditions: DataFrame) -> DataFrame:
    """Hits with `rel`, 1 when the row itself satisfies all conditions of its query; no table of judgements is needed.

    Only retrieved rows of the corpus are looked at. A row that very many queries retrieve is spread over tasks if it is not broadcast.
    """
    conditions = usable_conditions(settled_conditions(corpus, conditions))
    width = condition_width(conditions)
    if width == 0:
        return hits.withColumn("rel", F.lit(0))
    rows = join_small(corpus.select("idx", "nums", "cats"), hits.select("idx").distinct(), ["idx"], "left_semi")
    there = join_small(hits.select("query_id", "idx").distinct(), rows, ["idx"], spread="query_id")
    held = join_small(there, anchored(conditions, width), ["query_id"]).filter(row_holds(width)).select("query_id", "idx")
    return join_small(hits, held.withColumn("rel", F.lit(1)), ["query_id", "idx"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))


def judged_counts(qrels: Judgements) -> DataFrame:
    """(query_id, num_matches): distinct relevant rows of each query."""
    if isinstance(qrels, ClassJudgements):
        return _counts_by_class(qrels)
    return distinct_counts(qrels).withColumnRenamed("n", "num_matches")


def _counts_by_class(qrels: ClassJudgements) -> DataFrame:
    """Rows with equal sets of classes are counted first, and the sets of queries meet these counts."""
    asked, held = qrels.query_sets(), qrels.row_sets()
    sizes = held.groupBy("_held").agg(F.count(F.lit(1)).alias("_n"))
    sets = asked.select("_asked").distinct()
    met = sets.withColumn("class", F.explode("_asked")).join(sizes.withColumn("class", F.explode("_held")), "class")
    totals = met.select("_asked", "_held", "_n").distinct().groupBy("_asked").agg(F.sum("_n").alias("_rows"))
    own = join_small(asked, held.select(F.col("idx").alias("query_id"), "_held"), ["query_id"], "left")
    own = own.withColumn("_own", F.coalesce(F.arrays_overlap("_asked", "_held"), F.lit(False)).cast("bigint"))
    counted = join_small(own, totals, ["_asked"]).select("query_id", (F.col("_rows") - F.col("_own")).alias("num_matches"))
    return counted.filter("num_matches > 0")


def per_query_metrics(judged: DataFrame, queries: DataFrame, top_k: Sequence[int] = TOP_K) -> DataFrame:
    """(query_id, query_type, num_conditions, k, recall, precision, ndcg, mrr, map).

    `judged` are the hits with `rel`; `queries` carry num_matches, which is taken as it is (`compute_retrieval_metrics` counts it),
    and those without any relevant row are left out. A query whose relevant rows were not retrieved scores 0. A query has at most max(k)
    hits, which bounds its window.
    """
    order = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    relevant = F.col("rel") == 1
    ranked = judged.withColumn("_found", F.sum("rel").over(order)).filter(relevant)
    sums = []
    for k in top_k:
        near = F.col("rank") <= k
        sums += [
            F.sum(F.when(near, F.lit(1))).alias(f"hits{k}"),
            F.min(F.when(near, F.col("rank"))).alias(f"first{k}"),
            F.sum(F.when(near, F.col("_found") / F.col("rank"))).alias(f"gain{k}"),
            F.sum(F.when(near, discount(F.col("rank")))).alias(f"dcg{k}"),
        ]
    per_query = ranked.groupBy("query_id").agg(*sums)
    scored = queries.filter(F.col("num_matches") > 0).select(
        "query_id",
        F.coalesce("query_type", F.lit("unknown")).alias("query_type"),
        F.coalesce("num_conditions", F.lit(0)).alias("num_conditions"),
        "num_matches",
    ).join(per_query, "query_id", "left")
    at_k = F.explode(F.array(*[
        F.struct(F.lit(k).alias("k"), *[F.col(f"{c}{k}").alias(c) for c in ("hits", "first", "gain", "dcg")])
        for k in top_k
    ]))
    long = scored.select("query_id", "query_type", "num_conditions", "num_matches", at_k.alias("m")).select(
        "query_id", "query_type", "num_conditions", "num_matches", "m.*")
    zero = F.lit(0.0)
    return long.select(
        "query_id", "query_type", "num_conditions", "k",
        F.coalesce(F.col("hits") / F.col("num_matches"), zero).alias("recall"),
        F.coalesce(F.col("hits") / F.col("k"), zero).alias("precision"),
        F.coalesce(F.col("dcg") / ideal_gain(F.col("num_matches"), F.col("k")), zero).alias("ndcg"),
        F.coalesce(F.lit(1.0) / F.col("first"), zero).alias("mrr"),
        F.coalesce(F.col("gain") / F.col("num_matches"), zero).alias("map"),
    )


def metric_cube(per_query: DataFrame) -> DataFrame:
    """(metric, k, breakdown, query_type, num_conditions, n_queries, mean, std).

    Breakdowns: overall, by_type, by_num_conditions, by_type_conditions; the population standard
    deviation is given overall only.
    """
    values = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS]))
    long = per_query.select("query_type", "num_conditions", "k", values.alias("v")).select(
        "v.metric", "k", "query_type", "num_conditions", "v.value")
    m, k, t, n = (F.col(c) for c in ("metric", "k", "query_type", "num_conditions"))
    cube = long.groupingSets([[m, k, t, n], [m, k, t], [m, k, n], [m, k]], m, k, t, n).agg(
        F.grouping("query_type").alias("_no_type"), F.grouping("num_conditions").alias("_no_count"),
        F.count(F.lit(1)).alias("n_queries"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    whole = (F.col("_no_type") == 1) & (F.col("_no_count") == 1)
    breakdown = F.when(whole, "overall").when(F.col("_no_count") == 1, "by_type") \
        .when(F.col("_no_type") == 1, "by_num_conditions").otherwise("by_type_conditions")
    return cube.select(
        "metric", "k", breakdown.alias("breakdown"), "query_type", "num_conditions", "n_queries", "mean",
        F.when(whole, F.col("std")).alias("std"))


def compute_retrieval_metrics(queries: DataFrame, hits: DataFrame, qrels: Judgements,
                              top_k: Sequence[int] = TOP_K) -> DataFrame:
    """Metric table of a search result. The number of relevant rows is counted from the judgements, whatever the queries say."""
    queries = queries.drop("num_matches").join(judged_counts(qrels), "query_id", "left")
    return metric_cube(per_query_metrics(hits_rel(hits, qrels), queries, top_k))
