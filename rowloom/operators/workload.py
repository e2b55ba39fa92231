"""Generation of the query workload.

An attempt is a row: it draws a seed row and columns, turns the seed's cells into conditions, and is
accepted if enough corpus rows match. Attempts do not depend on each other, so whole ranges of them
are evaluated at once; the accepted ones are the first `target` in attempt order, as if they had been
tried one by one.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowloom.config import RetrievalConfig
from rowloom.functions import values as V
from rowloom.functions.draws import draw_below, draw_int, draw_unit, seed_hash
from rowloom.operators.cells import pool_tables
from rowloom.operators.index import block_index, conjunction_counts
from rowloom.operators.match import CONDITION_SCHEMA
from rowloom.session import WIDE_CODEC, join_small, stage_small, write_stage

QUERY_TYPES = ["numeric", "categorical", "mixed"]
ATTEMPTS_PER_QUERY = 50
FIRST_RATE = 0.4
SPARE_ATTEMPTS = 50
POOL_BLOCKS = 1024


def quota_rows(config: RetrievalConfig) -> list[tuple[str, int, int]]:
    """(query_type, num_conditions, target): the total is spread evenly, the first counts take the rest."""
    rows = []
    for query_type in QUERY_TYPES:
        counts = range(2 if query_type == "mixed" else 1, config.max_conditions + 1)
        for place, n in enumerate(counts):
            share, rest = divmod(config.num_queries_per_type, len(counts))
            rows.append((query_type, n, share + (1 if place < rest else 0)))
    return rows


def query_quota(spark: SparkSession, config: RetrievalConfig, pools: DataFrame) -> DataFrame:
    """Quotas of the query types whose seed pool is not empty."""
    quotas = spark.createDataFrame(quota_rows(config), "query_type string, num_conditions int, target int")
    return quotas.join(F.broadcast(pools.withColumnRenamed("n_rows", "pool_rows")), "query_type")


def pool_blocks(tables: DataFrame) -> DataFrame:
    """(query_type, block, width, pool_start, pool_end, first_idx): where pool numbers lie in the corpus.

    The pool of a type is the sequence of its tables: those with only that kind of column first, then
    those with both. Each table is listed under every block of pool numbers it touches, which makes
    the lookup of a pool number an equi-join.
    """
    per_type = []
    for query_type in QUERY_TYPES:
        if query_type == "mixed":
            member = F.col("has_numeric") & F.col("has_categorical")
        else:
            member = F.col(f"has_{query_type}")
        per_type.append(tables.filter(member).withColumn("query_type", F.lit(query_type)))
    listed = reduce(DataFrame.unionByName, per_type)
    both = (F.col("has_numeric") & F.col("has_categorical")).cast("int")
    group = Window.partitionBy("query_type")
    running = group.orderBy(both, "dataset_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    listed = listed.withColumn("pool_end", F.sum("n_rows").over(running)) \
        .withColumn("pool_start", F.col("pool_end") - F.col("n_rows")) \
        .withColumn("width", F.ceil(F.sum("n_rows").over(group) / F.lit(POOL_BLOCKS)).cast("bigint"))
    first = F.floor(F.col("pool_start") / F.col("width")).cast("bigint")
    last = F.floor((F.col("pool_end") - 1) / F.col("width")).cast("bigint")
    return listed.select(
        "query_type", F.explode(F.sequence(first, last)).alias("block"), "width", "pool_start", "pool_end", "first_idx")


def _draw(seed: int, *purpose: Column) -> Column:
    return seed_hash(seed, F.col("query_type"), F.col("num_conditions"), F.col("attempt"), *purpose)


def attempts(quotas: DataFrame, seed: int) -> DataFrame:
    """One row per attempt first..last of each quota, with its pool number and condition counts."""
    listed = quotas.withColumn("attempt", F.explode(F.sequence("first", "last")))
    spread = listed.repartition("query_type", "num_conditions", "attempt")
    numeric = F.when(F.col("query_type") == "numeric", F.col("num_conditions")) \
        .when(F.col("query_type") == "categorical", F.lit(0)) \
        .otherwise(1 + draw_int(_draw(seed, F.lit("mix"))) % F.greatest(F.col("num_conditions") - 1, F.lit(1)))
    return spread.withColumn("pool_no", draw_below(_draw(seed, F.lit("seed")), F.col("pool_rows"))) \
        .withColumn("n_numeric", numeric.cast("int")) \
        .withColumn("n_categorical", F.col("num_conditions") - F.col("n_numeric"))


def seed_rows(tried: DataFrame, blocks: DataFrame, corpus: DataFrame) -> DataFrame:
    """Attach the cells of the drawn corpus row to each attempt."""
    widths = blocks.select("query_type", "width").distinct()
    placed = tried.join(F.broadcast(widths), "query_type") \
        .withColumn("block", F.floor(F.col("pool_no") / F.col("width")).cast("bigint")).drop("width")
    located = join_small(placed, blocks.drop("width"), ["query_type", "block"])
    located = located.filter((F.col("pool_no") >= F.col("pool_start")) & (F.col("pool_no") < F.col("pool_end")))
    located = located.withColumn("idx", F.col("first_idx") + F.col("pool_no") - F.col("pool_start"))
    located = located.select("query_type", "num_conditions", "attempt", "n_numeric", "n_categorical", "idx")
    return join_small(corpus.select("idx", "nums", "cats"), located, ["idx"])


def chosen_cells(seeded: DataFrame, seed: int) -> DataFrame:
    """The drawn columns of each attempt: as many present cells of each kind as it asks for.

    Within an attempt the columns are ordered by a digest and the first ones are taken; a row has as
    many cells as its table has columns, so the groups are small.
    """
    keep = ["query_type", "num_conditions", "attempt"]
    nums = seeded.filter(F.col("n_numeric") > 0).select(
        *keep, F.col("n_numeric").alias("_wanted"), F.lit("numeric").alias("type"),
        F.explode("nums").alias("field", "num"), F.lit(None).cast("string").alias("str"),
    ).filter(F.col("num").isNotNull())
    cats = seeded.filter(F.col("n_categorical") > 0).select(
        *keep, F.col("n_categorical").alias("_wanted"), F.lit("categorical").alias("type"),
        F.explode("cats").alias("field", "str"), F.lit(None).cast("double").alias("num"),
    ).filter(F.col("str").isNotNull())
    order = Window.partitionBy(*keep, "type").orderBy(_draw(seed, F.lit("col"), F.col("type"), F.col("field")), "field")
    ranked = nums.unionByName(cats).withColumn("_place", F.row_number().over(order))
    return ranked.filter(F.col("_place") <= F.col("_wanted"))


def numeric_condition(field: Column, value: Column, seed: int, precision: int) -> tuple[Column, Column]:
    """(operator, threshold) drawn around a value.

    A range is set off from the value by 5 to 50 percent of its size plus a hundredth, so that the
    seed row itself matches.
    """
    # Relative margin between 0.05 and 0.5, absolute margin 0.01.
    choice = draw_int(_draw(seed, F.lit("op"), field)) % 3
    operator = F.when(choice == 0, F.lit("==")).when(choice == 1, F.lit(">")).otherwise(F.lit("<"))
    margin = F.abs(value) * (0.05 + 0.45 * draw_unit(_draw(seed, F.lit("margin"), field))) + 0.01
    raw = F.when(choice == 0, value).when(choice == 1, value - margin).otherwise(value + margin)
    return operator, V.round_half_even(raw, precision)


def candidate_conditions(chosen: DataFrame, seed: int, precision: int = 2) -> DataFrame:
    """(query_type, num_conditions, attempt, pos, field, type, operator, num, str) of complete attempts."""
    operator, threshold = numeric_condition(F.col("field"), F.col("num"), seed, precision)
    is_numeric = F.col("type") == "numeric"
    conds = chosen.withColumn("operator", F.when(is_numeric, operator).otherwise(F.lit("=="))) \
        .withColumn("_threshold", F.when(is_numeric, threshold))
    keys = ["query_type", "num_conditions", "attempt"]
    order = Window.partitionBy(*keys).orderBy(F.col("type").desc(), "_place")
    conds = conds.withColumn("pos", F.row_number().over(order)) \
        .withColumn("_found", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    complete = conds.filter(F.col("_found") == F.col("num_conditions"))
    return complete.select(*keys, "pos", "field", "type", "operator", F.col("_threshold").alias("num"), "str")


def candidate_key() -> Column:
    return F.concat_ws("|", "query_type", "num_conditions", "attempt")


def _next_range(target: int, done: int, accepted: int) -> int:
    """Attempts to add so that the rest of a quota is likely to be filled at the rate seen so far."""
    left = target - accepted
    rate = FIRST_RATE if done == 0 else max(accepted / done, 1 / ATTEMPTS_PER_QUERY)
    return min(math.ceil(left / rate * 1.2) + SPARE_ATTEMPTS, target * ATTEMPTS_PER_QUERY - done)


def build_queries(corpus: DataFrame, config: RetrievalConfig = RetrievalConfig(), seed: int = 42,
                  index: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(queries, conditions) of the accepted attempts.

    The block index of the corpus is written once, unless a written `index` is given; a round reads it once, and the rows its attempts draw. Runs rounds of attempts until every quota is filled or its budget is spent. The driver sees one
    count per quota and round, nothing else.
    """
    spark = corpus.sparkSession
    tables, _ = stage_small(pool_tables(corpus), "pool_tables")
    blocks, _ = stage_small(pool_blocks(tables), "pool_blocks")
    index = write_stage(block_index(corpus), "block_index", codec=WIDE_CODEC) if index is None else index
    pools = blocks.groupBy("query_type").agg(F.max("pool_end").alias("pool_rows"))
    pool_rows = {r["query_type"]: r["pool_rows"] for r in pools.collect()}
    quotas = {(t, n): target for t, n, target in quota_rows(config) if t in pool_rows and target > 0}
    done = dict.fromkeys(quotas, 0)
    accepted = dict.fromkeys(quotas, 0)
    rounds = []
    while True:
        ask = [(t, n, done[t, n] + 1, done[t, n] + more, pool_rows[t]) for (t, n), target in quotas.items()
               if accepted[t, n] < target and (more := _next_range(target, done[t, n], accepted[t, n])) > 0]
        if not ask:
            break
        schema = "query_type string, num_conditions int, first bigint, last bigint, pool_rows bigint"
        tried = attempts(spark.createDataFrame(ask, schema), seed)
        chosen = chosen_cells(seed_rows(tried, blocks, corpus), seed)
        conds = candidate_conditions(chosen, seed, config.numeric_precision)
        conds = write_stage(conds.withColumn("query_id", candidate_key()), "candidates")
        for t, n, _, last, _ in ask:
            done[t, n] = last
        if conds.isEmpty():
            continue
        rounds.append(write_stage(accepted_conditions(index, conds, config), "found"))
        per_quota = rounds[-1].filter(F.col("pos") == 1).groupBy("query_type", "num_conditions").count().collect()
        for r in per_quota:
            accepted[r["query_type"], r["num_conditions"]] += r["count"]
    if not rounds:
        return _empty_queries(spark)
    return number_queries(reduce(DataFrame.unionByName, rounds), quotas, config.numeric_precision)


def accepted_conditions(index: DataFrame, conds: DataFrame, config: RetrievalConfig) -> DataFrame:
    """Conditions of the candidates that match enough rows, with `num_matches`, and `n_rows` of every equality (null for ranges).

    Candidates and their distinct equalities are counted in one scan of the block index.
    """
    equal = (F.col("type") == "categorical") | (F.col("operator") == "==")
    parts = ["field", "type", "operator", "num", "str"]
    single = F.concat(F.lit("="), F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in parts])))
    keyed = conds.withColumn("_single", F.when(equal, single))
    singles = keyed.filter(equal).dropDuplicates(["_single"]).select(F.col("_single").alias("query_id"), *parts)
    counts = write_stage(conjunction_counts(index, conds.select("query_id", *parts).unionByName(singles)), "counts")
    found = join_small(keyed, counts.filter(F.col("num_matches") >= config.min_matches), ["query_id"])
    rows = counts.select(F.col("query_id").alias("_single"), F.col("num_matches").alias("n_rows"))
    return join_small(found, rows, ["_single"], "left").drop("_single")


def number_queries(found: DataFrame, quotas: dict[tuple[str, int], int], precision: int = 2) -> tuple[DataFrame, DataFrame]:
    """Keep the first `target` accepted attempts of each quota, number them per type and write them out."""
    spark = found.sparkSession
    limits = spark.createDataFrame([(t, n, q) for (t, n), q in quotas.items()],
                                   "query_type string, num_conditions int, target int")
    heads = found.filter(F.col("pos") == 1).select("query_type", "num_conditions", "attempt", "num_matches")
    by_attempt = Window.partitionBy("query_type", "num_conditions").orderBy("attempt")
    heads = heads.withColumn("_rank", F.row_number().over(by_attempt)) \
        .join(F.broadcast(limits), ["query_type", "num_conditions"]).filter(F.col("_rank") <= F.col("target"))
    by_type = Window.partitionBy("query_type").orderBy("num_conditions", "attempt")
    heads = heads.withColumn(
        "query_id", F.format_string("retrieval_%s_%06d", F.col("query_type"), F.row_number().over(by_type)))
    keys = ["query_type", "num_conditions", "attempt"]
    conds = join_small(found.drop("query_id", "num_matches"), heads.select(*keys, "query_id", "num_matches"), keys)
    conds, _ = stage_small(conds.withColumn("_text", V.condition_text(
        F.col("field"), F.col("operator"), F.col("num"), F.col("str"), precision)), "conditions")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "_text"))), lambda c: c["_text"])
    queries = conds.groupBy("query_id", "query_type", "num_conditions", "num_matches").agg(
        V.query_text(texts).alias("query_text"))
    return (
        queries.select(F.lit("retrieval").alias("task"), "query_id", "query_text", "query_type", "num_conditions", "num_matches"),
        conds.select("query_id", "pos", "field", "type", "operator", "num", "str", "n_rows"),
    )


def _empty_queries(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    queries = spark.createDataFrame(
        [], "task string, query_id string, query_text string, query_type string, num_conditions int, num_matches bigint")
    return queries, spark.createDataFrame([], CONDITION_SCHEMA)


def query_quota_report(queries: DataFrame, quotas: DataFrame) -> DataFrame:
    """Generated and missing queries per (type, number of conditions)."""
    made = queries.groupBy("query_type", "num_conditions").agg(F.count(F.lit(1)).alias("generated"))
    return quotas.select("query_type", "num_conditions", "target").join(made, ["query_type", "num_conditions"], "left") \
        .withColumn("generated", F.coalesce("generated", F.lit(0).cast("bigint"))) \
        .withColumn("shortfall", F.col("target") - F.col("generated"))
