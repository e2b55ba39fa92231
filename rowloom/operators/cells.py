"""The corpus, and the corpus as a long table of cells: the schema-free form all tables share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.operators.rank import dense_position, places, positions
from rowloom.operators.samples import row_draw, with_draw

PLACE = ("_bucket", "_nth")   # what `place_rows` adds


def number_corpus(samples: DataFrame, seed: int = 42) -> DataFrame:
    """Add `idx`, the dense 0-based position: datasets in catalog order, rows in drawn order."""
    drawn = with_draw(samples, seed, "_draw")
    return dense_position(drawn, "dataset_pos", "_draw", "row_id").select(*samples.columns, "idx")


def place_rows(rows: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Add `_bucket` and `_nth` to the rows of one dataset, at most n; `number_placed` tells `idx` from them once all rows are written."""
    return places(rows, row_draw(seed), "row_id", n)


def number_placed(written: DataFrame) -> DataFrame:
    """Add `idx` to placed rows, as `number_corpus` does."""
    return positions(written, "dataset_pos")


def corpus_table(numbered: DataFrame) -> DataFrame:
    """The published corpus columns."""
    return numbered.select("idx", "text", "label", "dataset", "benchmark")


def corpus_counts(numbered: DataFrame) -> DataFrame:
    """Rows per dataset and (dataset_key null) over the whole corpus."""
    return numbered.groupingSets([[F.col("dataset_key")], []], F.col("dataset_key")).agg(
        F.count(F.lit(1)).alias("n_rows"))


def numeric_cells(corpus: DataFrame, *carry: str) -> DataFrame:
    """(idx, column, num): present numeric cells."""
    return corpus.select("idx", *carry, F.explode("nums").alias("column", "num")).filter(F.col("num").isNotNull())


def categorical_cells(corpus: DataFrame, *carry: str) -> DataFrame:
    """(idx, column, str): present categorical cells."""
    return corpus.select("idx", *carry, F.explode("cats").alias("column", "str")).filter(F.col("str").isNotNull())


def cells(corpus: DataFrame) -> DataFrame:
    """(idx, column, kind, num FLOAT, str): every present cell of the corpus.

    The same column name may be numeric in one table and categorical in another; (column, kind) is
    the key.
    """
    nums = numeric_cells(corpus).select(
        "idx", "column", F.lit("numeric").alias("kind"), F.col("num").cast("float").alias("num"),
        F.lit(None).cast("string").alias("str"))
    cats = categorical_cells(corpus).select(
        "idx", "column", F.lit("categorical").alias("kind"), F.lit(None).cast("float").alias("num"), "str")
    return nums.unionByName(cats)


def cat_index(corpus: DataFrame) -> DataFrame:
    """Rows per (column, value)."""
    return categorical_cells(corpus).groupBy("column", "str").agg(F.count(F.lit(1)).alias("n_rows"))


def num_index(corpus: DataFrame) -> DataFrame:
    """Row count and value range per numeric column, in single precision."""
    value = F.col("num").cast("float")
    return numeric_cells(corpus).groupBy("column").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(value).alias("min_value"), F.max(value).alias("max_value"))


def index_stats(corpus: DataFrame) -> DataFrame:
    """Number of searchable columns of each kind."""
    columns = cells(corpus).groupBy("kind", "column").agg(F.count(F.lit(1)).alias("_n"))
    return columns.groupBy("kind").agg(F.count(F.lit(1)).alias("n_columns"))


def seed_pools(corpus: DataFrame) -> DataFrame:
    """(query_type, n_rows): rows a query of each type can start from.

    A row belongs to a pool by its table's column kinds, whether or not its own cells are present.
    """
    per_table = pool_tables(corpus)
    types = F.array(
        F.when(F.col("has_numeric"), F.lit("numeric")),
        F.when(F.col("has_categorical"), F.lit("categorical")),
        F.when(F.col("has_numeric") & F.col("has_categorical"), F.lit("mixed")),
    )
    rows = per_table.select(F.explode(F.array_compact(types)).alias("query_type"), "n_rows")
    return rows.groupBy("query_type").agg(F.sum("n_rows").alias("n_rows"))


def pool_tables(corpus: DataFrame) -> DataFrame:
    """(dataset_pos, first_idx, n_rows, has_numeric, has_categorical) for every table of the corpus."""
    return corpus.groupBy("dataset_pos").agg(
        F.min("idx").alias("first_idx"),
        F.count(F.lit(1)).alias("n_rows"),
        F.bool_or(F.size("nums") > 0).alias("has_numeric"),
        F.bool_or(F.size("cats") > 0).alias("has_categorical"),
    )
