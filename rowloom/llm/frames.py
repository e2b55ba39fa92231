"""Helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.session import join_bounded, stage_small

WORD_BYTES = r"[^\x20\x09-\x0D]+"
BATCH_BYTES = 4 * 2**20  # Arrow batches that jobs over whole texts ask for
HOT_ROWS = 1_000         # a key with no more rows is never hot
HOT_KEYS = 10_000        # no more keys than these are hot, whatever the input is


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Let Spark pass texts to Python workers in batches of about BATCH_BYTES (a longer text is a batch of its own).

    This is a setting of the session, for jobs that run several operators in it: a worker and its executor each hold a
    batch and a copy of it, for every task at a time.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def id_bucket(column: str, n: int) -> Column:
    """crc32 of an id as text, modulo n; an absent id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % n


def map_batches(df: DataFrame, step: Callable[[pa.RecordBatch], dict | None], schema: str) -> DataFrame:
    """Apply a function of one Arrow batch that returns columns by name (or nothing) to every batch."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = step(batch) if batch.num_rows else None
            if made is not None:
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in (made[n] for n in names)], names)

    return df.mapInArrow(run, schema)


def fresh_names(docs: DataFrame, *names: str) -> list[str]:
    """The names with as many underscores in front as it takes to differ from every column of `docs`."""
    taken = {c.lower() for c in docs.columns}

    def free(name: str) -> str:
        while name.lower() in taken:
            name = "_" + name
        return name

    return [free(n) for n in names]


def row_key(text_key: str | None = None) -> Column:
    """What tells documents apart: id and text, as digests of 128 bits together; `text_key` names the xxhash64 of the text, if there is one.

    The key is never null, and an absent id is no id's equal.
    """
    parts = F.struct(F.col("doc_id").isNull(), F.col("doc_id").cast("string"), F.col(text_key) if text_key else F.xxhash64("text"))
    return F.struct(F.xxhash64(F.lit(1), parts).alias("a"), F.xxhash64(F.lit(2), parts).alias("b"))


def match_rows(docs: DataFrame, listed: DataFrame, how: str, values: str | None = None) -> DataFrame:
    """Join `docs` with a list of rows (`row`, made by `row_key`; for a left or inner join also `values`, a column that is added under a name of its own).

    Only the list moves while it is within the size bound. No column of `docs` is touched, whatever its name is; the added column is the last one.
    """
    key, added = fresh_names(docs, "_row", values or "_values")
    staged, fits = stage_small(listed, "rows")
    staged = staged.select(F.col("row").alias(key), *([F.col(values).alias(added)] if values else []))
    joined = join_bounded(docs.withColumn(key, row_key()), staged, [key], fits, how)
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], *([added] if values else []))


def join_counted(big: DataFrame, small: DataFrame, on: list[str], rows: str) -> DataFrame:
    """Inner join with a written table whose keys are unique and whose column `rows` says how many rows of `big` have the key.

    A key with more than a HOT_KEYS-th of all counted rows is hot. There can be no more than HOT_KEYS of these, so they are
    broadcast and their rows stay where they are; all other keys are shuffled. Rows with an absent key match nothing.
    """
    total = small.agg(F.coalesce(F.sum(rows), F.lit(0))).first()[0]
    limit = max(HOT_ROWS, -(-total // HOT_KEYS))
    hot = small.filter(F.col(rows) > limit)
    cold = big.join(small.filter(F.col(rows) <= limit), on)
    if total <= limit or hot.isEmpty():
        return cold
    others = big.join(F.broadcast(hot.select(*on)), on, "left_anti").join(small.filter(F.col(rows) <= limit), on)
    return big.join(F.broadcast(hot), on).unionByName(others)
