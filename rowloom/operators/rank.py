"""Exact ranks and cuts inside groups of any size.

A window over a whole group would put the group into one task. Here rows are ordered by a random
digest, so the leading digits split every group into even buckets: counting the buckets (partial
aggregation, no row moves) gives each bucket's place in the group, and only the inside of one bucket
is ever ordered in a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowloom.session import join_bounded, join_small, stage_small

BUCKET_DIGITS = 3
BUCKET_ROWS = 1_000_000
MOST_DIGITS = 16
SORTED_ROWS = 250_000    # rows that one task orders, about
TASK_ROWS = 125_000      # rows that one task places, about
PLACE_BUCKET = 16_384    # rows of one bucket of placed rows, at most about


def digits_for(rows: int) -> int:
    """Leading digits that keep the buckets of even one group of this size within BUCKET_ROWS."""
    digits = BUCKET_DIGITS
    while rows > BUCKET_ROWS * 16**digits:
        digits += 1
    return digits


def place_digits(rows: int) -> int:
    """Leading digits that leave at most about PLACE_BUCKET rows of a group in one bucket, so that many small groups have few buckets."""
    digits = 0
    while digits < MOST_DIGITS and rows > PLACE_BUCKET * 16**digits:
        digits += 1
    return digits


def _with_bucket(df: DataFrame, digest: str, digits: int) -> DataFrame:
    return df.withColumn("_bucket", F.substring(digest, 1, digits))


def bucket_profile(df: DataFrame, keys: list[str], digest: str, digits: int = BUCKET_DIGITS) -> DataFrame:
    """(keys, _bucket, _n, _before, _total): rows of each bucket, rows in earlier buckets, group size."""
    return _profile(_with_bucket(df.select(*keys, digest), digest, digits), keys)


def _profile(bucketed: DataFrame, keys: list[str]) -> DataFrame:
    counts = bucketed.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*keys)
    earlier = group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counts.withColumn("_before", F.sum("_n").over(earlier) - F.col("_n")).withColumn(
        "_total", F.sum("_n").over(group)
    )


def group_cut(df: DataFrame, keys: list[str], digest: str, row_id: str, size: Column,
              digits: int = BUCKET_DIGITS) -> DataFrame:
    """(keys, _total, _cut_digest, _cut_id): the last row inside the first `size` rows of each group.

    `size` is an expression over `_total`. Groups whose size is 0 get no row. Only the bucket that
    holds the cut is ordered, and only on (digest, row_id); as long as it has more than BUCKET_ROWS rows, it
    is counted by further digits first.
    """
    profile = bucket_profile(df, keys, digest, digits).withColumn("_size", size)
    cut_bucket = profile.filter((F.col("_before") < F.col("_size")) & (F.col("_size") <= F.col("_before") + F.col("_n")))
    cut_bucket = cut_bucket.select(*keys, "_bucket", "_n", "_total", (F.col("_size") - F.col("_before")).alias("_left"))
    narrow = df.select(*keys, digest, row_id)
    while True:
        cut_bucket, fits = stage_small(cut_bucket, "cut_bucket")
        inside = join_bounded(_with_bucket(narrow, digest, digits), cut_bucket.drop("_n"), [*keys, "_bucket"], fits)
        largest = cut_bucket.agg(F.max("_n")).first()[0] or 0
        if largest <= BUCKET_ROWS or digits >= MOST_DIGITS:
            break
        digits = min(digits + BUCKET_DIGITS, MOST_DIGITS)
        finer = inside.drop("_bucket").withColumn("_bucket", F.substring(digest, 1, digits))
        counts = finer.groupBy(*keys, "_bucket", "_total", "_left").agg(F.count(F.lit(1)).alias("_n"))
        earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        counts = counts.withColumn("_before", F.sum("_n").over(earlier) - F.col("_n"))
        counts = counts.filter((F.col("_before") < F.col("_left")) & (F.col("_left") <= F.col("_before") + F.col("_n")))
        cut_bucket = counts.withColumn("_left", F.col("_left") - F.col("_before")).select(*keys, "_bucket", "_n", "_total", "_left")
    order = Window.partitionBy(*keys).orderBy(digest, row_id)
    return (
        inside.withColumn("_rank", F.row_number().over(order))
        .filter(F.col("_rank") == F.col("_left"))
        .select(*keys, "_total", F.col(digest).alias("_cut_digest"), F.col(row_id).alias("_cut_id"))
    )


def up_to_cut(digest: str, row_id: str) -> Column:
    """Is the row at or before its group's cut?"""
    return (F.col(digest) < F.col("_cut_digest")) | (
        (F.col(digest) == F.col("_cut_digest")) & (F.col(row_id) <= F.col("_cut_id"))
    )


def places(df: DataFrame, digest: Column, row_id: str, rows: int) -> DataFrame:
    """Add `_bucket` and `_nth`, the 1-based place in its bucket in the order (digest, row_id), to the rows of one group of at most `rows` rows.

    The rows are shuffled once, to as many tasks as keep what one of them orders within its memory. Digests do not move, they are made again
    behind the shuffle; identities that are MD5 digests are packed.
    """
    packed = F.when(F.col(row_id).rlike("^[0-9a-f]{32}$"), F.unhex(row_id))
    names = df.columns
    moved = df.select(*[c for c in names if c != row_id], packed.alias("_packed"), F.when(packed.isNull(), F.col(row_id)).alias("_plain"),
                      F.substring(digest, 1, place_digits(rows)).alias("_bucket"))
    back = moved.repartition(-(-rows // TASK_ROWS), "_bucket").withColumn(row_id, F.coalesce(F.lower(F.hex("_packed")), "_plain")).select(*names, "_bucket")
    order = Window.partitionBy("_bucket").orderBy("_digest", row_id)
    return back.withColumn("_digest", digest).withColumn("_nth", F.row_number().over(order)).drop("_digest")


def _offsets(profile: DataFrame, group: str) -> DataFrame:
    """(group, _bucket, _offset): rows in earlier groups and in earlier buckets of the group."""
    totals = profile.groupBy(group).agg(F.max("_total").alias("_total"))
    running = Window.orderBy(group).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = totals.withColumn("_start", F.sum("_total").over(running) - F.col("_total"))
    return profile.join(starts.select(group, "_start"), group).select(
        group, "_bucket", (F.col("_start") + F.col("_before")).alias("_offset")
    )


def positions(placed: DataFrame, group: str) -> DataFrame:
    """Turn the `_bucket` and `_nth` of a written table of placed rows into `idx`, their 0-based position in the order (group, digest, row_id).

    Offsets are counted on these columns and broadcast, so the rows need not be written again.
    """
    located = join_small(placed, _offsets(_profile(placed, [group]), group), [group, "_bucket"])
    return located.withColumn("idx", F.col("_offset") + F.col("_nth") - 1).drop("_bucket", "_nth", "_offset")


def dense_position(df: DataFrame, group: str, digest: str, row_id: str) -> DataFrame:
    """Add `idx`: 0-based position in the order (group, digest, row_id), without a global window.

    Offsets come from two small prefix sums (groups, then buckets inside a group); the rows are
    shuffled once, by (group, bucket), to as many tasks as keep what one of them orders within its memory.
    """
    rows = df.count()
    digits = digits_for(rows)
    offsets = _offsets(bucket_profile(df, [group], digest, digits), group)
    bucketed = join_small(_with_bucket(df, digest, digits), offsets, [group, "_bucket"])
    tasks = -(-rows // SORTED_ROWS)
    if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        bucketed = bucketed.repartition(tasks, group, "_bucket")
    order = Window.partitionBy(group, "_bucket").orderBy(digest, row_id)
    return bucketed.withColumn("idx", F.col("_offset") + F.row_number().over(order) - 1).drop("_bucket", "_offset")


def _numbered_in_task(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Add `_nth`, the 1-based place of a row among those of its task with equal values in the columns `names`."""
    seen: dict[tuple, int] = {}
    for batch in batches:
        parts = [batch.column(n).dictionary_encode() for n in names]
        code = np.zeros(batch.num_rows, np.int64)
        for part in parts:
            code = code * (len(part.dictionary) + 1) + part.indices.fill_null(len(part.dictionary)).to_numpy(zero_copy_only=False)
        _, first, group = np.unique(code, return_index=True, return_inverse=True)
        order = np.argsort(group, kind="stable")
        starts = np.searchsorted(group[order], np.arange(len(first)))
        nth = np.empty(batch.num_rows, np.int64)
        nth[order] = np.arange(1, batch.num_rows + 1) - np.repeat(starts, np.bincount(group, minlength=len(first)))
        keys = [tuple(part[int(i)].as_py() for part in parts) for i in first]
        nth += np.array([seen.get(key, 0) for key in keys], np.int64)[group]
        for key, n in zip(keys, np.bincount(group, minlength=len(first)).tolist(), strict=True):
            seen[key] = seen.get(key, 0) + n
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nth)], [*batch.schema.names, "_nth"])


def read_positions(rows: DataFrame, group: list[str], file: str, block: str) -> DataFrame:
    """Add `position`, the 1-based place of a row in its group in the order in which files hold the rows: (file, block, place in the block).

    `rows` are read from files, with the file and the start of the block that each was read from and nothing shuffled since. A task reads a block from its
    beginning to its end, so rows are numbered as they are read; only the counts of the blocks are ordered, and the rows stay where they are.
    """
    place = [*group, file, block]
    counts = rows.groupBy(*place).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*group).orderBy(file, block).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = counts.select(*place, (F.sum("_n").over(earlier) - F.col("_n")).alias("_offset"))
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + ", _nth bigint"
    numbered = rows.mapInArrow(lambda batches: _numbered_in_task(batches, place), schema)
    return join_small(numbered, offsets, place).withColumn("position", F.col("_offset") + F.col("_nth")).drop("_offset", "_nth")
