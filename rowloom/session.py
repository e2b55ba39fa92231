"""Session settings, the shared folder for written intermediate tables, and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BROADCAST_ROWS = 1_000_000
BROADCAST_CHARS = 128_000_000
SALTS = 64
STAGE_ROW_GROUP = 16 * 2**20
WIDE_CODEC = "zstd"      # for staged tables that hold whole rows


def get_spark(app_name: str = "rowloom", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_own_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it.

    Only a local session, where driver and executors are one process, may fall back to a folder of
    its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _own_folders:
        _own_folders[app] = tempfile.mkdtemp(prefix="rowloom-")
    return _own_folders[app]


_runs: dict[str, list[str]] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new place for a table, in the folder of the innermost run (`temporary_stages`) or else in the shared folder."""
    folder = (_runs.get(spark.sparkContext.applicationId) or [shared_folder(spark)])[-1]
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that this session wrote, wherever its file system is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def temporary_stages(spark: SparkSession) -> Iterator[str]:
    """Delete the tables staged inside at the end. What is needed later must have been written elsewhere by then."""
    path = scratch_path(spark, "run")
    runs = _runs.setdefault(spark.sparkContext.applicationId, [])
    runs.append(path)
    try:
        yield path
    finally:
        runs.remove(path)
        delete_folder(spark, path)


def write_stage(df: DataFrame, name: str, partition_by: tuple[str, ...] = (), codec: str = "snappy", schema: StructType | None = None) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back, under another schema of the same form if one is given.

    Cuts the lineage, survives lost executors, and keeps column pruning for the readers. Small row
    groups let readers split what one task wrote.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.partitionBy(*partition_by).option("parquet.block.size", STAGE_ROW_GROUP).option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(schema or df.schema).parquet(path)


def stage_small(df: DataFrame, name: str = "small", max_rows: int = BROADCAST_ROWS,
                max_chars: int = BROADCAST_CHARS) -> tuple[DataFrame, bool]:
    """Write a table that is normally small, and tell whether it is within the broadcast bounds.

    Writing it once means that measuring it does not compute it twice.
    """
    staged = write_stage(df, name)
    size = staged.agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(F.length(F.to_json(F.struct(*staged.columns))).cast("bigint")), F.lit(0)).alias("chars"),
    ).first()
    return staged, size["rows"] <= max_rows and size["chars"] <= max_chars


def join_bounded(big: DataFrame, small: DataFrame, on: list[str], fits: bool, how: str = "inner",
                 spread: str | None = None, residual: Column | None = None) -> DataFrame:
    """Join a large table with one whose size has been checked.

    If it fits, the small side is broadcast and the large one does not move. If not, both sides are
    shuffled; with `spread` (a column of the large side) an inner join is salted, so that one hot key
    is shared out over many tasks. `residual` is a further condition on the joined row.
    """
    if fits:
        joined = big.join(F.broadcast(small), on, how)
    elif spread is None or how != "inner":
        joined = big.join(small, on, how)
    else:
        salted = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
        copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = salted.join(copies, [*on, "_salt"], how).drop("_salt")
    return joined if residual is None else joined.filter(residual)


def join_small(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner",
               spread: str | None = None, residual: Column | None = None,
               max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Write the small side once, check its size, and join."""
    staged, fits = stage_small(small, max_rows=max_rows)
    return join_bounded(big, staged, on, fits, how, spread, residual)
