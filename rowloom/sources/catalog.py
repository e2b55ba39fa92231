"""Discovery of datasets in a folder tree of CSV tables with sidecar files."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.functions import values as V
from rowloom.sources.tables import DatasetSpec

# Fixed values: (benchmark, second level or None for any, folder levels above the files,
# task type, data type, sub benchmark).
LAYOUT = [
    ("grinsztajn", "cat_clf", 3, "clf", "cat", "cat_clf"),
    ("grinsztajn", "cat_reg", 3, "reg", "cat", "cat_reg"),
    ("grinsztajn", "num_clf", 3, "clf", "num", "num_clf"),
    ("grinsztajn", "num_reg", 3, "reg", "num", "num_reg"),
    ("openml_cc18", None, 2, "clf", "mixed", ""),
    ("openml_ctr23", None, 2, "reg", "mixed", ""),
    ("unipredict", None, 3, "clf", "mixed", ""),
]
FEATURE_FILE = "feature_list.jsonl"
FEATURE_SCHEMA = "name string, kind string, is_target boolean, _bad string"


def layout_pattern(root: str, benchmarks: list[str] | None = None) -> str:
    """Path pattern of the dataset folders that the layout allows, level by level, for all or some benchmarks."""
    levels = ["/".join([benchmark, second or "*", *["*"] * (depth - 2)]) for benchmark, second, depth, *_ in LAYOUT if not benchmarks or benchmark in benchmarks]
    return f"{escaped_path(root)}/{{{','.join(levels)}}}"


def escaped_path(path: str) -> str:
    """The path itself as a pattern."""
    return re.sub(r"([{}*?,\[\]\\])", r"\\\1", path.rstrip("/"))


def list_files(spark: SparkSession, root: str, benchmarks: list[str] | None = None) -> DataFrame:
    """(path, rel): every file in a dataset folder of the layout; other folders are not listed, and contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    try:
        listed = reader.load(layout_pattern(root, benchmarks))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "path string, rel string")
    return listed.select("path", _relative(F.col("path"), root).alias("rel"))


def _relative(path: Column, root: str) -> Column:
    bare = re.sub(r"^[a-z0-9]+:/*(?=/)", "", root.rstrip("/"))
    return F.regexp_extract(path, re.escape(bare) + r"/(.*)$", 1)


def dataset_folders(files: DataFrame, benchmarks: list[str] | None = None) -> DataFrame:
    """Files placed by the layout: adds folder, file, benchmark, task type and so on."""
    spark = files.sparkSession
    layout = spark.createDataFrame(
        [row for row in LAYOUT if not benchmarks or row[0] in benchmarks],
        "benchmark string, second string, depth int, task_type string, data_type string, sub_benchmark string")
    parts = F.split("rel", "/")
    placed = files.withColumn("benchmark", parts[0]).join(F.broadcast(layout), "benchmark")
    placed = placed.filter(F.col("second").isNull() | (parts[1] == F.col("second")))
    folder = F.array_join(F.slice(parts, F.lit(1), F.col("depth")), "/")
    inner = F.array_join(F.slice(parts, F.col("depth") + 1, F.greatest(F.size(parts) - F.col("depth"), F.lit(0))), "/")
    owner = F.when(F.col("benchmark") == "unipredict", parts[1]).otherwise(F.lit(""))
    return placed.filter(F.size(parts) > F.col("depth")).select(
        "path", "benchmark", "sub_benchmark", "task_type", "data_type", owner.alias("owner"),
        folder.alias("folder"), inner.alias("file"))


def discover_datasets(spark: SparkSession, root: str, benchmarks: list[str] | None = None) -> DataFrame:
    """Catalog: one row per dataset folder with a CSV table, a YAML file, a feature list and a target.

    The first CSV by name counts. The YAML file of the same name is preferred, else the first one.
    Each of the three may also be a folder of part files, as Spark writes them.
    """
    files = dataset_folders(list_files(spark, root, benchmarks), benchmarks)
    about = ["folder", "benchmark", "sub_benchmark", "owner", "task_type", "data_type"]
    table = F.regexp_extract("file", r"^([^/]+)\.csv(/part-[^/]*)?$", 1)
    csv = files.withColumn("name", table).filter(F.col("name") != "") \
        .withColumn("csv_path", F.regexp_replace("path", r"(\.csv)/part-[^/]*$", "$1")) \
        .groupBy(*about).agg(F.min_by("name", "file").alias("name"), F.min_by("csv_path", "file").alias("csv_path"))
    stem = F.regexp_extract("file", r"^([^/]+)\.yaml(/part-[^/]*)?$", 1)
    yaml = files.withColumn("stem", stem).filter(F.col("stem") != "").select(
        "folder", F.col("path").alias("yaml_path"), "stem")
    yaml = csv.join(yaml, "folder").groupBy("folder").agg(
        F.coalesce(F.min(F.when(F.col("stem") == F.col("name"), F.col("yaml_path"))), F.min("yaml_path")).alias("yaml_path"))
    lists = f"{layout_pattern(root, benchmarks)}/{FEATURE_FILE}"
    targets = resolve_targets(features_scan(spark, root, lists))
    return csv.join(yaml, "folder").join(targets, "folder") \
        .withColumn("dataset_key", V.dataset_key(F.col("benchmark"), F.col("sub_benchmark"),
                                                 F.concat_ws("/", F.nullif("owner", F.lit("")), "name")))


FEATURES = "folder string, pos int, name string, kind string, is_target boolean"


def features_scan(spark: SparkSession, root: str, lists: str | None = None) -> DataFrame:
    """(folder, pos, name, kind, is_target) of all feature lists, or of those a path pattern names; a list with a broken line is left out."""
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"{{{FEATURE_FILE},part-*.txt}}")
    try:
        texts = reader.text(lists or root, wholetext=True)
    except AnalysisException as e:
        if lists is None or e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], FEATURES)
    rel = _relative(F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B")), root)
    lines = texts.select(
        F.regexp_extract(rel, rf"^(.*)/{re.escape(FEATURE_FILE)}(/part-[^/]*)?$", 1).alias("folder"),
        F.posexplode(F.split(F.col("value"), r"\r?\n")).alias("pos", "line"))
    lines = lines.filter((F.col("folder") != "") & (F.trim("line") != ""))
    parsed = lines.withColumn("f", F.from_json("line", FEATURE_SCHEMA, {"columnNameOfCorruptRecord": "_bad"}))
    broken = parsed.filter(F.col("f._bad").isNotNull()).select("folder").distinct()
    return parsed.join(broken, "folder", "left_anti").select(
        "folder", "pos", F.col("f.name").alias("name"), F.coalesce("f.kind", F.lit("category")).alias("kind"),
        F.coalesce("f.is_target", F.lit(False)).alias("is_target"))


def resolve_targets(features: DataFrame) -> DataFrame:
    """(folder, target, features): first feature marked as target; folders without one are left out."""
    target = F.min_by(F.when(F.col("is_target"), F.col("name")), F.when(F.col("is_target"), F.col("pos")))
    listed = F.array_sort(F.collect_list(F.struct("pos", "name", "kind", "is_target")))
    return features.groupBy("folder").agg(target.alias("target"), listed.alias("features")) \
        .filter(F.coalesce("target", F.lit("")) != "")


def column_kinds(columns: DataFrame, features: DataFrame) -> DataFrame:
    """(folder, column, kind): two-valued kinds of a table's columns, without the target.

    `columns` is (folder, column); columns the feature list does not name are categorical.
    """
    named = features.select("folder", F.col("name").alias("column"), F.col("kind").alias("_kind"))
    targets = resolve_targets(features).select("folder", F.col("target").alias("column"))
    return columns.join(targets, ["folder", "column"], "left_anti").join(named, ["folder", "column"], "left") \
        .select("folder", "column", V.column_kind(F.col("_kind")).alias("kind"))


def catalog_counts(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("benchmark").agg(F.count(F.lit(1)).alias("n_datasets"))


def specs(catalog: DataFrame) -> list[DatasetSpec]:
    """Dataset descriptions in catalog order.

    A plan over tables of different schemas needs each schema on the driver; this is one row of names
    per dataset, no data.
    """
    order = {row[:2]: i for i, row in enumerate((b, s) for b, _, _, _, _, s in LAYOUT)}
    rows = sorted(catalog.collect(), key=lambda r: (order.get((r["benchmark"], r["sub_benchmark"]), len(order)), r["folder"]))
    return [DatasetSpec(name=r["name"], benchmark=r["benchmark"], sub_benchmark=r["sub_benchmark"], owner=r["owner"],
                        task_type=r["task_type"], data_type=r["data_type"], target=r["target"],
                        kinds={f["name"]: f["kind"] for f in r["features"]}, csv_path=r["csv_path"]) for r in rows]
