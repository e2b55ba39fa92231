"""Source tables: description of a dataset, CSV scan, row identity and the canonical sample form.

Tables of different schemas never meet as they are. Each is projected, in one pass over its columns,
to the canonical sample: text, label, identity, and two maps with the numeric and categorical cells.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.functions import values as V
from rowloom.session import join_bounded, stage_small, write_stage

INT_TEXT = r"^\s*[+-]?\d+\s*$"
FLOAT_TEXT = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|inf|Inf|INF|infinity|Infinity)\s*$"
# Cell texts that a CSV reader takes for truth values.
BOOL_TEXTS = ["True", "TRUE", "true", "False", "FALSE", "false"]
ROW_ID = "_row_id"
COPY_CHUNK = 100_000


@dataclass(frozen=True)
class DatasetSpec:
    """One source table and its role: where it belongs, its target and its column kinds."""

    name: str
    benchmark: str
    target: str
    kinds: Mapping[str, str] = field(default_factory=dict)
    sub_benchmark: str = ""
    task_type: str = "clf"
    data_type: str = "mixed"
    id_columns: tuple[str, ...] = ()
    columns: tuple[str, ...] | None = None
    csv_path: str | None = None
    owner: str = ""

    @property
    def key(self) -> str:
        return "/".join(p for p in (self.benchmark, self.sub_benchmark, self.owner, self.name) if p)

    def feature_columns(self, df: DataFrame) -> list[str]:
        """Every column but the target and the identity, in table order or in the declared order."""
        if self.columns is not None:
            return list(self.columns)
        hidden = {self.target, ROW_ID, *(c for c in self.id_columns if c not in self.kinds)}
        return [c for c in df.columns if c not in hidden]

    def column_kinds(self, df: DataFrame) -> dict[str, str]:
        """Column -> numeric or categorical; undeclared columns are categorical."""
        return {
            c: "numeric" if self.kinds.get(c) in V.NUMERIC_KINDS else "categorical"
            for c in self.feature_columns(df)
        }


def spread(df: DataFrame) -> DataFrame:
    """Share a scan of few input splits out over the idle cores; larger scans stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df


def split_quotes(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, quotes, broken): quotes in each split of a CSV, and whether a record of it spans lines (a line has an unpaired quote)."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return _lines(spark, path).groupBy("file", "block").agg(F.sum(quotes).alias("quotes"), F.bool_or(quotes % 2 == 1).alias("broken"))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


class _Records:
    """Puts the lines of one split together to records: a line starts a record if an even number of quotes stands before it."""

    def __init__(self, file: str, block: int, odd: bool) -> None:
        self.file, self.block, self.odd = file, block, odd
        self.first = block == 0
        self.lines: list[str] = []
        self.kind = CONTINUED if odd else WHOLE
        self.made: list[tuple] = []

    def take(self, line: str, quotes: int) -> None:
        self.lines.append(line)
        self.odd ^= quotes % 2 == 1
        if not self.odd:
            self._emit(self.kind)

    def _emit(self, kind: int) -> None:
        self.made.append((self.file, self.block, kind, self.first and kind != CONTINUED, "\n".join(self.lines)))
        self.first &= kind == CONTINUED
        self.lines, self.kind = [], WHOLE

    def end(self) -> None:
        """What is open at the end of the split goes on in the next one."""
        if self.lines:
            self._emit(OPENED if self.kind == WHOLE else CONTINUED)


WHOLE, CONTINUED, OPENED = 0, 1, 2  # a whole record, a piece that goes on from the split before, a piece that starts a record
RECORDS = "file string, block bigint, kind int, first boolean, value string"


def csv_records(spark: SparkSession, path: str, splits: DataFrame) -> DataFrame:
    """(file, first, value): records of a CSV as text, however many lines they span; `first` marks the first one of a file.

    The quotes before each split are a prefix sum over the splits of its file, so every split is read on its own; the few
    pieces of records that lie across splits are put together afterwards. `splits` comes from `split_quotes`.
    """
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begin = splits.select("file", "block", (F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2 == 1).alias("odd"))
    lines = _lines(spark, path).join(F.broadcast(begin), ["file", "block"])  # one row for each split; lines stay in their order

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None

        def made(done: bool) -> Iterator[pa.RecordBatch]:
            if now is not None:
                if done:
                    now.end()
                if now.made:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*now.made, strict=True), types, strict=True)], names)
                    now.made = []

        names, types = ["file", "block", "kind", "first", "value"], [pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string()]
        for batch in batches:
            quotes = pc.count_substring(batch.column("value"), '"').to_pylist()
            for file, block, line, odd, n in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "value", "odd")), quotes, strict=True):
                if now is None or (file, block) != (now.file, now.block):
                    yield from made(True)
                    now = _Records(file, block, odd)
                now.take(line, n)
            yield from made(False)
        yield from made(True)

    found = write_stage(lines.mapInArrow(run, RECORDS), "records")
    order = Window.partitionBy("file").orderBy("block", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pieces = found.filter(F.col("kind") != WHOLE).withColumn("record", F.sum((F.col("kind") == OPENED).cast("int")).over(order))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "kind", "value"))), lambda p: p["value"]), "\n")
    stitched = pieces.groupBy("file", "record").agg(F.bool_or("first").alias("first"), joined.alias("value"))
    return found.filter(F.col("kind") == WHOLE).select("file", "first", "value").unionByName(stitched.select("file", "first", "value"))


def scan_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with missing-cell texts as null and column types inferred from all remaining cells.

    Files are split over tasks, also where records span lines. Quotes are paired, as CSV writers make them. Records are parsed
    once, into a written table of texts; typing and everything later reads columns of that.
    """
    reader = spark.read.option("header", True).option("inferSchema", False).option("escape", '"')
    splits = write_stage(split_quotes(spark, path), "splits")
    if splits.filter("broken").isEmpty():
        raw = reader.csv(path)
    else:
        names = [c.removesuffix("\r") for c in reader.option("multiLine", True).csv(path).columns]
        fields = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
        records = csv_records(spark, path, splits).filter("NOT first")
        text = F.regexp_replace("value", "\r$", "")
        parsed = F.from_csv(text, fields.simpleString()[7:-1].replace(":", " "), {"escape": '"', "multiLine": "true"})
        raw = records.filter(text != "").select(parsed.alias("r")).select(*[F.col(f"r.c{i}").alias(n) for i, n in enumerate(names)])
    raw = raw.select(*[V.without_na_tokens(F.col(f"`{c}`")).alias(c) for c in raw.columns])
    return cast_inferred(write_stage(raw, "parsed"))


def _all_match(col: Column, test: Column) -> Column:
    return F.coalesce(F.bool_and(F.when(col.isNotNull(), test)), F.lit(False))


def cast_inferred(raw: DataFrame) -> DataFrame:
    """Narrow text columns to BIGINT, DOUBLE or BOOLEAN where every present cell allows it.

    One aggregation over the table decides for all columns; its result is a single row. A column
    without any present cell is DOUBLE, and so is a column of whole numbers with a missing cell.
    """
    checks = [F.count(F.lit(1)).alias("rows")]
    for i, name in enumerate(raw.columns):
        c = F.col(f"`{name}`")
        checks += [
            F.count(c).alias(f"n{i}"),
            _all_match(c, c.rlike(INT_TEXT) & F.trim(c).try_cast("bigint").isNotNull()).alias(f"i{i}"),
            _all_match(c, c.rlike(FLOAT_TEXT)).alias(f"f{i}"),
            _all_match(c, c.isin(BOOL_TEXTS)).alias(f"b{i}"),
        ]
    found = raw.agg(*checks).first()
    out = []
    for i, name in enumerate(raw.columns):
        c = F.col(f"`{name}`")
        if found[f"n{i}"] == 0:
            typed = F.lit(None).cast("double")
        elif found[f"i{i}"]:
            typed = F.trim(c).cast("bigint" if found[f"n{i}"] == found["rows"] else "double")
        elif found[f"f{i}"]:
            typed = F.trim(c).cast("double")
        elif found[f"b{i}"]:
            typed = c.cast("boolean")
        else:
            typed = c
        out.append(typed.alias(name))
    return raw.select(*out)


def with_row_id(df: DataFrame, id_columns: Sequence[str] = ()) -> DataFrame:
    """Add a unique text identity.

    A declared key gives it directly. Without a key, it is the digest of the row's content and a copy number. Only digests are shuffled to
    find the repeated ones; other rows stay where they are. Rows with a repeated digest are equal, so they are counted (partial aggregation
    collapses any number of copies) and listed again with their numbers.
    """
    if len(id_columns) == 1:
        return df.withColumn(ROW_ID, F.col(id_columns[0]).cast("string"))
    if id_columns:
        return df.withColumn(ROW_ID, row_digest(df, id_columns))
    names = df.columns
    digested = df.withColumn(ROW_ID, row_digest(df, names))
    repeated = digested.groupBy(ROW_ID).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(ROW_ID)
    repeated, fits = stage_small(repeated, "repeated")
    single = join_bounded(digested, repeated, [ROW_ID], fits, "left_anti").withColumn(ROW_ID, F.concat(F.col(ROW_ID), F.lit("#1")))
    several = join_bounded(digested, repeated, [ROW_ID], fits, "left_semi")
    counted = several.groupBy(ROW_ID, *[F.col(f"`{c}`") for c in names]).agg(F.count(F.lit(1)).alias("_copies"))
    few = counted.filter(F.col("_copies") <= COPY_CHUNK).withColumn(
        "_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies"))))
    starts = F.sequence(F.lit(1).cast("bigint"), F.col("_copies"), F.lit(COPY_CHUNK).cast("bigint"))
    many = counted.filter(F.col("_copies") > COPY_CHUNK).withColumn("_start", F.explode(starts))
    many = many.repartition("_start", ROW_ID).withColumn("_copy", F.explode(F.sequence(
        F.col("_start"), F.least(F.col("_start") + (COPY_CHUNK - 1), F.col("_copies"))))).drop("_start")
    listed = few.unionByName(many).withColumn(ROW_ID, F.concat_ws("#", ROW_ID, "_copy"))
    columns = [*[F.col(f"`{c}`") for c in names], ROW_ID]
    return single.select(*columns).unionByName(listed.select(*columns))


def row_digest(df: DataFrame, columns: Sequence[str]) -> Column:
    """MD5 over the cells in JSON form, which tells missing from empty and keeps neighbouring cells apart."""
    return F.md5(F.to_json(F.struct(*[F.col(f"`{c}`").cast("string").alias(f"c{i}") for i, c in enumerate(columns)]), {"ignoreNullFields": "false"}))


def promote_integers(df: DataFrame) -> DataFrame:
    """In a table of numbers only, with at least one DOUBLE column, read every column as DOUBLE."""
    types = [f.dataType for f in df.schema.fields]
    if types and all(V.is_number(t) for t in types) and any(V.is_float(t) for t in types):
        return df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in df.columns])
    return df


def load_table(spark: SparkSession, spec: DatasetSpec) -> DataFrame:
    """Typed rows of a discovered dataset."""
    return promote_integers(scan_csv(spark, spec.csv_path))


def project_samples(df: DataFrame, spec: DatasetSpec, position: int = 0, precision: int = 2,
                    with_csv: bool = False, carry: Sequence[Column] = ()) -> DataFrame:
    """Canonical samples of one table, as a single projection.

    Numeric cells go to `nums`, categorical ones to `cats`; a missing cell stays in its map as null,
    so the maps also carry the table's column kinds. `with_csv` adds the row as the CSV sink writes it. `carry` comes along.
    """
    if ROW_ID not in df.columns:
        df = with_row_id(df, spec.id_columns)
    kinds = spec.column_kinds(df)
    types = {f.name: f.dataType for f in df.schema.fields}
    features = [(c, F.col(f"`{c}`"), types[c]) for c in kinds]
    # Rounding in a projection of its own keeps the generated code small enough to be compiled well.
    doubles = [c for c in kinds if V.is_float(types[c])]
    dates = [c for c in kinds if isinstance(types[c], (T.DateType, T.TimestampType, T.TimestampNTZType))]
    df = df.select("*", *[V.round_half_even(F.col(f"`{c}`"), precision).alias(f"_once_{c}") for c in doubles],
                   *[F.col(f"`{c}`").cast("string").alias(f"_once_{c}") for c in dates])
    once = {c: F.col(f"`_once_{c}`") for c in doubles + dates}
    rounded = [(c, once.get(c, col), dtype) for c, col, dtype in features]
    features = [(c, once[c] if c in dates else col, dtype) for c, col, dtype in features]
    nums, cats = [], []
    for name, col, dtype in features:
        if kinds[name] == "numeric":
            nums += [F.lit(name), V.numeric_cell(col, dtype)]
        else:
            cats += [F.lit(name), V.plain_text(col, dtype)]
    num_map = F.create_map(*nums).cast("map<string,double>") if nums else F.create_map().cast("map<string,double>")
    cat_map = F.create_map(*cats).cast("map<string,string>") if cats else F.create_map().cast("map<string,string>")
    target = F.col(f"`{spec.target}`")
    label = V.label_text(target, types[spec.target])
    csv = [F.struct(*[V.csv_number(col, dtype, None).alias(name) for name, col, dtype in rounded],
                    label.alias(spec.target)).alias("csv")] if with_csv else []
    return df.select(
        F.lit(position).alias("dataset_pos"),
        F.lit(spec.key).alias("dataset_key"),
        F.lit(spec.name).alias("dataset"),
        F.lit(spec.benchmark).alias("benchmark"),
        F.lit(spec.sub_benchmark).alias("sub_benchmark"),
        F.lit(spec.task_type).alias("task_type"),
        F.col(ROW_ID).alias("row_id"),
        V.serialize_row(rounded, None).alias("text"),
        label.alias("label"),
        num_map.alias("nums"),
        cat_map.alias("cats"),
        *csv,
        *carry,
    )


def typed_cells(df: DataFrame, spec: DatasetSpec) -> Column:
    """`cells`, the columns of a row that its sample is made of, as its table has them: the form in which rows are moved."""
    return F.struct(*[F.col(f"`{c}`") for c in dict.fromkeys([*spec.feature_columns(df), spec.target])]).alias("cells")


def samples_of_cells(rows: DataFrame, df: DataFrame, spec: DatasetSpec, position: int = 0, precision: int = 2,
                     carry: Sequence[str] = ()) -> DataFrame:
    """Canonical samples of rows (row_id, cells, ...) that were taken from `df`; columns in `carry` come along."""
    held = rows.select("cells.*", F.col("row_id").alias(ROW_ID), F.struct(*carry).alias("_row_carry"))
    declared = replace(spec, columns=tuple(spec.feature_columns(df)))
    return project_samples(held, declared, position, precision, carry=[F.col(f"_row_carry.{c}") for c in carry])


SAMPLE_SCHEMA = T.StructType([
    T.StructField("dataset_pos", T.IntegerType()),
    *[T.StructField(c, T.StringType()) for c in
      ("dataset_key", "dataset", "benchmark", "sub_benchmark", "task_type", "row_id", "text", "label")],
    T.StructField("nums", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("cats", T.MapType(T.StringType(), T.StringType())),
])


def union_samples(spark: SparkSession, tables: Sequence[tuple[DatasetSpec, DataFrame]], precision: int = 2) -> DataFrame:
    """Canonical samples of all tables, in catalog order."""
    parts = [project_samples(df, spec, pos, precision) for pos, (spec, df) in enumerate(tables)]
    if not parts:
        return spark.createDataFrame([], SAMPLE_SCHEMA)
    return reduce(DataFrame.unionByName, parts)


def write_dataset(df: DataFrame, spec: DatasetSpec, folder: str) -> None:
    """Lay out a table as a dataset folder: CSV, YAML and feature list, each written by Spark."""
    spark = df.sparkSession
    names = [*spec.feature_columns(df), spec.target]
    df.select(*names).write.option("header", True).option("escape", '"').option("emptyValue", "") \
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).mode("overwrite").csv(f"{folder}/{spec.name}.csv")
    lines = [json.dumps({"name": c, "kind": spec.kinds.get(c, "category"), "is_target": c == spec.target}) for c in names]
    spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1) \
        .write.mode("overwrite").text(f"{folder}/feature_list.jsonl")
    spark.createDataFrame([(f"name: {spec.name}",)], "value string").coalesce(1) \
        .write.mode("overwrite").text(f"{folder}/{spec.name}.yaml")
