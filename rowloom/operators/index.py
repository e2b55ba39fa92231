"""Indexes over the corpus: numeric columns in value order with equi-depth bins, and posting lists per block of rows.

Two written tables serve different questions:

* `value_order` holds every numeric cell in the order (column, value). A column is a range of the files, so a filter on it skips all other
  row groups. Its bins all have the same number of cells, so the cells before a bin need no sum. A range takes whole bins without a
  look at their values and compares inside one bin only (`range_counts`).
* `block_index` has one row per block of corpus rows: for each of its columns the cells in value order and the rows they belong to. It is made
  where the rows are, without a shuffle. Conditions become slices of these arrays, conjunctions become AND of posting bitmaps, and only matches or
  counts leave a task (`match_bitmaps`, `conjunction_counts`). Columns a block lacks cost nothing.

Texts of categorical cells are compared by 128 bits of hashes, which are made before rows are handed to Python.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowloom.functions import values as V
from rowloom.operators.cells import numeric_cells
from rowloom.session import join_small, write_stage

BIN_CELLS = 4096            # cells of one bin of a numeric column
BLOCK_ROWS = 8192           # corpus rows of one block
PROGRAM_CONDITIONS = 500_000  # conditions that one scan of the blocks holds
KEPT_BITMAPS = 4096         # bitmaps a task keeps for one block


# --- numeric columns in value order -------------------------------------------------------------

def _nth_in_column(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add `nth`, the place of a cell among those of its column in this partition; cells come sorted."""
    last, seen = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        name = batch.column("column").dictionary_encode()
        code = name.indices.to_numpy()
        new = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
        nth = np.arange(len(code)) - np.repeat(new, np.diff(np.append(new, len(code))))
        names = name.dictionary.to_pylist()
        if names[code[0]] == last:
            nth[:int(new[1]) if len(new) > 1 else len(code)] += seen
        last, seen = names[code[-1]], int(nth[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nth, pa.int64())], [*batch.schema.names, "nth"])


def value_order(corpus: DataFrame) -> DataFrame:
    """(column, bin, pos, num FLOAT, idx): numeric cells in the order (column, value, idx), `pos` counts from 0 in each column.

    Written in range partitions, however many cells a column has: places are counted inside the partitions, and the cells of a column in
    earlier partitions are added from a table of at most two rows for each partition.
    """
    cells = numeric_cells(corpus).select("column", (F.col("num").cast("float") + F.lit(0).cast("float")).alias("num"), "idx")
    order = ["column", "num", "idx"]
    local = cells.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_nth_in_column, "column string, num float, idx bigint, nth bigint")
    local = write_stage(local.withColumn("part", F.spark_partition_id()), "cells_sorted")
    counts = local.groupBy("column", "part").agg(F.count(F.lit(1)).alias("n"))
    edges = counts.groupBy("part").agg(F.min("column").alias("low"), F.max("column").alias("high"))
    split = edges.select(F.explode(F.array("low", "high")).alias("column")).distinct()
    before = F.sum("n").over(Window.partitionBy("column").orderBy("part")) - F.col("n")
    offsets = counts.join(F.broadcast(split), "column").select("column", "part", before.alias("before")).filter("before > 0")
    placed = local.join(F.broadcast(offsets), ["column", "part"], "left")
    pos = F.col("nth") + F.coalesce("before", F.lit(0))
    placed = placed.select("column", F.floor(pos / BIN_CELLS).cast("bigint").alias("bin"), pos.alias("pos"), "num", "idx")
    return write_stage(placed, "value_order")


def num_blocks(ordered: DataFrame) -> DataFrame:
    """(column, bin, n, lo, hi): cells, least and greatest value of every bin."""
    return ordered.groupBy("column", "bin").agg(F.count(F.lit(1)).alias("n"), F.min("num").alias("lo"), F.max("num").alias("hi"))


def range_counts(ordered: DataFrame, bins: DataFrame, conditions: DataFrame) -> DataFrame:
    """(query_id, pos, n_rows): cells that satisfy each range condition (> or <) of `conditions`, 0 if there is no such column.

    A range is what lies before or behind a cut. Bins and cuts of a column are put in one order, which tells how many bins lie
    before each cut; they are full, so their cells need no sum. The next bin alone is compared with the cut. No pair of cell and condition
    is made outside of it.
    """
    wanted = conditions.filter((F.col("type") == "numeric") & F.col("operator").isin(">", "<")).select(
        "query_id", F.col("pos").alias("place"), F.col("field").alias("column"), "operator", F.col("num").cast("float").alias("cut"))
    valid = wanted.filter("cut IS NOT NULL")
    # bins whose greatest value is below the cut (or, for >, at most the cut) lie before it
    tie = F.when(F.col("operator") == ">", 2).otherwise(0)
    marks = bins.select("column", F.col("hi").alias("cut"), F.lit(1).alias("tie"), F.lit(1).alias("is_bin"))
    both = marks.unionByName(valid.withColumns({"tie": tie, "is_bin": F.lit(0)}), allowMissingColumns=True)
    passed = F.sum("is_bin").over(Window.partitionBy("column").orderBy("cut", "tie").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    cuts = both.withColumn("bin", passed).filter("is_bin = 0").drop("tie", "is_bin")
    totals = bins.groupBy("column").agg(F.sum("n").alias("total"))
    cuts = write_stage(join_small(cuts, totals, ["column"]), "cuts")
    inside = join_small(ordered.select("column", "bin", "num"), cuts, ["column", "bin"])
    before = F.when(F.col("operator") == ">", F.col("num") <= F.col("cut")).otherwise(F.col("num") < F.col("cut"))
    inside = inside.groupBy("query_id", "place").agg(F.sum(before.cast("bigint")).alias("inside"))
    counted = cuts.join(inside, ["query_id", "place"], "left")
    below = F.least(F.col("bin") * BIN_CELLS + F.coalesce("inside", F.lit(0)), F.col("total"))
    counted = counted.select("query_id", "place", F.when(F.col("operator") == ">", F.col("total") - below).otherwise(below).alias("n_rows"))
    found = wanted.select("query_id", "place").join(counted, ["query_id", "place"], "left")
    return found.select("query_id", F.col("place").alias("pos"), F.coalesce("n_rows", F.lit(0)).cast("bigint").alias("n_rows"))


# --- posting lists per block --------------------------------------------------------------------

def _hashes(text: Column) -> list[Column]:
    return [F.xxhash64(F.lit(salt), text) for salt in (1, 2)]


def _sorted_columns(batch: pa.RecordBatch) -> list[dict]:
    """For every column of some corpus rows: its cells in value order and the rows they belong to."""
    made = []
    for kind in ("numeric", "categorical"):
        cells = batch.column(kind)
        offsets = cells.offsets.to_numpy()
        row = np.repeat(np.arange(len(cells)), np.diff(offsets)).astype(np.uint16)
        part = slice(offsets[0], offsets[-1])
        name, items = cells.keys[part].dictionary_encode(), cells.items[part]
        present = np.flatnonzero(items.is_valid().to_numpy(zero_copy_only=False))
        row, code, items = row[present], name.indices.to_numpy()[present], items.take(pa.array(present))
        if kind == "numeric":
            with np.errstate(over="ignore"):
                keys = [items.to_numpy().astype(np.float32)]
        else:
            keys = [items.field(i).to_numpy() for i in (0, 1)]
        order = np.lexsort((*keys[::-1], code))
        cut = np.searchsorted(code[order], np.arange(len(name.dictionary) + 1))
        for n, column in enumerate(name.dictionary.to_pylist()):
            own = order[cut[n]:cut[n + 1]]
            if not len(own):
                continue
            more = keys[1][own].tobytes() if len(keys) > 1 else b""
            made.append({"name": column, "kind": kind, "keys": keys[0][own].tobytes(), "more": more, "rows": row[own].tobytes()})
    return made


def block_index(corpus: DataFrame) -> DataFrame:
    """(ids, columns): one row per block of corpus rows. Nothing is shuffled, and texts do not leave the JVM."""
    hashes = F.transform_values("cats", lambda _, v: F.when(v.isNotNull(), F.struct(*[h.alias(n) for h, n in zip(_hashes(v), "ab", strict=True)])))
    rows = corpus.select("idx", F.col("nums").alias("numeric"), hashes.alias("categorical"))
    kind = pa.list_(pa.struct([("name", pa.string()), ("kind", pa.string()), ("keys", pa.binary()), ("more", pa.binary()), ("rows", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                ids = part.column("idx").to_numpy().tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([ids], pa.binary()), pa.array([_sorted_columns(part)], kind)], ["ids", "columns"])

    return rows.mapInArrow(run, "ids binary, columns array<struct<name:string,kind:string,keys:binary,more:binary,rows:binary>>")


class Program:
    """Conjunctions as numbers of distinct conditions, ordered by the column they are about."""

    def __init__(self, table: pa.Table) -> None:
        """`table` has query, field, type, operator, num and the hashes a, b of a categorical value, a row for each condition."""
        name = table["query"].combine_chunks().dictionary_encode()
        self.queries = name.dictionary
        query = name.indices.to_numpy()
        rows = zip(*(table[c].to_pylist() for c in ("field", "type", "operator", "num", "a", "b")), strict=True)
        numbers: dict[tuple, int] = {}
        number = np.array([numbers.setdefault(r, len(numbers)) for r in rows], np.int64)
        self.conditions = list(numbers)
        self.of_column: dict[tuple[str, str], list[int]] = {}
        for n, (field, kind, *_) in enumerate(self.conditions):
            self.of_column.setdefault((field, kind), []).append(n)
        order = np.argsort(query, kind="stable")
        first = np.searchsorted(query[order], np.arange(len(self.queries)))
        place = np.arange(len(order)) - first[query[order]]
        self.slots = np.full((len(self.queries), int(place.max(initial=-1)) + 1), len(self.conditions), np.int64)
        self.slots[query[order], place] = number[order]


class Block:
    """Slices of the sorted cells of one block, for the conditions of a program."""

    def __init__(self, ids: bytes, columns: list[dict], program: Program) -> None:
        self.ids = np.frombuffer(ids, np.int64)
        self.program = program
        self.counts = np.zeros(len(program.conditions) + 1, np.int64)
        self.counts[-1] = len(self.ids)  # an empty slot holds everywhere
        self.rows: dict[int, np.ndarray] = {}
        self.bitmaps: dict[int, np.ndarray] = {}
        for column in columns:
            for n in program.of_column.get((column["name"], column["kind"]), ()):
                rows = np.frombuffer(column["rows"], np.uint16)
                low, high = _numeric_slice(column, program.conditions[n]) if column["kind"] == "numeric" else _equal_slice(column, program.conditions[n])
                if high > low:
                    self.counts[n] = high - low
                    self.rows[n] = rows[low:high]

    def _bitmap(self, condition: int) -> np.ndarray:
        found = self.bitmaps.get(condition)
        if found is None:
            if len(self.bitmaps) >= KEPT_BITMAPS:
                self.bitmaps.clear()
            bits = np.zeros(len(self.ids), bool)
            bits[self.rows[condition]] = True
            found = self.bitmaps[condition] = np.packbits(bits)
        return found

    def matches(self, query: int) -> np.ndarray:
        """Rows of the block that satisfy a query, given that each of its conditions has some."""
        slots = [n for n in self.program.slots[query].tolist() if n < len(self.program.conditions)]
        slots.sort(key=lambda n: self.counts[n])
        rarest = self.rows[slots[0]]
        if len(slots) == 1:
            return rarest
        if len(rarest) * 64 < len(self.ids):  # a short list is looked up in the others' bitmaps
            for n in slots[1:]:
                bits = self._bitmap(n)
                rarest = rarest[(bits[rarest >> 3] >> (7 - (rarest & 7)).astype(np.uint8) & 1).astype(bool)]
            return rarest
        bits = self._bitmap(slots[0])
        for n in slots[1:]:
            bits = bits & self._bitmap(n)
        return np.flatnonzero(np.unpackbits(bits, count=len(self.ids)))

    def alive(self) -> np.ndarray:
        """Queries all of whose conditions hold somewhere in the block."""
        return np.flatnonzero((self.counts[self.program.slots] > 0).all(axis=1)) if len(self.ids) else np.zeros(0, np.int64)


def _numeric_slice(column: dict, condition: tuple) -> tuple[int, int]:
    """Where the condition holds among sorted values; NaN is greater than any number."""
    values, operator, number = np.frombuffer(column["keys"], np.float32), condition[2], condition[3]
    if number is None:
        return 0, 0
    with np.errstate(over="ignore"):
        cut = np.float32(number)
    if operator == ">":
        return int(np.searchsorted(values, cut, "right")), len(values)
    if operator == "<":
        return 0, int(np.searchsorted(values, cut, "left"))
    with np.errstate(invalid="ignore"):
        reach = 2 * V.EQUAL_TOLERANCE + abs(float(cut)) * 2**-20
        low, high = np.searchsorted(values, (np.float32(cut - reach), np.float32(cut + reach)))
        high = int(np.searchsorted(values, np.float32(cut + reach), "right"))
        held = np.flatnonzero(np.abs(values[low:high] - cut) < np.float32(V.EQUAL_TOLERANCE))
    return (int(low) + int(held[0]), int(low) + int(held[-1]) + 1) if len(held) else (0, 0)


def _equal_slice(column: dict, condition: tuple) -> tuple[int, int]:
    first, second = np.frombuffer(column["keys"], np.int64), np.frombuffer(column["more"], np.int64)
    a, b = condition[4], condition[5]
    if a is None:
        return 0, 0
    low, high = np.searchsorted(first, a, "left"), np.searchsorted(first, a, "right")
    inside = second[low:high]
    return int(low + np.searchsorted(inside, b, "left")), int(low + np.searchsorted(inside, b, "right"))


def _programs(conditions: DataFrame) -> Iterator[Program]:
    """Programs of all queries, a bounded number of conditions at a time."""
    kinds = F.when(F.col("type") == "categorical", F.lit("categorical")).otherwise(F.col("type"))
    hashes = [F.when((F.col("type") == "categorical") & F.col("str").isNotNull(), h).alias(n) for h, n in zip(_hashes(F.col("str")), "ab", strict=True)]
    listed = write_stage(conditions.select(F.col("query_id").alias("query"), "field", kinds.alias("type"), "operator", "num", *hashes), "program")
    parts = -(-listed.count() // PROGRAM_CONDITIONS)
    for part in range(parts):
        table = listed.filter(F.pmod(F.xxhash64("query"), F.lit(parts)) == part).toArrow()
        if table.num_rows:
            yield Program(table)


def _scan(index: DataFrame, conditions: DataFrame, schema: str, make: Callable[[Iterator[Block], Program], Iterator[pa.RecordBatch]]) -> DataFrame:
    """Apply every program to every block of a written index."""
    spark = index.sparkSession
    out = spark.createDataFrame([], schema)
    for program in _programs(conditions):
        shared = spark.sparkContext.broadcast(program)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            def blocks() -> Iterator[Block]:
                for batch in batches:
                    for n in range(batch.num_rows):
                        yield Block(batch.column("ids")[n].as_py(), batch.column("columns")[n].as_py(), shared.value)

            yield from make(blocks(), shared.value)

        out = out.unionByName(index.select("ids", "columns").mapInArrow(run, schema))
    return out


def match_bitmaps(index: DataFrame, conditions: DataFrame) -> DataFrame:
    """(query_id, idx): rows satisfying all conditions of each query; `conditions` are settled and usable (see `match`)."""

    def make(blocks: Iterator[Block], program: Program) -> Iterator[pa.RecordBatch]:
        for block in blocks:
            for query in block.alive().tolist():
                ids = block.ids[block.matches(query)]
                if len(ids):
                    names = pa.DictionaryArray.from_arrays(pa.array(np.full(len(ids), query, np.int32)), program.queries)
                    yield pa.RecordBatch.from_arrays([names.cast(program.queries.type), pa.array(ids)], ["query_id", "idx"])

    return _scan(index, conditions, "query_id string, idx bigint", make)


def conjunction_counts(index: DataFrame, conditions: DataFrame) -> DataFrame:
    """(query_id, num_matches) of the queries that match at least one row. Matches are counted where they are and never become rows."""

    def make(blocks: Iterator[Block], program: Program) -> Iterator[pa.RecordBatch]:
        found = np.zeros(len(program.queries), np.int64)
        for block in blocks:
            for query in block.alive().tolist():
                found[query] += len(block.matches(query))
        some = np.flatnonzero(found)
        if len(some):
            yield pa.RecordBatch.from_arrays([program.queries.take(pa.array(some)), pa.array(found[some])], ["query_id", "n"])

    return _scan(index, conditions, "query_id string, n bigint", make).groupBy("query_id").agg(F.sum("n").alias("num_matches"))
