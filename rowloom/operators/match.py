"""Which corpus rows satisfy a conjunction of conditions.

Conditions are rows (query_id, pos, field, type, operator, num, str). Four forms give the same
answer: single conditions, relational division over their matches, posting bitmaps per block of rows (`index`), and the anchor form. The anchor
form is the one for large corpora: every query meets the corpus on one equality (or, failing that,
one range) and its other conditions are checked on the row itself, so no intermediate match set is
ever shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.functions import values as V
from rowloom.operators.cells import categorical_cells, numeric_cells
from rowloom.operators.index import block_index, match_bitmaps
from rowloom.session import join_bounded, join_small, stage_small

CONDITION_SCHEMA = T.StructType([
    T.StructField("query_id", T.StringType()), T.StructField("pos", T.IntegerType()),
    T.StructField("field", T.StringType()), T.StructField("type", T.StringType()),
    T.StructField("operator", T.StringType()), T.StructField("num", T.DoubleType()),
    T.StructField("str", T.StringType()),
])
PAIR_BLOCK = 65_536          # row numbers of one block of pairs
PACKED_PAIRS = 1_000_000     # pairs that a task packs together
UNPACKED_BLOCKS = 64         # blocks that are listed together
ABSENT = -2**63              # stands for a missing row number, which comes first
_GRID = 1000.0
_MARGIN = 2e-6


def usable_conditions(conditions: DataFrame) -> DataFrame:
    """Numeric conditions with an unknown operator are passed over; the others keep their place.

    A categorical condition always means equality. A query left without conditions matches nothing.
    """
    known = (F.col("type") == "categorical") | F.col("operator").isin(*V.OPERATOR_WORDS)
    return conditions.filter(known).withColumn(
        "operator", F.when(F.col("type") == "categorical", F.lit("==")).otherwise(F.col("operator")))


def settled_conditions(corpus: DataFrame, conditions: DataFrame) -> DataFrame:
    """Numeric conditions with an unknown operator hold nowhere if their field is no numeric column of the corpus, else they are passed over.

    The columns of the corpus are listed only if there is such a condition.
    """
    unknown = (F.col("type") == "numeric") & ~F.coalesce(F.col("operator").isin(*V.OPERATOR_WORDS), F.lit(False))
    if conditions.filter(unknown).isEmpty():
        return conditions
    asked = conditions.filter(unknown).select("field").distinct()
    present = F.map_keys(F.map_filter("nums", lambda _, v: v.isNotNull()))
    named = corpus.select(F.explode(present).alias("field"))
    columns = join_small(named, asked, ["field"], "left_semi").distinct()
    known = conditions.filter(~unknown)
    never = join_small(conditions.filter(unknown), columns, ["field"], "left_anti").withColumns(
        {"operator": F.lit("=="), "num": F.lit(None).cast("double")})
    return known.unionByName(never)


def condition_matches(corpus: DataFrame, conditions: DataFrame) -> DataFrame:
    """(query_id, pos, idx): rows satisfying each single condition."""
    conds = usable_conditions(settled_conditions(corpus, conditions))
    return single_matches(block_index(corpus), conds)


def single_matches(index: DataFrame, conds: DataFrame) -> DataFrame:
    """(query_id, pos, idx) from a block index: every condition is a query of its own."""
    key = F.concat(F.col("pos").cast("string"), F.lit("|"), F.col("query_id"))
    found = match_bitmaps(index, conds.withColumn("query_id", key))
    return found.select(F.expr("substring(query_id, locate('|', query_id) + 1)").alias("query_id"),
                        F.expr("cast(substring(query_id, 1, locate('|', query_id) - 1) as int)").alias("pos"), "idx")


def match_division(corpus: DataFrame, conditions: DataFrame) -> DataFrame:
    """(query_id, idx) by relational division: rows found by all conditions of a query."""
    conditions = settled_conditions(corpus, conditions)
    conditions = usable_conditions(conditions)
    found = single_matches(block_index(corpus), conditions).groupBy("query_id", "idx").agg(F.count(F.lit(1)).alias("_hits"))
    needed = conditions.groupBy("query_id").agg(F.count(F.lit(1)).alias("_needed"))
    return join_small(found, needed, ["query_id"], residual=F.col("_hits") == F.col("_needed")).select("query_id", "idx")


def anchored(conditions: DataFrame, width: int) -> DataFrame:
    """One row per query with its conditions side by side (f0, y0, o0, n0, s0, f1, ...).

    The anchor comes first: the equality with the fewest matching rows (`n_rows`) if they were counted,
    else a category equality before a numeric equality before a range.
    """
    preference = F.when(F.col("type") == "categorical", 0).when(F.col("operator") == "==", 1).otherwise(2)
    known = [F.col("n_rows").asc_nulls_last()] if "n_rows" in conditions.columns else []
    order = Window.partitionBy("query_id").orderBy(*known, preference, "pos")
    ranked = usable_conditions(conditions).withColumn("_slot", F.row_number().over(order) - 1)
    slots = []
    for i in range(width):
        here = F.col("_slot") == i
        slots += [F.max(F.when(here, F.col(c))).alias(f"{c[0]}{i}") for c in ("field", "operator", "num", "str")]
        slots.append(F.max(F.when(here, F.col("type"))).alias(f"y{i}"))
    return ranked.groupBy("query_id").agg(*slots, F.count(F.lit(1)).alias("width"))


def _slot_holds(i: int) -> Column:
    """Does the row satisfy condition i, looked up in its own maps?"""
    num = F.element_at("nums", F.col(f"f{i}"))
    numeric = V.numeric_holds(num, F.col(f"o{i}"), F.col(f"n{i}"))
    categorical = F.element_at("cats", F.col(f"f{i}")) == F.col(f"s{i}")
    held = F.when(F.col(f"y{i}") == "numeric", numeric).otherwise(categorical)
    return F.col(f"f{i}").isNull() | F.coalesce(held, F.lit(False))


def row_holds(width: int, first: int = 0) -> Column:
    """Does a row with the conditions of a query side by side satisfy those from `first` on?"""
    return reduce(lambda a, b: a & b, [_slot_holds(i) for i in range(first, width)], F.lit(True))


def condition_width(conditions: DataFrame) -> int:
    """Largest number of conditions of any query."""
    per_query = usable_conditions(conditions).groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"))
    return per_query.agg(F.max("_n")).first()[0] or 0


def _grid_point(x: Column) -> Column:
    """Nearest grid point; adding zero turns -0.0 into 0.0."""
    return F.rint(x * _GRID) + 0.0


def match_anchor(corpus: DataFrame, conditions: DataFrame, width: int | None = None) -> DataFrame:
    """(query_id, idx): rows satisfying all conditions of each query."""
    conditions = settled_conditions(corpus, conditions)
    width = condition_width(conditions) if width is None else width
    if width == 0:
        return corpus.select(F.lit(None).cast("string").alias("query_id"), "idx").limit(0)
    queries, fits = stage_small(anchored(conditions, width), "anchored")
    others = row_holds(width, 1)

    by_category = queries.filter(F.col("y0") == "categorical")
    by_category = by_category.withColumn("column", F.col("f0")).withColumn("str", F.col("s0"))
    numeric = queries.filter(F.col("y0") == "numeric").withColumn("column", F.col("f0"))
    by_number = numeric.filter(F.col("o0") == "==")
    # The cell's grid point is one of the grid points of the tolerance interval around the threshold.
    target = F.col("n0").cast("float").cast("double")
    grid = F.array_distinct(F.array(_grid_point(target - _MARGIN), _grid_point(target + _MARGIN)))
    by_number = by_number.withColumn("_grid", F.explode(grid))
    by_range = numeric.filter(F.col("o0") != "==")

    first = V.numeric_holds(F.col("num"), F.col("o0"), F.col("n0"))
    number_cells = numeric_cells(corpus, "nums", "cats")
    gridded = number_cells.withColumn("_grid", _grid_point(F.col("num").cast("float").cast("double")))
    parts = [
        join_bounded(categorical_cells(corpus, "nums", "cats"), by_category, ["column", "str"], fits, spread="idx",
                     residual=others),
        join_bounded(gridded, by_number, ["column", "_grid"], fits, spread="idx", residual=first & others),
        join_bounded(number_cells, by_range, ["column"], fits, spread="idx", residual=first & others),
    ]
    return reduce(DataFrame.unionByName, [p.select("query_id", "idx") for p in parts])


def with_row_counts(corpus: DataFrame, conditions: DataFrame) -> DataFrame:
    """Add `n_rows`, the number of corpus rows each equality matches; it is null for ranges.

    Every distinct equality is counted once, by hash lookups. The counts pick the anchors: a category that
    a third of the rows share is not joined on when another equality of the query is rarer.
    """
    equal = (F.col("type") == "categorical") | (F.col("operator") == "==")
    parts = ["type", "field", "operator", "num", "str"]
    key = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in parts]))
    keyed = conditions.withColumn("_key", F.when(equal, key))
    single = keyed.filter(equal).dropDuplicates(["_key"]).select(F.col("_key").alias("query_id"), F.lit(1).alias("pos"), *parts)
    counts = match_anchor(corpus, single, 1).groupBy(F.col("query_id").alias("_key")).agg(F.count(F.lit(1)).alias("n_rows"))
    counted = join_small(keyed, counts, ["_key"], "left").drop("_key")
    return counted.withColumn("n_rows", F.when(equal, F.coalesce("n_rows", F.lit(0).cast("bigint"))))


def match_counts(matches: DataFrame, min_matches: int = 5) -> DataFrame:
    """(query_id, num_matches) of the queries with enough matching rows."""
    counts = matches.groupBy("query_id").agg(F.count(F.lit(1)).alias("num_matches"))
    return counts.filter(F.col("num_matches") >= min_matches)


def packed_pairs(pairs: DataFrame, block_rows: int) -> DataFrame:
    """(query_id, block, parts): pairs (query_id, idx) by blocks of row numbers, as lists of places in the block.

    Tasks pack their pairs before these are shuffled, so a pair moves as the two bytes of its place (four in blocks of more than 65,536 rows). A missing
    row number has a block of its own, null.
    """
    qtype = dict(pairs.dtypes)["query_id"]
    width = np.uint16 if block_rows <= 2**16 else np.uint32

    def pack(table: pa.Table) -> pa.RecordBatch:
        names = table["query_id"].combine_chunks().dictionary_encode()
        query = names.indices.fill_null(len(names.dictionary)).to_numpy(zero_copy_only=False)
        idx = table["idx"].combine_chunks()
        absent = idx.is_null().to_numpy(zero_copy_only=False)
        idx = idx.fill_null(0).to_numpy(zero_copy_only=False)
        order = np.lexsort((idx, absent, query))
        query, idx, absent = query[order], idx[order], absent[order]
        block = idx // block_rows
        new = np.ones(len(idx), bool)
        new[1:] = (query[1:] != query[:-1]) | (block[1:] != block[:-1]) | (absent[1:] != absent[:-1])
        first = np.flatnonzero(new)
        ends = np.append(first, len(idx)).astype(np.int64) * width().itemsize
        places = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer((idx - block * block_rows).astype(width))])
        which = pa.array(query[first], pa.int64(), mask=query[first] == len(names.dictionary))
        return pa.RecordBatch.from_arrays([names.dictionary.take(which), pa.array(block[first], pa.int64(), mask=absent[first]), places.cast(pa.binary())],
                                          ["query_id", "block", "places"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= PACKED_PAIRS:
                yield pack(pa.Table.from_batches(held))
                held, rows = [], 0
        if rows:
            yield pack(pa.Table.from_batches(held))

    packed = pairs.select("query_id", F.col("idx").cast("bigint").alias("idx")).mapInArrow(run, f"query_id {qtype}, block bigint, places binary")
    return packed.groupBy("query_id", "block").agg(F.collect_list("places").alias("parts"))


def _unpacked(packed: DataFrame, block_rows: int, distinct: bool) -> DataFrame:
    """(query_id, block, matching_indices) of packed pairs; a block that is null has no row numbers."""
    qtype = dict(packed.dtypes)["query_id"]
    width = np.uint16 if block_rows <= 2**16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, UNPACKED_BLOCKS):
                piece = batch.slice(at, UNPACKED_BLOCKS)
                lists = []
                for block, parts in zip(piece.column("block").to_pylist(), piece.column("parts").to_pylist(), strict=True):
                    places = np.frombuffer(b"".join(parts) if block is not None else b"", width)
                    places = np.unique(places) if distinct else np.sort(places)
                    lists.append(places.astype(np.int64) + (block or 0) * block_rows)
                ends = np.cumsum([0, *map(len, lists)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(lists)))
                yield pa.RecordBatch.from_arrays([piece.column("query_id"), piece.column("block"), ids], ["query_id", "block", "matching_indices"])

    return packed.mapInArrow(run, f"query_id {qtype}, block bigint, matching_indices array<bigint>")


def distinct_pairs(pairs: DataFrame) -> DataFrame:
    """(query_id, idx): every pair once, whatever number of times it is given."""
    blocks = _unpacked(packed_pairs(pairs, PAIR_BLOCK), PAIR_BLOCK, distinct=True)
    return blocks.select("query_id", F.explode(F.when(F.col("block").isNull(), F.array(F.lit(None).cast("bigint"))).otherwise(F.col("matching_indices"))).alias("idx"))


def distinct_counts(pairs: DataFrame) -> DataFrame:
    """(query_id, n): different pairs of each query. The pairs are packed, counted and never listed."""
    sizes = _unpacked(packed_pairs(pairs, PAIR_BLOCK), PAIR_BLOCK, distinct=True).select(
        "query_id", F.when(F.col("block").isNull(), 1).otherwise(F.size("matching_indices")).cast("bigint").alias("n"))
    return sizes.groupBy("query_id").agg(F.sum("n").alias("n"))


def first_pairs(pairs: DataFrame, n: int) -> DataFrame:
    """(query_id, idx, place): the n smallest row numbers of each query. Tasks keep n for each query, so no window holds more than these."""
    qtype = dict(pairs.dtypes)["query_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict = {}
        last = np.zeros(0, np.int64)   # the n-th smallest so far of each query
        query, kept = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            names = batch.column("query_id").dictionary_encode()
            listed = names.dictionary.to_pylist() + [None] * (names.null_count > 0)
            own = np.array([codes.setdefault(name, len(codes)) for name in listed], np.int64)
            code = own[names.indices.fill_null(len(listed) - 1).to_numpy(zero_copy_only=False)] if listed else query[:0]
            last = np.append(last, np.full(len(codes) - len(last), np.iinfo(np.int64).max))
            idx = batch.column("idx").fill_null(ABSENT).to_numpy(zero_copy_only=False)
            near = idx <= last[code]
            query, kept = np.append(query, code[near]), np.append(kept, idx[near])
            order = np.lexsort((kept, query))
            query, kept = query[order], kept[order]
            place = np.arange(len(query)) - np.searchsorted(query, query)
            last[query[place == n - 1]] = kept[place == n - 1]
            query, kept = query[place < n], kept[place < n]
        if len(kept):
            found = pa.array(list(codes), pa_type.get(qtype)).take(pa.array(query))
            yield pa.RecordBatch.from_arrays([found, pa.array(kept, mask=kept == ABSENT)], ["query_id", "idx"])

    pa_type = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}
    few = pairs.select("query_id", F.col("idx").cast("bigint").alias("idx")).mapInArrow(run, f"query_id {qtype}, idx bigint")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("idx"))
    return few.withColumn("place", place).filter(F.col("place") <= n)


def ground_truth_blocks(qrels: DataFrame, block_rows: int = PAIR_BLOCK) -> DataFrame:
    """(query_id, block, matching_indices): sorted row ids, in arrays of bounded length.

    Block b holds the ids from b * block_rows on, so no array grows with the corpus, and reading the
    blocks in order gives the full sorted list. Ids are packed before they are shuffled.
    """
    return _unpacked(packed_pairs(qrels, block_rows), block_rows, distinct=False)
