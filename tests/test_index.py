"""Indexes over the corpus against brute force."""

import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from rowloom.operators import index, match, metrics
from rowloom.session import write_stage
from test_match import CONDS, brute

SCHEMA = "idx bigint, dataset_pos int, nums map<string,double>, cats map<string,string>"


def skewed_rows(n=900):
    """A column of which half the cells are equal, one with absent and special cells, values that nearly all rows or only one have."""
    draw = random.Random(7)
    rows = []
    for i in range(n):
        nums = {"size": float(draw.choice([1, 1, 1, 2, 3, 900])), "price": None if i % 11 == 0 else draw.choice([i * 0.25 - 20, -0.0, 0.1, 1e30, float("nan"), float("inf")]),
                "tiny": (i % 3 - 1) * 1e-7}
        cats = {"colour": "red" if i % 50 else "blue", "name": f"n{i}", "shape": None if i % 5 else "x"}
        rows.append({"idx": i, "pos": 0, "nums": nums if i < 700 else {"price": float(i)}, "cats": cats if i % 7 else {"size": str(i % 4)}})
    return rows


@pytest.fixture(scope="module")
def skewed(spark):
    rows = skewed_rows()
    return rows, write_stage(spark.createDataFrame([(r["idx"], r["pos"], r["nums"], r["cats"]) for r in rows], SCHEMA).repartition(3), "skewed")


def drawn_conditions(rows, n):
    draw, conds = random.Random(3), []
    for q in range(n):
        for pos in range(1, draw.randrange(1, 4) + 1):
            row = draw.choice(rows)
            if draw.random() < 0.5 and any(v is not None for v in row["nums"].values()):
                field, value = draw.choice([(k, v) for k, v in row["nums"].items() if v is not None])
                conds.append((f"q{q:03}", pos, field, "numeric", draw.choice(["==", ">", "<"]), value + draw.choice([0.0, 0.0, 5e-7, -2e-6, 0.5]), None))
            else:
                field, value = draw.choice([(k, v) for k, v in row["cats"].items() if v is not None] or [("colour", "red")])
                conds.append((f"q{q:03}", pos, field, "categorical", "==", None, value))
    return conds


def holds(row, cond):
    """As in Spark, NaN is greater than any number."""
    import numpy as np

    _, _, field, kind, op, num, text = cond
    if kind == "categorical":
        return row["cats"].get(field) == text
    x = row["nums"].get(field)
    if x is None or num is None:
        return False
    with np.errstate(over="ignore", invalid="ignore"):
        a, b = np.float32(x), np.float32(num)
        if op == "==":
            return bool(abs(a - b) < np.float32(1e-6))
    key = lambda v: (bool(np.isnan(v)), 0 if np.isnan(v) else v)
    return key(a) > key(b) if op == ">" else key(a) < key(b)


@pytest.mark.parametrize("block, program", [(8192, 500_000), (64, 30)])
def test_bitmaps_against_brute_force(spark, skewed, monkeypatch, block, program):
    """Small blocks, and a few conditions for each scan."""
    monkeypatch.setattr(index, "BLOCK_ROWS", block)
    monkeypatch.setattr(index, "PROGRAM_CONDITIONS", program)
    monkeypatch.setattr(index, "KEPT_BITMAPS", 2)
    rows, corpus = skewed
    conds = drawn_conditions(rows, 120)
    by_query = {}
    for c in conds:
        by_query.setdefault(c[0], []).append(c)
    want = {(q, r["idx"]) for q, cs in by_query.items() for r in rows if all(holds(r, c) for c in cs)}
    blocks = write_stage(index.block_index(corpus), "blocks")
    df = spark.createDataFrame(conds, match.CONDITION_SCHEMA)
    got = index.match_bitmaps(blocks, df).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    counts = {r.query_id: r.num_matches for r in index.conjunction_counts(blocks, df).collect()}
    assert counts == {q: sum(1 for x, _ in want if x == q) for q, _ in want}


def test_bitmaps_agree_with_the_anchor_form(spark, skewed):
    rows, corpus = skewed
    clean = [{**r, "nums": {k: v for k, v in r["nums"].items() if v is None or abs(v) < 1e9}} for r in rows]
    df = spark.createDataFrame([(r["idx"], r["pos"], r["nums"], r["cats"]) for r in clean], SCHEMA)
    conds = spark.createDataFrame(CONDS, match.CONDITION_SCHEMA)
    settled = match.usable_conditions(match.settled_conditions(df, conds))
    want = {tuple(r) for r in match.match_anchor(df, conds).collect()}
    assert want == brute(clean, CONDS) and {tuple(r) for r in index.match_bitmaps(index.block_index(df), settled).collect()} == want


@pytest.mark.parametrize("cells", [4096, 16, 1])
def test_ranges_take_whole_bins(spark, skewed, monkeypatch, cells):
    monkeypatch.setattr(index, "BIN_CELLS", cells)
    rows, corpus = skewed
    ordered = index.value_order(corpus)
    bins = write_stage(index.num_blocks(ordered), "bins")
    sizes = {}
    for r in bins.collect():
        sizes.setdefault(r.column, []).append((r.bin, r.n))
    for name, own in sizes.items():
        total = sum(1 for r in rows if r["nums"].get(name) is not None)
        assert sum(n for _, n in own) == total and [b for b, _ in sorted(own)] == list(range(-(-total // cells)))
        assert all(n == cells for _, n in sorted(own)[:-1])
    conds = [(f"r{n}", 1, field, "numeric", op, value, None) for n, (field, value) in enumerate(
        (f, v) for f in ("size", "price", "tiny", "nothing") for v in (None, -1e9, -1e-7, 0.0, -0.0, 0.1, 1.0, 2.5, 900.0, 1e30, 1e300, float("nan"))) for op in (">",)]
    conds += [(q, 2, f, k, "<", v, s) for q, _, f, k, _, v, s in conds] + [("c", 1, "colour", "categorical", "==", None, "red")]
    got = {(r.query_id, r.pos): r.n_rows for r in index.range_counts(ordered, bins, spark.createDataFrame(conds, match.CONDITION_SCHEMA)).collect()}
    assert got == {(c[0], c[1]): sum(holds(r, c) for r in rows) for c in conds if c[3] == "numeric"}


def test_one_column_is_a_range_of_the_files(spark):
    """A filter on a column reaches the scan, and nearly all row groups can be skipped by their least and greatest column name."""
    corpus = spark.range(4_000).select(F.col("id").alias("idx"), F.map_from_arrays(
        F.array(*[F.lit(f"c{n:02}") for n in range(40)]), F.array(*[(F.col("id") * (n + 1) % 997).cast("double") for n in range(40)])).alias("nums"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small as it is, the table is to have several files
    try:
        ordered = index.value_order(corpus)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    plan = ordered.filter("column = 'c07' AND num > 500")._jdf.queryExecution().toString()
    assert "EqualTo(column,c07)" in plan and "GreaterThan(num," in plan
    sizes = {True: 0, False: 0}
    for path in ordered.inputFiles():
        meta = pq.ParquetFile(path.removeprefix("file://")).metadata
        for g in range(meta.num_row_groups):
            stats = meta.row_group(g).column(0).statistics
            sizes[stats.min <= "c07" <= stats.max] += meta.row_group(g).total_byte_size
    assert 0 < sizes[True] < 0.5 * sizes[False]


def test_hits_are_judged_by_their_rows(spark, skewed):
    rows, corpus = skewed
    conds = drawn_conditions(rows, 30)
    draw = random.Random(1)
    hits = [(f"q{q:03}", rank, draw.randrange(900)) for q in range(32) for rank in range(1, 20)]
    by_query = {}
    for c in conds:
        by_query.setdefault(c[0], []).append(c)
    want = {(q, rank, i): int(q in by_query and all(holds(rows[i], c) for c in by_query[q])) for q, rank, i in hits}
    made = metrics.hits_rel_by_condition(spark.createDataFrame(hits, "query_id string, rank int, idx bigint"), corpus, spark.createDataFrame(conds, match.CONDITION_SCHEMA))
    assert {(r.query_id, r["rank"], r.idx): r.rel for r in made.collect()} == want and any(want.values())


def test_indexes_of_nothing(spark, skewed):
    none = skewed[1].limit(0)
    conds = spark.createDataFrame(CONDS, match.CONDITION_SCHEMA)
    assert index.match_bitmaps(index.block_index(none), conds).count() == 0
    assert index.match_bitmaps(index.block_index(skewed[1]), conds.limit(0)).count() == 0
    ordered = index.value_order(none)
    assert index.num_blocks(ordered).count() == 0
    assert all(r.n_rows == 0 for r in index.range_counts(ordered, index.num_blocks(ordered), conds).collect())


def test_a_given_index_is_not_made_again(spark, skewed):
    """Queries are drawn and counted from the index that is there; without one it is written, packed."""
    import glob

    from rowloom.config import RetrievalConfig
    from rowloom.operators import workload
    from rowloom.session import WIDE_CODEC, temporary_stages

    corpus = skewed[1].withColumn("dataset_pos", F.lit(0))
    blocks = write_stage(index.block_index(corpus), "blocks", codec=WIDE_CODEC)
    config = RetrievalConfig(num_queries_per_type=6, min_matches=1)
    with temporary_stages(spark) as folder:
        queries, conds = workload.build_queries(corpus, config, index=blocks)
        got = sorted(map(tuple, conds.collect()), key=repr)
        assert not glob.glob(f"{folder}/block_index-*")
        counts = {r["query_id"]: r["num_matches"] for r in index.conjunction_counts(blocks, conds).collect()}
        assert counts == {r["query_id"]: r["num_matches"] for r in queries.collect()} and counts
    with temporary_stages(spark) as folder:
        assert sorted(map(tuple, workload.build_queries(corpus, config)[1].collect()), key=repr) == got
        assert glob.glob(f"{folder}/block_index-*/*.zstd.parquet")
