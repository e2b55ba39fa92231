"""What moves and what is written: figures that grow with the tables."""

import json

import pytest

import __spark_entry__ as entry
from pyspark.sql import functions as F
from rowloom.operators import rank

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_read_positions(spark, tmp_path):
    rows = [(f"k{i % 3}" if i % 7 else None, i) for i in range(900)]
    for n in range(3):
        (tmp_path / f"part-{n}.json").write_text("".join(json.dumps({"k": k, "v": v}) + "\n" for k, v in rows[n * 300:(n + 1) * 300]))
    read = spark.read.schema("k string, v int").json(str(tmp_path)).fillna("none").select(
        "k", "v", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    got = {(r["k"], r["v"]): r["position"] for r in rank.read_positions(read, ["k"], "file", "block").collect()}
    want, seen = {}, {}
    for k, v in rows:
        seen[k or "none"] = seen.get(k or "none", 0) + 1
        want[k or "none", v] = seen[k or "none"]
    assert got == want


def test_positions_are_told_where_rows_are_read(spark):
    made = plan(entry.queries()["final_shuffle"](spark, SF))
    assert "hashpartitioning" not in made and "Window" not in made


@pytest.mark.parametrize("name", ["load_split_files", "jsonl_roundtrip"])
def test_written_text_is_packed(spark, name):
    files = entry.queries()[name](spark, SF).inputFiles()
    assert files and all(".gz" in f for f in files)
