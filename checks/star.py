"""The test tables described as datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rowloom.sources.tables import DatasetSpec, spread, with_row_id

LINEITEM_COLUMNS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")

SPECS = {
    "customer": DatasetSpec(
        "customer", "star", "c_mktsegment", {"c_nationkey": "int", "c_acctbal": "float"}, "dim",
        id_columns=("c_custkey",)),
    "part": DatasetSpec(
        "part", "star", "p_type", {"p_size": "int", "p_retailprice": "float"}, "dim", id_columns=("p_partkey",)),
    "orders": DatasetSpec(
        "orders", "star", "o_orderpriority", {"o_totalprice": "float"}, "fact", id_columns=("o_orderkey",),
        columns=("o_orderstatus", "o_totalprice", "o_orderdate")),
    "lineitem": DatasetSpec(
        "lineitem", "star", "l_returnflag",
        {"l_quantity": "float", "l_extendedprice": "float", "l_discount": "float", "l_tax": "float"}, "fact",
        id_columns=LINEITEM_COLUMNS,
        columns=("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linestatus", "l_shipdate")),
    "events": DatasetSpec(
        "events", "stream", "event_type", {"user_id": "int", "value": "float"}, id_columns=("event_id",),
        columns=("user_id", "value", "props")),
    "documents": DatasetSpec(
        "documents", "text", "lang", {}, id_columns=("doc_id",), columns=("text", "source")),
}

# Tables and targets that each fail one gate, or just pass it.
GATE_SPECS = {
    "nation": DatasetSpec("nation", "gate", "n_regionkey", {"n_nationkey": "int"}, id_columns=("n_nationkey",)),
    "orders": DatasetSpec("orders", "gate", "o_custkey", {"o_totalprice": "float"}, id_columns=("o_orderkey",)),
    "supplier": DatasetSpec("supplier", "gate", "s_nationkey", {"s_acctbal": "float"}, id_columns=("s_suppkey",)),
    "part": DatasetSpec("part", "gate", "p_size", {"p_retailprice": "float"}, id_columns=("p_partkey",)),
    "customer": DatasetSpec("customer", "gate", "c_mktsegment", {"c_acctbal": "float"}, id_columns=("c_custkey",)),
    "documents": DatasetSpec("documents", "gate", "lang", {}, id_columns=("doc_id",), columns=("text", "source")),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def star_tables(spark: SparkSession, sf_dir: str, names: tuple[str, ...] | None = None) -> list[tuple[DatasetSpec, DataFrame]]:
    """(description, identified rows) of the test datasets, in catalog order."""
    return [(spec, with_row_id(spread(table(spark, sf_dir, name)), spec.id_columns))
            for name, spec in SPECS.items() if names is None or name in names]


def gate_tables(spark: SparkSession, sf_dir: str) -> list[tuple[DatasetSpec, DataFrame]]:
    return [(spec, with_row_id(table(spark, sf_dir, name), spec.id_columns)) for name, spec in GATE_SPECS.items()]
