import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.functions import values as V
from rowloom.functions.draws import draw_below, draw_int, draw_unit, seed_hash
from rowloom.functions.vectors import cluster_counts, ideal_gain, nlist_of, nprobe_of


def numbers():
    rnd = random.Random(3)
    fixed = [2.675, 0.125, 0.375, 1.115, -2.675, -0.125, 12345678.0, 900.0, 0.1, -0.001, -0.0, 0.0, 1e15 + 0.3, 1e16,
             1.5e20, math.inf, -math.inf, 1.005, 0.285, 1e-5, 0.00012345678901234567, 99999.995, 1e22, -12345678.905]
    return fixed + [rnd.uniform(-1e6, 1e6) for _ in range(300)] + [rnd.randint(-10**7, 10**7) / 1000 for _ in range(1000)]


@pytest.mark.parametrize("precision", [0, 2, 3])
def test_numbers_print_like_rounded_python_floats(spark, precision):
    rows = spark.createDataFrame([(x,) for x in numbers()], "x double").coalesce(1).select(
        "x", V.float_text(F.col("x"), precision).alias("t"), V.short_number_text(F.col("x"), precision).alias("s"),
        V.plain_text(F.col("x"), T.DoubleType()).alias("p")).collect()
    for x, text, short, plain in rows:
        rounded = round(x, precision)
        assert text == repr(rounded)
        assert plain == repr(x)
        whole = not math.isinf(rounded) and rounded == int(rounded)
        assert short == (str(int(rounded)) if whole else repr(rounded))


def test_clean_value(spark):
    rows = spark.createDataFrame(
        [("\t x. ", 1.0, True, 7), ("a..", float("nan"), False, None), (None, None, None, 0), (" .", 0.005, None, -1)],
        "s string, d double, b boolean, i int")
    got = rows.select(*[V.clean_value(F.col(c), rows.schema[c].dataType) for c in "sdbi"]).collect()
    assert [tuple(r) for r in got] == [
        ("x", "1.0", "1", "7"), ("a.", "unknown", "0", "unknown"), ("unknown", "unknown", "unknown", "0"),
        ("", repr(round(0.005, 2)), "unknown", "-1")]


def test_serialize_row(spark):
    rows = spark.createDataFrame([("a.", 2.0)], "s string, d double")
    text = V.serialize_row([("s", F.col("s"), T.StringType()), ("d", F.col("d"), T.DoubleType())])
    assert rows.select(text).first()[0] == "The s is a. The d is 2.0."


def test_is_numeric(spark):
    cases = {"007": True, "1e5": False, "-3.50": True, " 12\t": True, "1.": False, "": False, None: False, "٣": True}
    rows = spark.createDataFrame([(k,) for k in cases], "s string")
    got = {r[0]: r[1] for r in rows.select("s", V.is_numeric(F.col("s"))).collect()}
    assert got == cases


def test_keys_labels_and_csv_cells(spark):
    rows = spark.createDataFrame([(True, 2.0, None), (False, float("nan"), " a "), (None, 0.126, "b")],
                                 "b boolean, d double, s string")
    got = rows.select(V.plain_text(F.col("b"), T.BooleanType()), V.label_text(F.col("d"), T.DoubleType()),
                      V.label_text(F.col("s"), T.StringType()), V.csv_number(F.col("d"), T.DoubleType())).collect()
    assert [tuple(r) for r in got] == [("True", "2.0", "nan", "2"), ("False", "nan", " a ", None), (None, "0.126", "b", "0.13")]


def test_conditions_compare_in_single_precision(spark):
    rows = spark.createDataFrame([(16777217.0, "==", 16777216.0), (0.1, ">", 0.1), (0.05, "==", 0.05), (1.0, "<", 1.00000001),
                                  (8.000001, "==", 8.0)], "x double, o string, t double")
    got = [r[0] for r in rows.select(V.numeric_holds(F.col("x"), F.col("o"), F.col("t"))).collect()]
    assert got == [True, False, True, False, True]


def test_draws(spark):
    rows = spark.range(2000).withColumn("d", seed_hash(1, F.col("id")))
    got = rows.select(draw_int(F.col("d")), draw_unit(F.col("d")), draw_below(F.col("d"), F.lit(7))).collect()
    assert all(0 <= i < 2**32 and 0 <= u < 1 and 0 <= b < 7 for i, u, b in got)
    assert 0.45 < sum(u for _, u, _ in got) / 2000 < 0.55
    assert {b for _, _, b in got} == set(range(7))


def test_cluster_counts(spark):
    sizes = [1, 10, 99, 10_000, 1_400_000, 10**9]
    rows = spark.createDataFrame([(n,) for n in sizes], "n bigint").withColumn("l", nlist_of(F.col("n")))
    got = {r[0]: (r[1], r[2]) for r in rows.select("n", "l", nprobe_of(F.col("l"))).collect()}
    assert got == {n: cluster_counts(n) for n in sizes}
    assert got[10**9] == (4096, 128) and got[10] == (3, 3)


def test_ideal_gain(spark):
    row = spark.range(1).select(ideal_gain(F.lit(3), F.lit(10)), ideal_gain(F.lit(50), F.lit(2))).first()
    assert row[0] == pytest.approx(sum(1 / math.log2(r + 1) for r in (1, 2, 3)))
    assert row[1] == pytest.approx(1 + 1 / math.log2(3))
