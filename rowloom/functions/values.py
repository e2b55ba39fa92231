"""Column expressions for cell cleaning, number formatting and row text.

All of them are built-in JVM expressions: they stay inside whole-stage code generation and work
unchanged on batch and streaming DataFrames.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Cell texts that a CSV reader treats as missing.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Wording of rows and queries, and the stand-ins for missing cells and labels.
MISSING_TEXT = "unknown"
MISSING_LABEL = "nan"
QUERY_PREFIX = "find records where "
OPERATOR_WORDS = {"==": "is", ">": "greater than", "<": "less than"}
NUMERIC_KINDS = ["float", "int"]
EQUAL_TOLERANCE = 1e-6

_EXACT_LIMIT = float(2**52)
_SPLITTER = float(2**27 + 1)
# The characters that count as white space at the ends of a text.
SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008" \
        "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def is_float(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DoubleType, T.FloatType, T.DecimalType))


def is_number(dtype: T.DataType) -> bool:
    return is_float(dtype) or isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


# --- rounding -------------------------------------------------------------------------------
#
# The common case of each expression is a few operations; the uncommon one sits in a lambda, so that
# rows of many columns still compile to small methods.

def _rarely(x: Column, body: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(x), body)[0]


def round_half_even(x: Column, precision: int = 2) -> Column:
    """Correctly rounded double, half-way cases decided by the exact binary value.

    Only when the scaled value comes out exactly half-way can its own rounding error matter. That
    error is then computed exactly, so 2.675 (stored slightly below) goes down, and true ties go to
    the even digit. Doubles too large to carry the digits stay as they are.
    """
    x = x.cast("double")
    scale = F.lit(float(10**precision))
    product = x * scale

    def half_way(x: Column) -> Column:
        product = x * scale
        nearest = F.rint(product)
        spread = x * F.lit(_SPLITTER)
        high = spread - (spread - x)
        error = (high * scale - product) + (x - high) * scale
        up, down = product > nearest, product < nearest
        return F.when(up & (error > 0), nearest + 1).when(down & (error < 0), nearest - 1).otherwise(nearest) / scale

    return F.when(F.abs(product - F.rint(product)) == 0.5, _rarely(x, half_way)) \
        .when(F.abs(product) < F.lit(_EXACT_LIMIT), F.rint(product) / scale).otherwise(x)


def double_text(x: Column) -> Column:
    """Shortest text of a double: 900.0, 0.1, 12345678.0, -0.0, 1e+16, 1e-05."""

    def unusual(x: Column) -> Column:
        size = F.abs(x)
        digits = F.regexp_replace(x.try_cast("decimal(38,21)").cast("string"), r"(\.\d+?)0+$", "$1")
        exponent = F.regexp_replace(F.regexp_replace(x.cast("string"), r"\.0E", "E"), r"E(\d)", "e+$1")
        exponent = F.regexp_replace(F.regexp_replace(exponent, r"E-(\d)$", "e-0$1"), r"E-", "e-")
        exponent = F.replace(exponent, F.lit("Infinity"), F.lit("inf"))
        return F.when((size >= 1e-4) & (size < 1e16), digits).otherwise(exponent)

    size = F.abs(x)
    return F.when((size < 1e7) & ((size >= 1e-3) | (size == 0)), x.cast("string")).otherwise(_rarely(x, unusual))


def whole_number_text(x: Column) -> Column:
    """Text of a double, without decimals when it is whole: 900, 0.1."""
    def whole(x: Column) -> Column:
        return F.coalesce(x.try_cast("decimal(38,0)").cast("string"), double_text(x))

    small = F.when(F.abs(x) < F.lit(_EXACT_LIMIT), x.cast("bigint").cast("string")).otherwise(_rarely(x, whole))
    return F.when(x == F.rint(x), small).otherwise(double_text(x))


def float_text(x: Column, precision: int = 2) -> Column:
    return double_text(round_half_even(x, precision))


def short_number_text(x: Column, precision: int = 2) -> Column:
    return whole_number_text(round_half_even(x, precision))


# --- cells ----------------------------------------------------------------------------------

def strip(col: Column) -> Column:
    """Remove white space of any kind from both ends."""
    return F.btrim(col, F.lit(SPACE))


def is_numeric(col: Column, dtype: T.DataType = T.StringType()) -> Column:
    """True for numbers and for texts that are a plain decimal number; null gives false."""
    if is_float(dtype):
        return F.coalesce(~F.isnan(col.cast("double")), F.lit(False))
    if is_number(dtype) or isinstance(dtype, T.BooleanType):
        return col.isNotNull()
    if isinstance(dtype, T.StringType):
        return F.coalesce(strip(col).rlike(r"(?U)^-?\d+(\.\d+)?$"), F.lit(False))
    return F.lit(False)


def clean_value(col: Column, dtype: T.DataType, precision: int | None = 2) -> Column:
    """Text of one cell as it appears in a row sentence; precision None means already rounded."""
    if is_float(dtype):
        x = col.cast("double")
        text = F.when(~F.isnan(x), double_text(x if precision is None else round_half_even(x, precision)))
    elif isinstance(dtype, T.BooleanType):
        text = col.cast("int").cast("string")
    elif isinstance(dtype, T.StringType):
        text = F.regexp_replace(strip(col), r"\.\z", "")
    else:
        text = col.cast("string")
    return F.coalesce(text, F.lit(MISSING_TEXT))


def serialize_row(columns: Sequence[tuple[str, Column, T.DataType]], precision: int | None = 2) -> Column:
    """"The {name} is {value}." for every column in order, joined by one space."""
    if not columns:
        return F.lit("")
    parts = []
    for i, (name, col, dtype) in enumerate(columns):
        parts += [F.lit(f"{' ' if i else ''}The {name} is "), clean_value(col, dtype, precision), F.lit(".")]
    return F.concat(*parts)


def plain_text(col: Column, dtype: T.DataType) -> Column:
    """Unrounded text of a value, null when missing: the form of category keys and labels."""
    if is_float(dtype):
        x = col.cast("double")
        return F.when(~F.isnan(x), double_text(x))
    if isinstance(dtype, T.BooleanType):
        return F.initcap(col.cast("string"))
    return col.cast("string")


def label_text(col: Column, dtype: T.DataType) -> Column:
    """Label as text; missing labels form a class of their own."""
    return F.coalesce(plain_text(col, dtype), F.lit(MISSING_LABEL))


def numeric_cell(col: Column, dtype: T.DataType) -> Column:
    """Value of a numeric cell as DOUBLE; null when missing, NaN or not a number."""
    if is_number(dtype) or isinstance(dtype, T.BooleanType):
        x = col.cast("double")
    else:
        x = strip(col.cast("string")).try_cast("double")
    return F.when(~F.isnan(x), x)


def column_kind(kind: Column) -> Column:
    """Two-valued kind from a declared feature kind; undeclared means categorical."""
    return F.when(kind.isin(*NUMERIC_KINDS), F.lit("numeric")).otherwise(F.lit("categorical"))


def csv_number(col: Column, dtype: T.DataType, precision: int | None = 2) -> Column:
    """Cell for the CSV sink: doubles rounded, whole ones without decimals; other types as text."""
    if is_float(dtype):
        x = col.cast("double")
        rounded = x if precision is None else round_half_even(x, precision)
        return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), whole_number_text(rounded))
    return plain_text(col, dtype)


def without_na_tokens(col: Column) -> Column:
    """Null for the texts that mean a missing cell."""
    return F.when(~col.isin(NA_TOKENS), col)


def dataset_key(benchmark: Column, sub_benchmark: Column, name: Column) -> Column:
    """benchmark/[sub_benchmark/]name, unique across the collection."""
    return F.concat_ws("/", benchmark, F.nullif(sub_benchmark, F.lit("")), name)


# --- conditions -----------------------------------------------------------------------------

def numeric_equal(x: Column, t: Column) -> Column:
    """Equality in single precision, within the tolerance."""
    gap = F.abs(x.cast("float") - t.cast("float"))
    return gap < F.lit(EQUAL_TOLERANCE).cast("float")


def numeric_greater(x: Column, t: Column) -> Column:
    return x.cast("float") > t.cast("float")


def numeric_less(x: Column, t: Column) -> Column:
    return x.cast("float") < t.cast("float")


def numeric_holds(x: Column, operator: Column, t: Column) -> Column:
    """Does a numeric cell satisfy `operator t`?"""
    return (
        F.when(operator == "==", numeric_equal(x, t))
        .when(operator == ">", numeric_greater(x, t))
        .when(operator == "<", numeric_less(x, t))
    )


def condition_text(field: Column, operator: Column, num: Column, value: Column, precision: int = 2) -> Column:
    """"{field} is {value}", "{field} greater than {value}" or "{field} less than {value}"."""
    words = F.lit(None).cast("string")
    for op, word in OPERATOR_WORDS.items():
        words = F.when(operator == op, F.lit(word)).otherwise(words)
    return F.concat_ws(" ", field, words, F.coalesce(short_number_text(num, precision), value))


def query_text(parts: Column) -> Column:
    """Query sentence from the ordered array of condition texts."""
    return F.concat(F.lit(QUERY_PREFIX), F.array_join(parts, " and "))
