"""Column expressions on ARRAY<FLOAT> vectors."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def inner_product(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column) -> Column:
    """Unit-norm single-precision vector; a zero vector stays zero."""
    norm = l2_norm(v)
    return F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(x).cast("float"))


def discount(rank: Column) -> Column:
    """Logarithmic discount of a 1-based rank."""
    return F.lit(1.0) / F.log2(rank + F.lit(1.0))


def ideal_gain(relevant: Column, k: Column) -> Column:
    """Best possible discounted gain within the first k ranks."""
    ranks = F.sequence(F.lit(1), F.greatest(F.least(relevant, k), F.lit(1)).cast("int"))
    return F.aggregate(ranks, F.lit(0.0), lambda acc, r: acc + discount(r))


def cluster_counts(n_rows: int) -> tuple[int, int]:
    """(nlist, nprobe) for a clustered search over n_rows vectors."""
    nlist = max(min(math.isqrt(n_rows), 4096), 1)
    return nlist, probe_count(nlist)


def probe_count(nlist: int) -> int:
    """Clusters a query is sent to."""
    return min(max(8, min(nlist // 5, 128)), nlist)


def nlist_of(n_rows: Column) -> Column:
    return F.greatest(F.least(F.floor(F.sqrt(n_rows)), F.lit(4096)), F.lit(1)).cast("bigint")


def nprobe_of(nlist: Column) -> Column:
    fifth = F.floor(nlist / F.lit(5)).cast("bigint")
    return F.least(F.greatest(F.lit(8), F.least(fifth, F.lit(128))), nlist).cast("bigint")
