"""Reproducible random draws.

Every draw is the MD5 of a seed and a key, so it does not depend on partitioning, task retries or
evaluation order, and any SQL engine can recompute it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DRAW_RANGE = 2**32


def seed_hash(seed, *keys: Column) -> Column:
    """32 hex digits that order rows at random but reproducibly."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def draw_int(digest: Column) -> Column:
    """Uniform integer in [0, 2^32) taken from the first eight hex digits of a digest."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def draw_unit(digest: Column) -> Column:
    """Uniform double in [0, 1)."""
    return draw_int(digest) / F.lit(float(DRAW_RANGE))


def draw_below(digest: Column, bound: Column) -> Column:
    """Uniform integer in [0, bound), from fifteen hex digits whatever the bound is."""
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint") % bound
