"""Portable, partition-stable pseudo-random values.

A value is derived from the md5 of a key string, never from ``rand()``, so it
does not depend on partitioning or task retries and an equivalent SQL
expression reproduces it bit for bit (see ``furrow.plans.sqlfrag``).

``h32(parts)``  : first 8 hex digits of md5('p1:p2:...') as BIGINT in [0, 2^32)
``uniform``     : integer-scaled uniform in [lo, hi] with ``d`` decimals
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _part(p) -> Column:
    if isinstance(p, Column):
        return p.cast("string")
    return F.lit(str(p))


def hash_key(*parts) -> Column:
    return F.concat_ws(":", *[_part(p) for p in parts])


def h32(*parts) -> Column:
    """Unsigned 32-bit hash of the joined key parts (BIGINT)."""
    return F.conv(F.substring(F.md5(hash_key(*parts)), 1, 8), 16, 10).cast("bigint")


def scaled_bounds(lo: float, hi: float, d: int) -> tuple[int, int, int]:
    scale = 10 ** d
    lo_i = int(round(lo * scale))
    span = int(round(hi * scale)) - lo_i
    return scale, lo_i, span


def uniform(lo: float, hi: float, d: int, *parts) -> Column:
    """Uniform value in [lo, hi] with d decimals, exact in integer arithmetic."""
    scale, lo_i, span = scaled_bounds(lo, hi, d)
    steps = F.shiftright(h32(*parts) * F.lit(span + 1), 32)
    return (F.lit(lo_i) + steps).cast("double") / F.lit(float(scale))


def uniform_cols(lo: Column, hi: Column, d: int, *parts) -> Column:
    """Uniform with per-row bounds (columns), e.g. taken from a dimension."""
    scale = 10 ** d
    lo_i = F.round(lo * scale).cast("bigint")
    span = F.round(hi * scale).cast("bigint") - lo_i
    steps = F.shiftright(h32(*parts) * (span + F.lit(1)), 32)
    return (lo_i + steps).cast("double") / F.lit(float(scale))


def pick(arr: Column, *parts) -> Column:
    """Uniform pick of one element of an array column."""
    return F.element_at(arr, (h32(*parts) % F.size(arr)).cast("int") + F.lit(1))
