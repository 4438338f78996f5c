"""Materialise computed columns before they are referenced inside lambdas.

Spark evaluates the body of a higher-order function (``transform``,
``filter``, ``aggregate``) once per array element, and the optimizer may
inline an upstream expression into that body. An expensive array expression
referenced from a lambda is then recomputed for every element. A one-element
``inline`` (a Generate node) stops the inlining: everything above it reads
the computed values as plain attributes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def barrier(df: DataFrame) -> DataFrame:
    return df.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))
