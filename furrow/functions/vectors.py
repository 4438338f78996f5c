"""Vector columns: distances and a hashed bag-of-words text encoder."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from furrow.functions.hashing import h32

TOKEN_SPLIT = r"[^\p{L}\p{N}]+"


def as_double(vec: Column) -> Column:
    return vec.cast("array<double>")


def sq_l2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two equal-length arrays, summed left to right in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, v: acc + v)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def tokens(text: Column) -> Column:
    """Lower-cased letter/digit runs of a text."""
    return F.filter(F.split(F.lower(text), TOKEN_SPLIT), lambda t: F.length(t) > 0)


def bucket_counts(text: Column, dim: int = 64) -> Column:
    """Token -> md5 bucket; per-bucket counts as ARRAY<DOUBLE> (one fold over the tokens)."""
    buckets = F.transform(tokens(text), lambda t: (h32("tok", t) % dim).cast("int"))
    zero = F.array_repeat(F.lit(0.0), dim)
    return F.aggregate(buckets, zero, lambda acc, b: F.transform(
        acc, lambda v, i: v + F.when(i == b, F.lit(1.0)).otherwise(F.lit(0.0))))


def with_hashed_embedding(df, text_col: str, out: str, dim: int = 64):
    """Add a unit-length bag-of-words vector of ``text_col`` (NULL for empty texts).

    A stand-in for a pretrained sentence encoder (not available offline).
    """
    from furrow.operators.barrier import barrier
    c = barrier(df.withColumn("_counts", bucket_counts(F.col(text_col), dim)))
    c = barrier(c.withColumn("_norm", F.sqrt(F.aggregate("_counts", F.lit(0.0), lambda acc, v: acc + v * v))))
    return c.withColumn(out, F.when(F.col("_norm") > 0, F.transform("_counts", lambda v: v / F.col("_norm")))) \
        .drop("_counts", "_norm")
