"""Join helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame


def attach_small(big: DataFrame, small: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join an aggregate-sized side (vocabulary, per-group statistics).

    No broadcast hint: with AQE on, Spark measures the materialised small side
    at run time and switches to a broadcast join only when it is under
    ``spark.sql.adaptive.autoBroadcastJoinThreshold``; beyond that it stays a
    shuffled join. Literal dimensions and 1-row aggregates use an explicit
    ``broadcast`` at their call sites instead, since their size is fixed.
    """
    return big.join(small, on, how)
