"""Connected components of an undirected edge table, as alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.session import ensure_checkpoint_dir

MAX_ROUNDS = 60


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): every id of an edge with the smallest id it can reach (itself if that is the smallest).

    Every round points the larger neighbours of each id to its smallest neighbour and then each id's smaller neighbours to
    the smallest of them; both steps are a partial aggregate and a join on the id, which AQE can split for a hot id. Rounds are
    checkpointed. Null ends and loops are ignored; an empty table gives an empty result."""
    spark = edges.sparkSession
    ensure_checkpoint_dir(spark)
    e = (edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a is not null and a <> b").distinct())
    e = e.checkpoint(eager=True)
    state = None
    for _ in range(MAX_ROUNDS):
        now = e.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if state == (now.n, now.x):
            break
        state = (now.n, now.x)
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        linked = large.join(low, "a")
        e = (linked.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
             .unionByName(low.select("a", F.col("m").alias("b"))).distinct().checkpoint(eager=True))
    else:
        raise RuntimeError("components did not converge")
    return (e.select(F.col("a").alias("id"), F.col("b").alias("component"))
            .unionByName(e.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct())
