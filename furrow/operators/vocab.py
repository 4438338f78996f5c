"""Vocabularies derived from data, and the first of their items that a text contains.

A vocabulary may grow with the data, so its size is measured: a small one travels as one
broadcast row, a large one is matched by an equi-join on the leading characters of its items.
Both ways give the same result and neither drops an item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.functions import text as tx

#: A vocabulary of at most this many bytes is broadcast as one sorted array.
BROADCAST_BYTES = 1_000_000
#: Leading characters of an item that the join matches; shorter items match whole.
GRAM = 8


def distinct_values(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """(name, v): the distinct non-null values of every listed column, found in one pass."""
    pairs = F.array(*[F.struct(F.lit(name).alias("name"), F.col(c).cast("string").alias("v")) for name, c in columns.items()])
    return df.select(F.inline(pairs)).filter(F.col("v").isNotNull()).distinct()


def _item_key(v: Column, strip: bool) -> Column:
    return F.lower(tx.strip_ws(v)) if strip else F.lower(v)


def _match_by_join(df: DataFrame, text_col: str, values: DataFrame, name: str, strip: bool) -> DataFrame:
    """Adds ``name`` by joining the texts' character windows with the items' leading characters."""
    items = values.select("v", _item_key(F.col("v"), strip).alias("key"))
    gram = F.left(F.col("key"), F.lit(GRAM))
    lengths = sorted(r[0] for r in items.select(F.length(gram)).distinct().collect() if r[0])  # at most GRAM numbers
    whole = items.agg(F.min("v").alias("_first"), F.min(F.when(F.col("key") == "", F.col("v"))).alias("_any"))
    low = F.lower(F.col(text_col))
    texts = df.select(low.alias("_t")).filter(F.col("_t").isNotNull()).distinct()
    found = None
    for n in lengths:
        starts = F.sequence(F.lit(1), F.length("_t") - F.lit(n - 1))
        windows = F.array_distinct(F.transform(starts, lambda p: F.substring(F.col("_t"), p, n)))
        part = texts.filter(F.length("_t") >= n).select("_t", F.explode(windows).alias("gram"))
        found = part if found is None else found.unionByName(part)
    if found is None:  # only empty items
        hits = texts.select("_t", F.lit(None).cast("string").alias("_hit"))
    else:
        hits = found.join(items.filter("key <> ''").withColumn("gram", gram), "gram") \
            .filter(F.contains("_t", "key")).groupBy("_t").agg(F.min("v").alias("_hit"))
    # `whole` is one row; an item with an empty key is contained in every text.
    out = df.withColumn("_low", low).join(hits, F.col("_low") == F.col("_t"), "left").crossJoin(F.broadcast(whole))
    any_text = F.when(F.col("_low").isNotNull(), F.col("_any"))
    return out.withColumn(name, F.coalesce(F.least("_hit", any_text), F.col("_first"))) \
        .drop("_low", "_t", "_hit", "_first", "_any")


def attach_first_contained(df: DataFrame, text_col: str, values: DataFrame, names: list[str], strip: set[str] | tuple = (),
                           broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """For each name: the first item (code-point order) that the lower-cased text contains, else the first item.

    ``values`` is a (name, v) table of ``distinct_values``; items of names in ``strip`` are compared without outer white
    space. The table is checkpointed once and measured (one row a name). An empty vocabulary gives NULL.
    """
    from furrow.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    values = values.checkpoint(eager=True)
    size = {r["name"]: r["b"] for r in values.groupBy("name").agg(F.sum(F.octet_length("v") + 8).alias("b")).collect()}
    for name in names:
        mine = values.filter(F.col("name") == name).select("v")
        if size.get(name, 0) <= broadcast_bytes:
            # keys are made once in the broadcast row, the text is lower-cased once below the join
            key = _item_key(F.col("v"), name in strip)
            row = mine.agg(F.array_sort(F.collect_list(F.struct("v", key.alias("key")))).alias("_items"))
            df = df.withColumn("_low", F.lower(F.col(text_col))).crossJoin(F.broadcast(row)) \
                .withColumn(name, tx.first_keyed(F.col("_low"), F.col("_items"))) \
                .drop("_items", "_low")
        else:
            df = _match_by_join(df, text_col, mine, name, name in strip)
    return df
