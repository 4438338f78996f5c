"""Extra columns with the names that operators use inside."""

from pyspark.sql import functions as F

from furrow.llm import decontam, pieces
from furrow.llm.words import unused


def test_unused_names():
    assert unused("__text", ["a", "__TEXT", "__text_"]) == "__text__" and unused("x", ["y"]) == "x"


def test_drop_leaks_with_a_column_of_its_own_name(spark, sf, documents):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    plain = decontam.drop_leaks(documents, items)
    extra = decontam.drop_leaks(documents.withColumn("__text", F.lit(1)).withColumn("__TEXT_", F.lit("x")), items)
    assert extra.columns == [*documents.columns, "__text", "__TEXT_"]
    assert sorted(r.doc_id for r in extra.collect()) == sorted(r.doc_id for r in plain.collect())
    assert extra.where("`__text` = 1 and `__TEXT_` = 'x'").count() == plain.count() < documents.count()


def test_encode_with_columns_of_its_own_names(make):
    v = pieces.load(pieces.MODEL_PATH)
    docs = make([(1, "some text here"), (None, None), (2, "")])
    plain = {r.doc_id: (r.pieces, r.d) for r in pieces.encode(docs, v, seed=3, decoded="d").collect()}
    extra = pieces.encode(docs.withColumn("__text", F.lit("no")).withColumn("__key", F.lit(9)).withColumn("d", F.lit(0)), v, seed=3, decoded="d")
    assert {r.doc_id: (r.pieces, r.d) for r in extra.collect()} == plain
    assert extra.where("`__text` = 'no' and `__key` = 9").count() == 3
