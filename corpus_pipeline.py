"""A corpus-cleaning pipeline over ``documents``: five operators of ``furrow.llm`` in a row.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; ``run`` writes each result as Parquet in the
session's shared folder and reads it again. All but the last stage return the columns of ``documents``.

Rows with a null doc_id stay where no rule speaks against them (they are nobody's copy). Extra columns pass through. An empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm import decontam, language, nearcopies, pieces, substring
from furrow.session import scratch_path
from furrow.sources.tables import table

#: A document is rejected if it has no language or less than this share of its words is of one language.
MIN_LANGUAGE_SHARE = 0.5
MIN_REPEAT_WORDS = 50
SHINGLE, PERCENT = 4, 80
PIECE_SEED = 7


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a language: null, letterless, or a mixture without a main language."""
    model = language.learn(language.training_rows(docs))
    return language.keep_identified(docs, model, MIN_LANGUAGE_SHARE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of every group of near copies; of equal rows with one doc_id, one stays."""
    out = nearcopies.near_copies(docs, shingle=SHINGLE, percent=PERCENT)
    gone = out.where("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti")
    again = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if not again.isEmpty():
        kept = kept.join(again, "doc_id", "left_anti").unionByName(
            kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]))
    return kept.select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes words that repeat a passage of an earlier document; texts with nothing left go, untouched texts stay as they are."""
    out = substring.remove_repeats(docs, min_words=MIN_REPEAT_WORDS, carry=True)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("row.text"))
    new = {"text": text, "n_chars": F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("row.n_chars"))}
    return (out.where("n_removed = 0 or n_removed < n_words")
            .select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns]))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a benchmark item is found."""
    return decontam.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_pieces, pieces, lossless): sampled pieces, decoded again for the check."""
    vocabulary = pieces.load(pieces.MODEL_PATH)
    back = pieces.encode(docs.select("doc_id", "lang", "source", "text"), vocabulary, seed=PIECE_SEED, decoded="decoded")
    return back.select("doc_id", "lang", "source", F.size("pieces").cast("long").alias("n_pieces"), "pieces",
                       F.equal_null("decoded", "text").alias("lossless"))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontaminate", decontaminate),
    ("encode_pieces", encode_pieces),
]

#: Estimated similarity, fitted models and sampled pieces are not SQL; the result is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
