"""Parquet tables of a scale-factor folder, CSV ingest/egress and training logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

# Tokens a CSV reader of the reference's stack treats as missing.
NULL_TOKENS = ["", "NA", "N/A", "NaN", "nan", "NULL", "null", "None", "#N/A", "-NaN", "n/a", "<NA>"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def normalize_columns(df: DataFrame) -> DataFrame:
    """Strip surrounding whitespace from every column name."""
    return df.toDF(*[c.strip() for c in df.columns])


def trim_strings(df: DataFrame) -> DataFrame:
    """Strip all surrounding whitespace from every string cell (numbers untouched)."""
    from furrow.functions.text import strip_ws
    return df.select(*[
        strip_ws(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN in floating columns becomes NULL (NaN would pass '> 0' in Spark)."""
    return df.select(*[
        F.when(F.isnan(F.col(f"`{f.name}`")), F.lit(None)).otherwise(F.col(f"`{f.name}`")).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])


def has_quoted_breaks(spark: SparkSession, path: str) -> bool:
    """Whether some line of the files holds an odd number of quotes, so that a quoted cell may run over its end."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not spark.read.text(path).where(quotes % 2 == 1).isEmpty()


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, strip_header: bool = True, strip_cells: bool = False,
             names: list[str] | None = None, infer: bool = False, corrupt_column: str | None = None) -> DataFrame:
    """CSV scan with a header, or with given column names and no header.

    Files are split between tasks unless a quoted line break is found (one pass over the lines decides). All columns are read as
    strings first (so padded headers and cells are tolerated), then null tokens become NULL. With a schema its columns are cast with
    ``try_cast``: a malformed cell becomes NULL instead of failing. With ``infer`` the other columns get the narrowest type that
    holds all their rows. ``corrupt_column`` keeps the line of a row with too few or too many cells (NULL elsewhere); such rows
    take no part in the inference.
    """
    reader = (spark.read.option("header", names is None).option("mode", "PERMISSIVE").option("multiLine", has_quoted_breaks(spark, path))
              .option("quote", '"').option("escape", '"'))
    found = names or reader.csv(path).columns
    fields = [T.StructField(c, T.StringType()) for c in found]
    if corrupt_column:
        fields.append(T.StructField(corrupt_column, T.StringType()))
        reader = reader.option("columnNameOfCorruptRecord", corrupt_column).option("columnPruning", False)
    raw = reader.schema(T.StructType(fields)).csv(path)
    if strip_header:
        raw = normalize_columns(raw)
    keep = raw.columns[len(found):]
    if strip_cells:
        raw = trim_strings(raw)
    cells = {c: F.when(F.col(f"`{c}`").isin(NULL_TOKENS), F.lit(None)).otherwise(F.col(f"`{c}`")) for c in raw.columns[:len(found)]}
    text = raw.select(*[v.alias(c) for c, v in cells.items()], *keep)
    known = {f.name: f.dataType for f in schema} if schema is not None else {}
    if infer:
        whole = text.where(F.col(corrupt_column).isNull()) if corrupt_column else text
        known = {r.column: T._parse_datatype_string(r.type) for r in column_types(whole, [c for c in cells if c not in known]).collect()} | known
    return text.select(*[(F.col(f"`{c}`").try_cast(known[c]) if c in known else F.col(f"`{c}`")).alias(c) for c in cells], *keep)


_INTEGER = r"^[+-]?[0-9]{1,19}$"
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?(inf|Infinity)$"


def column_types(text: DataFrame, columns: list[str]) -> DataFrame:
    """(column, type, n_values, n_missing) of string columns: one aggregate over all rows, then the first type that holds them all.

    The lattice, from the narrowest up: boolean and bigint (both only without missing cells), double (also for a column that is
    missing throughout), string."""
    def counts(c: str) -> Column:
        v = F.col(f"`{c}`")
        ways = {"v": v.isNotNull(), "i": v.rlike(_INTEGER) & v.try_cast("bigint").isNotNull(), "d": v.rlike(_NUMBER), "b": v.isin("True", "False", "true", "false")}
        return F.struct(F.lit(c).alias("column"), F.count(F.lit(1)).alias("n"), *[F.count_if(w).alias(k) for k, w in ways.items()])

    if not columns:
        return text.sparkSession.createDataFrame([], "column string, type string, n_values long, n_missing long")
    r = text.agg(*[counts(c).alias(f"c{i}") for i, c in enumerate(columns)]).select(F.inline(F.array(*[f"c{i}" for i in range(len(columns))])))
    kind = (F.when((F.col("b") == F.col("n")) & (F.col("n") > 0), "boolean").when((F.col("i") == F.col("n")) & (F.col("n") > 0), "bigint")
            .when(F.col("d") == F.col("v"), "double").otherwise("string"))
    return r.select("column", kind.alias("type"), F.col("v").alias("n_values"), (F.col("n") - F.col("v")).alias("n_missing"))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV sink with a header and no index column; cell padding, quotes and line breaks are written as they are."""
    (df.write.mode("overwrite").option("header", True).option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).option("quote", '"').option("escape", '"').csv(path))


LEARN_ERROR_SCHEMA = T.StructType([T.StructField("iter", T.IntegerType()),
                                   T.StructField("MultiClass", T.DoubleType())])
TIME_LEFT_SCHEMA = T.StructType([T.StructField("iter", T.IntegerType()),
                                 T.StructField("Passed", T.DoubleType()),
                                 T.StructField("Remaining", T.DoubleType())])


def read_tsv_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Tab-separated training log with a header line."""
    return spark.read.schema(schema).option("header", True).option("sep", "\t").csv(path)


def read_json_log(spark: SparkSession, path: str) -> DataFrame:
    """Nested JSON training log: one row per iteration (iteration, learn, passed, remaining)."""
    js = spark.read.option("multiLine", True).json(path)
    it = js.select(F.explode("iterations").alias("it"))
    return it.select(F.col("it.iteration").cast("int").alias("iteration"),
                     F.col("it.learn").getItem(0).cast("double").alias("learn"),
                     F.col("it.passed_time").cast("double").alias("passed_time"),
                     F.col("it.remaining_time").cast("double").alias("remaining_time"))
