"""The code list: fixed-width code and description, with lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import strip_space

# Fixed value: characters of the code column.
CODE_WIDTH = 8


def parse_codes(lines: DataFrame, order: Column | None = None) -> DataFrame:
    """``(code, description)`` from one-column text lines; of repeated codes the last line counts."""
    value = F.col(lines.columns[0])
    parsed = lines.select(
        strip_space(F.substring(value, 1, CODE_WIDTH)).alias("code"),
        strip_space(value.substr(F.lit(CODE_WIDTH + 1), F.length(value))).alias("description"),
        (F.monotonically_increasing_id() if order is None else order).alias("_line"),
    )
    return parsed.groupBy("code").agg(F.max_by("description", "_line").alias("description"))


def read_codes(spark: SparkSession, path: str) -> DataFrame:
    return parse_codes(spark.read.text(path))


def describe(df: DataFrame, code: Column, codes: DataFrame, name: str = "description") -> DataFrame:
    """Add the description of each code (upper-cased, dots removed), or the empty string."""
    known = codes.select(F.col("code").alias("_known"), F.col("description").alias("_description"))
    return (
        df.withColumn("_code", F.upper(F.replace(code, F.lit("."), F.lit(""))))
        .join(known, F.col("_code") == F.col("_known"), "left")
        .withColumn(name, F.coalesce("_description", F.lit("")))
        .drop("_code", "_known", "_description")
    )


def codes_like(codes: DataFrame, pattern: str) -> DataFrame:
    """Codes that begin with a match of ``pattern``, in any case."""
    return codes.where(F.col("code").rlike(f"(?i)^(?:{pattern})")).select("code")


def codes_about(codes: DataFrame, pattern: str) -> DataFrame:
    """Codes whose description holds a match of ``pattern``, in any case."""
    return codes.where(F.col("description").rlike(f"(?i)(?:{pattern})")).select("code")
