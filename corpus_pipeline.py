"""The corpus pipeline over ``documents``; each stage is one operator of ``cohortlens.llm``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cohortlens.llm import line_quality, mixing, near_dedup, packing, passage_dedup
from cohortlens.llm.common import saved, table


def words(text: Column) -> Column:
    """Tokens of a text for weights and lengths: its words and an end mark; none if it is null or blank."""
    n = F.regexp_count(text, F.lit(r"\S+"))
    return F.when(n > 0, n + 1).otherwise(0)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier rejects go."""
    return line_quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that resemble one another, one row with the smallest id stays."""
    return near_dedup.keep_one_row(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages leave the texts; every document stays, and ``n_chars`` follows."""
    return passage_dedup.without_repeats(docs).withColumn("n_chars", F.length("text").cast("bigint"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens are balanced over sources, languages and topics."""
    axes = {"source": F.col("source"), "lang": F.col("lang"), "topic": mixing.topic(F.col("text"))}
    return mixing.mix(docs, axes, words(F.col("text")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces of the documents in bins of the permitted lengths."""
    return packing.pack(docs, words(F.col("text")))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages),
          ("mixture", mixture), ("packing", packed)]
# The classifier and the packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs
