"""Checks and small reports on raw tables: id quality, patient index, bucket census."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.keys import NUM_BUCKETS, bucket, bucket_label
from .ordering import positions

# Fixed value: characters in a valid patient id.
ID_LENGTH = 32


def flag_ids(df: DataFrame, pid: Column, length: int = ID_LENGTH) -> DataFrame:
    """Mark rows whose id has the wrong length; they are kept."""
    return df.withColumn("bad_id", F.coalesce(F.length(pid) != length, F.lit(True)))


def id_report(df: DataFrame, pid: Column, length: int = ID_LENGTH) -> DataFrame:
    flagged = flag_ids(df, pid, length)
    return flagged.agg(F.count("*").alias("num_rows"), F.count_if("bad_id").alias("bad_ids"))


def patient_positions(df: DataFrame, pid: Column, order: Sequence[str]) -> DataFrame:
    """``(pid, row_no)``: the raw positions of every patient's rows, as rows rather than one list per
    patient, so that a patient with very many rows is no obstacle."""
    return positions(df.select(pid.cast("string").alias("pid"), *order), [], order, "row_no").select("pid", "row_no")


def patient_list(df: DataFrame, pid: Column) -> DataFrame:
    """``(pid, position)``: distinct patients and their row in an ordered feature table."""
    return positions(df.select(pid.cast("string").alias("pid")).distinct(), [], ["pid"], "position")


def num_patients(df: DataFrame, pid: Column) -> DataFrame:
    return df.agg(F.count_distinct(pid).alias("num_patients"))


def bucket_census(df: DataFrame, pid: Column, buckets: int = NUM_BUCKETS) -> DataFrame:
    """``(label, patients)`` for every bucket, 0 where none fell."""
    filled = (
        df.select(pid.cast("string").alias("pid")).distinct()
        .groupBy(bucket(F.col("pid"), buckets).alias("bucket")).agg(F.count("*").alias("patients"))
    )
    every = df.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    return every.join(filled, "bucket", "left").select(
        bucket_label(F.col("bucket"), buckets).alias("label"), F.coalesce("patients", F.lit(0)).alias("patients")
    )
