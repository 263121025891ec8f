"""The Parquet store: patient-split tables and named results."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.keys import (BUCKET, BUCKETS_PER_FOLDER, FIRST_TEST_BUCKET, FOLDER, NUM_BUCKETS, bucket, bucket_of,
                              folder)
from ..session import shuffles_freed
from .catalog import ID

N_CHARS = "n_chars"
# Small enough that a patient's row group holds little else.
ROW_GROUP_BYTES = 16 << 20
# Patients whose ids may stand in a filter; more are joined.
MOST_IDS = 400


def write_split(df: DataFrame, path: str, pid: str = ID, text: Sequence[str] = (), mode: str = "errorifexists") -> None:
    """Write a table in patient folders, with its hash bucket and (for text tables) its text size.

    The rebalance hint lets Spark size the files of each folder by data volume, so a folder that
    holds one huge patient becomes many files instead of one task. Files are sorted by bucket and
    id, and every row group has a Bloom filter of its ids, so a lookup reads the row groups that hold its patient and skips the others.
    """
    rows = df.withColumn(BUCKET, bucket(F.col(pid))).withColumn(FOLDER, folder(F.col(BUCKET)))
    if text:
        size = sum((F.coalesce(F.length(c), F.lit(0)).cast("bigint") for c in text), F.lit(len(text) - 1).cast("bigint"))
        rows = rows.withColumn(N_CHARS, size)
    placed = rows.hint("rebalance", F.col(FOLDER)).sortWithinPartitions(FOLDER, BUCKET, pid)
    options = {"parquet.block.size": ROW_GROUP_BYTES, f"parquet.bloom.filter.enabled#{pid}": "true", "parquet.bloom.filter.adaptive.enabled": "true"}
    placed.write.mode(mode).options(**options).partitionBy(FOLDER).parquet(path)


def read_split(spark: SparkSession, path: str, columns: Sequence[str] | None = None, where: Column | None = None,
               training_only: bool = False) -> DataFrame:
    """Scan with column projection and a predicate; ``training_only`` prunes to the train folders."""
    rows = spark.read.parquet(path)
    if training_only:
        rows = rows.where(F.col(FOLDER) < FIRST_TEST_BUCKET // BUCKETS_PER_FOLDER)
    if where is not None:
        rows = rows.where(where)
    return rows if columns is None else rows.select(*columns)


def lookup(spark: SparkSession, path: str, pid: str, id_column: str = ID,
           columns: Sequence[str] | None = None) -> DataFrame:
    """One patient's rows: one folder is opened and the bucket and id filters reach its files."""
    return read_split(spark, path, columns, _any_of([pid], id_column))


def read_patients(spark: SparkSession, path: str, cohort: DataFrame, id_column: str = ID, columns: Sequence[str] | None = None) -> DataFrame:
    """The rows of the patients ``(pid)`` of a cohort.

    The ids of a small cohort stand in the filter of the scan, which opens their folders only and there the row groups whose
    buckets, ids and Bloom filters allow one of them. A larger cohort is joined by folder, bucket and id, so that Spark prunes folders by what
    it finds in the cohort. An empty cohort has no rows.
    """
    few = [r.pid for r in cohort.select("pid").where(F.col("pid").isNotNull()).distinct().limit(MOST_IDS + 1).collect()]
    if len(few) <= MOST_IDS:
        return read_split(spark, path, columns, _any_of(few, id_column))
    rows = read_split(spark, path)
    number = bucket(F.col("pid"))
    wanted = cohort.select("pid", number.alias("_bucket"), folder(number).alias("_folder")).distinct()
    same = (F.col(FOLDER) == F.col("_folder")) & (F.col(BUCKET) == F.col("_bucket")) & (F.col(id_column) == F.col("_pid"))
    found = rows.join(wanted.withColumnRenamed("pid", "_pid"), same, "left_semi")
    return found if columns is None else found.select(*columns)


def _any_of(ids: Sequence[str], id_column: str) -> Column:
    """One of the ids, as equalities that reach the Parquet reader one by one."""
    numbers = [bucket_of(i, NUM_BUCKETS) for i in ids]
    if not ids:
        return F.lit(False)
    each = [(F.col(BUCKET) == n) & (F.col(id_column) == i) for n, i in zip(numbers, ids)]
    while len(each) > 1:
        each = [reduce(or_, each[i:i + 2]) for i in range(0, len(each), 2)]
    return F.col(FOLDER).isin(sorted({n // BUCKETS_PER_FOLDER for n in numbers})) & each[0]


def save(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Replace a named result and return it as read back, so later jobs start from the files."""
    with shuffles_freed(df.sparkSession):
        df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.parquet(path)


def replace(df: DataFrame, path: str, *key: str) -> None:
    """Put ``df`` under its key in the results at ``path``, in place of what an earlier run wrote under it, also if ``df`` is empty.

    Every key has a folder of its own, named by a digest; the values of the key stay columns of the rows, with their types.
    """
    name = hashlib.sha256("\0".join(key).encode()).hexdigest()[:32]
    df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_all(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all keys at ``path``. A key's rows are files of their own, so a filter on it skips the files of others."""
    return spark.read.option("recursiveFileLookup", True).parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a named result if it is there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def write_counts(counts: DataFrame, path: str, key: str = "token", value: str = "cnt") -> None:
    """A tab-separated list in descending order of its value."""
    counts.orderBy(F.desc(value), F.asc(key)).select(key, value).write.mode("overwrite") \
        .options(sep="\t", quote="").csv(path)


def read_counts(spark: SparkSession, path: str, key: str = "token", value: str = "cnt",
                value_type: str = "bigint") -> DataFrame:
    return spark.read.schema(f"`{key}` string, `{value}` {value_type}").options(sep="\t", quote="").csv(path)
