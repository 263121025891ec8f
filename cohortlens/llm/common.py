"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cohortlens.session import work_folder

# While a step is written: shuffle files go when it ends, and Python workers get texts a few megabytes at a time.
STEP_SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}
ROW_GROUP_BYTES = 16 << 20


@contextmanager
def step(spark: SparkSession) -> Iterator[None]:
    """STEP_SETTINGS hold within."""
    before = {name: spark.conf.get(name, None) for name in STEP_SETTINGS}
    for name, value in STEP_SETTINGS.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new table in the shared work folder and read it back.

    The lineage ends in files that every executor reaches, so a lost executor never repeats the
    work before this point and never changes a result that depends on row placement. The shuffle
    files of the step are removed when it ends, as nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with step(spark):
        df.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``saved`` that no later step reads."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def apart(docs: DataFrame, **columns: Column) -> DataFrame:
    """``docs`` as one column ``row``, beside named ones: no name of its columns can clash with these."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c.alias(name) for name, c in columns.items()])


def rejoined(df: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of ``docs`` again from ``row``, some of them changed."""
    return df.select(*[changed[c].alias(c) if c in changed else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def fold(key: Column, folds: int) -> Column:
    """The fold of a row: the CRC-32 of its id as text, modulo ``folds``."""
    return F.crc32(key.cast("string").cast("binary")) % folds


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stretches(text: Column, most: int, key: Column, count: int = 8) -> Column:
    """An array of pieces of a text that hold ``most`` characters at most: the whole text if it is no longer, else ``count``
    stretches from all over it, each at a place that the hash of ``key`` chooses within its share of the text."""
    size, each = F.length(text), max(1, most // count)
    room = (size - each).cast("double") / count

    def stretch(i: int) -> Column:
        place = F.xxhash64(key, F.lit(i)).bitwiseAND(F.lit((1 << 30) - 1)) / F.lit(float(1 << 30))
        return F.substring(text, F.floor(room * (F.lit(i) + place)).cast("int") + 1, F.lit(each))

    return F.when(size <= most, F.array(text)).otherwise(F.array(*[stretch(i) for i in range(count)]))


def words_and_end(text: Column) -> Column:
    """Tokens of a text for weights and lengths: its words and an end mark; none if it is null or blank."""
    n = F.regexp_count(text, F.lit(r"\S+"))
    return F.when(n > 0, n + 1).otherwise(0)


def least_by_hash(df: DataFrame, group: str, key: str, most: int) -> DataFrame:
    """At most about ``most`` rows (group, key) of each group, chosen by the hash of the key: a
    bounded sample that does not depend on row order. Groups of up to ``most`` rows come whole.

    The cut-off follows from the group's size, so no group is ever sorted, gathered or shuffled.
    Callers pass a bounded number of groups (labels, learned languages), as their sizes are broadcast.
    """
    keyed = df.select(F.col(group), F.col(key)).where(F.col(group).isNotNull())
    sizes = keyed.groupBy(group).agg(F.count("*").alias("_n"))
    place = F.xxhash64(F.col(key)).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))
    return keyed.join(F.broadcast(sizes), group).where(place * F.col("_n") < most).select(group, key)
