"""Session helpers: defaults for local runs and the lineage-cutting folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "cohortlens", cpus: int | str = "*", shuffle_partitions: int = 8,
                  memory: str = "16g") -> SparkSession:
    """A session for tests and benches; on a cluster the caller brings their own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.scheduler.mode", "FAIR")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_folder(spark: SparkSession) -> str:
    """The shared folder for intermediate results: the session's ``spark.checkpoint.dir``.

    A temporary folder is made only where that is unset and the master is local.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current is not None:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        folder = tempfile.mkdtemp(prefix="cohortlens-checkpoint-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir()


FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Of the queries that are made within, shuffle files go when the query ends. For steps whose results are files or are on
    the driver: nothing reads their shuffles again, and else these stay until the driver happens to collect its garbage."""
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREE_SHUFFLES) if before is None else spark.conf.set(FREE_SHUFFLES, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, so that a lost executor never changes a result
    that depends on physical row placement."""
    work_folder(df.sparkSession)
    with shuffles_freed(df.sparkSession):
        # A new frame, as its query is made here.
        return df.select("*").checkpoint()


def settled(df: DataFrame) -> DataFrame:
    """The same as compressed files, without any order of rows; ``unsettle`` deletes them where no later step reads them."""
    spark = df.sparkSession
    path = f"{work_folder(spark)}/settled-{uuid.uuid4().hex}"
    with shuffles_freed(spark):
        df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.path = path
    return found


def unsettle(*tables: DataFrame) -> None:
    for df in tables:
        target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.path)
        target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def keep(df: DataFrame) -> DataFrame:
    """Persist a result that several jobs read, spilling to disk where memory is short."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)
