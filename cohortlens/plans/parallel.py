"""Independent Spark work side by side."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import FIRST_EXCEPTION, ThreadPoolExecutor, wait
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

T = TypeVar("T")


def side_by_side(spark: SparkSession, tasks: Sequence[Callable[[], T]], at_once: int) -> list[T]:
    """The results of ``tasks`` in their order, ``at_once`` of them at a time.

    Each runs in a thread that inherits the caller's job properties, in a scheduler pool of its own, so that with the fair
    scheduler the jobs of all share the executors. When one fails, those that have not begun are left out and its error is raised.
    """
    if at_once <= 1 or len(tasks) <= 1:
        return [task() for task in tasks]

    def pooled(place: int, task: Callable[[], T]) -> T:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"side-{place % at_once}")
        return task()

    with ThreadPoolExecutor(at_once) as threads:
        running = [threads.submit(inheritable_thread_target(spark)(pooled), i, task) for i, task in enumerate(tasks)]
        done, _ = wait(running, return_when=FIRST_EXCEPTION)
        failed = next((f for f in running if f in done and f.exception()), None)
        if failed:
            threads.shutdown(wait=True, cancel_futures=True)
            raise failed.exception()
        return [f.result() for f in running]
