"""What a run leaves behind: results, patient lists, a manifest, and documents for review."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from ..operators.evaluate import list_overlap, report
from .training import CASE_WEIGHT


def patient_lists(data: DataFrame, run: str) -> DataFrame:
    """``(run, kind, pid)`` of the training and the test patients."""
    return data.select(F.lit(run).alias("run"),
                       F.when(F.col("is_test"), "test").otherwise("train").alias("kind"), "pid")


def manifest(data: DataFrame, run: str, models: list[str], case_weight: float = CASE_WEIGHT) -> DataFrame:
    """One row on the run: patients per part, models, and the case weight really used."""
    return data.agg(F.count_if(~F.col("is_test")).alias("train_patients"),
                    F.count_if("is_test").alias("test_patients")).select(
        F.lit(run).alias("run"), "train_patients", "test_patients",
        F.lit(",".join(models)).alias("models"), F.lit(float(case_weight)).alias("case_weight"),
    )


def classification(said: DataFrame, run: str, model: str, tables: str) -> DataFrame:
    """The classification report of the test patients among ``said``, tagged with its run."""
    return report(said.where("is_test")).select(
        F.lit(run).alias("run"), F.lit(model).alias("model"), F.lit(tables).alias("tables"), "*")


def false_positive_overlap(lists: DataFrame) -> DataFrame:
    """Overlap of all false-positive lists, training ones included, per run."""
    chosen = lists.where(F.col("kind").isin("false_positives", "false_positives_train"))
    name = F.concat_ws("/", "model", "kind", "tables")
    return list_overlap(chosen.select(name.alias("list"), "pid"), lists.select(name.alias("list")).distinct()
                        .where(F.col("list").contains("/false_positives")))


def review_export(patients: DataFrame, documents: Mapping[str, DataFrame]) -> DataFrame:
    """``(pid, table_no, table, part, text)``: the listed patients' documents of every table, in reading
    order. Sort by ``pid, table_no, part`` where a file is written."""
    tables = [
        df.select("pid", F.lit(i).alias("table_no"), F.lit(name).alias("table"), "part", "text")
        for i, (name, df) in enumerate(documents.items())
    ]
    everything = tables[0]
    for other in tables[1:]:
        everything = everything.unionByName(other)
    return everything.join(patients.select("pid").distinct(), "pid", "left_semi")


def write_review(export: DataFrame, path: str) -> None:
    """Text files in reading order, with a heading before each patient and table."""
    heading = F.when(F.col("part") == 0, F.concat(
        F.lit("\n===== patient "), "pid", F.lit(" : "), "table", F.lit(" =====\n"))).otherwise(F.lit(""))
    (
        export.repartitionByRange("pid", "table_no", "part").sortWithinPartitions("pid", "table_no", "part")
        .select(F.concat(heading, "text")).write.mode("overwrite").text(path)
    )
