"""History cohorts: how long and how often a patient was seen, from note dates."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from . import bitmaps


@dataclass(frozen=True)
class HistoryRules:
    # The bounds of a usable history.
    first_before: str = "2010-01-01"
    last_after: str = "2009-01-01"
    min_dates: int = 3
    min_days: int = 180


FLAGS = ("total", "first_before", "last_after", "enough_dates", "enough_days")
USED = ("total", "enough_dates", "enough_days", "last_after")


def note_days(notes: DataFrame, pid: Column, day: Column) -> DataFrame:
    """Distinct ``(pid, day)``. The distinct is on both columns, so a patient with
    very many notes spreads over the cluster and leaves at most one row per calendar day."""
    return notes.select(pid.cast("string").alias("pid"), day.cast("date").alias("day")) \
        .where(F.col("day").isNotNull()).distinct()


def date_report(notes: DataFrame, text: Column, day: Column) -> DataFrame:
    """One row: records, records without a date, and records whose date cannot be read as ``day``."""
    written = F.trim(F.coalesce(text.cast("string"), F.lit("")))
    return notes.agg(F.count("*").alias("num_rows"), F.count_if(written == "").alias("no_date"),
                     F.count_if((written != "") & day.isNull()).alias("bad_dates"))


def note_dates(days: DataFrame) -> DataFrame:
    """``(pid, dates)``: each patient's days in ascending order."""
    return days.groupBy("pid").agg(F.sort_array(F.collect_list("day")).alias("dates"))


def history(days: DataFrame) -> DataFrame:
    """First day, last day, number of days and span in days per patient."""
    return (
        days.groupBy("pid")
        .agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("num_dates"))
        .withColumn("span_days", F.datediff("last_day", "first_day"))
    )


def history_flags(histories: DataFrame, rules: HistoryRules = HistoryRules()) -> DataFrame:
    return (
        histories.withColumn("total", F.lit(True))
        .withColumn("first_before", F.col("first_day") < F.lit(rules.first_before).cast("date"))
        .withColumn("last_after", F.col("last_day") > F.lit(rules.last_after).cast("date"))
        .withColumn("enough_dates", F.col("num_dates") >= rules.min_dates)
        .withColumn("enough_days", F.col("span_days") >= rules.min_days)
    )


def flag_overlap(flags: DataFrame) -> DataFrame:
    """``(flag, other, patients)``: each flag's size (``other`` empty) and every pair's overlap,
    all counted in one aggregation."""
    cells = [(a, "") for a in FLAGS] + list(combinations(FLAGS, 2))
    counts = flags.agg(*[
        F.count_if(F.col(a) & (F.col(b) if b else F.lit(True))).alias(f"c{i}") for i, (a, b) in enumerate(cells)
    ])
    rows = F.array(*[
        F.struct(F.lit(a).alias("flag"), F.lit(b).alias("other"), F.col(f"c{i}").alias("patients"))
        for i, (a, b) in enumerate(cells)
    ])
    return counts.select(F.inline(rows))


def flag_overlap_of(sets: DataFrame) -> DataFrame:
    """The same from stored bitmaps ``(flag, block, bits)``."""
    order = F.array(*[F.lit(f) for f in FLAGS])
    known = sets.sparkSession.createDataFrame([(a, b) for a in FLAGS for b in ("", *FLAGS)], "flag string, other string")
    wanted = known.where((F.col("other") == "") | (F.array_position(order, F.col("flag")) < F.array_position(order, F.col("other"))))
    alone = bitmaps.sizes(sets, ["flag"]).select("flag", F.lit("").alias("other"), "patients")
    found = alone.unionByName(bitmaps.overlaps(sets, "flag").where("flag <> other"))
    return wanted.join(found, ["flag", "other"], "left").select("flag", "other", F.coalesce("patients", F.lit(0)).alias("patients"))


def history_cohort(flags: DataFrame) -> DataFrame:
    """Patients with enough dates over enough days, seen late enough. The first-date flag is not used."""
    condition = F.col(USED[0])
    for name in USED[1:]:
        condition = condition & F.col(name)
    return flags.where(condition).select("pid")
