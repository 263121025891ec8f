"""Cohorts: sets of patients from code-prefix rules, and set algebra on them.

A cohort is a DataFrame ``(pid)``; several at once are ``(cohort, pid)``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage

# Resolved rules are sent to every executor up to this many rows.
BROADCAST_ROWS = 2_000_000
# Disease groups by code prefix, punctuation removed. ``case`` is the target disease.
DISEASE_RULES: dict[str, dict[str, list[str]]] = {
    "heartfailure": {
        "icd10": ["I0981", "I50"],
        "icd9": ["39891", "40201", "40211", "40291", "40401", "40403", "40411", "40413", "40491", "40493",
                 "425", "428"],
    },
    "neuropathy": {
        "icd10": ["G54", "G55", "G56", "G57", "G58", "G59", "G60", "G61", "G62", "G63", "G64", "G90", "G990"],
        "icd9": ["337", "353", "354", "355", "356", "357"],
    },
    "case": {"icd10": ["E85"], "icd9": ["2773"]},
}


def normal_code(code: Column) -> Column:
    """A code without punctuation: ``I09.81`` becomes ``I0981``."""
    return F.regexp_replace(F.coalesce(code, F.lit("")), "[^0-9a-zA-Z]+", "")


def _begins_with_any(code: Column, prefixes: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.startswith(code, F.lit(p)) for p in prefixes], F.lit(False))


def code_cohorts(diagnoses: DataFrame, pid: Column, codes: Mapping[str, Column],
                 rules: Mapping[str, Mapping[str, Sequence[str]]]) -> DataFrame:
    """``(cohort, pid)`` for every rule in one scan: a patient belongs where any code begins
    with any of the cohort's prefixes for that code system.

    The rules are expressions, so the scan reads the id and code columns only. Rows collapse to one
    row of flags per patient before the shuffle, however many diagnoses a patient has.
    """
    normal = diagnoses.select(pid.cast("string").alias("pid"),
                              *[normal_code(c).alias(f"_{name}") for name, c in codes.items()])
    names = list(rules)
    flags = normal.groupBy("pid").agg(*[
        F.bool_or(reduce(
            lambda a, b: a | b,
            [_begins_with_any(F.col(f"_{system}"), prefixes) for system, prefixes in rules[name].items()],
        )).alias(f"_in{i}")
        for i, name in enumerate(names)
    ])
    held = F.array_compact(F.array(*[F.when(F.col(f"_in{i}"), F.lit(name)) for i, name in enumerate(names)]))
    return flags.select(F.explode(held).alias("cohort"), "pid")


def prefix_join(codes: DataFrame, rules: DataFrame) -> DataFrame:
    """``(cohort, pid)`` where rules are themselves a table ``(cohort, system, prefix)`` of any size.

    ``codes`` is ``(pid, system, code)``. Each distinct code is resolved to its cohorts once, by
    equality of one of its beginnings with a prefix; the facts then meet that small table on the code alone.
    The facts are moved once, to their patients: a patient's codes are made distinct there, and so are the
    cohorts that they lead to, so that no list of cohorts per code is ever shuffled.
    """
    facts = codes.select("pid", "system", normal_code(F.col("code")).alias("_code"))
    beginnings = (
        facts.select("system", "_code").distinct()
        .select("system", "_code", F.explode(F.sequence(F.lit(0), F.length("_code"))).alias("_n"))
        .select("system", "_code", F.col("_code").substr(F.lit(1), F.col("_n")).alias("prefix"))
    )
    resolved = cut_lineage(
        beginnings.join(rules.select("cohort", "system", "prefix").distinct(), ["system", "prefix"])
        .select("cohort", "system", "_code").distinct()
    )
    # Only a table that is known to be small is sent to every executor; a larger one is joined by code as Spark decides.
    if resolved.count() <= BROADCAST_ROWS:
        resolved = F.broadcast(resolved)
    own = facts.repartition("pid").distinct()
    return own.join(resolved, ["system", "_code"]).select("cohort", "pid").distinct()


def require_members(cohorts: DataFrame, names: Sequence[str]) -> DataFrame:
    """``cohorts``, or an error naming those of ``names`` without a single patient."""
    found = {row["cohort"] for row in cohorts.where(F.col("cohort").isin(list(names))).select("cohort").distinct().collect()}
    missing = [name for name in names if name not in found]
    if missing:
        raise ValueError(f"no patient was found for: {', '.join(missing)}")
    return cohorts


def members(cohorts: DataFrame, name: str) -> DataFrame:
    return cohorts.where(F.col("cohort") == name).select("pid")


def union(*cohorts: DataFrame) -> DataFrame:
    return reduce(DataFrame.union, [c.select("pid") for c in cohorts]).distinct()


def intersection(*cohorts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.join(b.select("pid"), "pid", "left_semi"), [c.select("pid") for c in cohorts]).distinct()


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.select("pid").join(right.select("pid"), "pid", "left_anti").distinct()


def restrict(df: DataFrame, cohort: DataFrame | None) -> DataFrame:
    """Rows of the cohort's patients. ``None`` keeps all; an empty cohort keeps none."""
    return df if cohort is None else df.join(cohort.select("pid"), "pid", "left_semi")


def label(df: DataFrame, cases: DataFrame, name: str = "label") -> DataFrame:
    """Add 1 for patients among ``cases``, else 0. ``df`` should be one row per patient by then."""
    marked = cases.select("pid").distinct().withColumn("_case", F.lit(1))
    return df.join(marked, "pid", "left").withColumn(name, F.coalesce("_case", F.lit(0))).drop("_case")
