"""Demographic features: one-hot categories and age."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import slug

# The wide form has one column per category; beyond this many, use the long form.
MAX_COLUMNS = 2_000


def categories(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct ``(column, category)`` slugs of all the columns, in one scan."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), slug(_text(c)).alias("category")) for c in columns])
    return df.select(F.inline(cells)).distinct()


def _text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def latest(df: DataFrame, pid: Column, columns: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per patient: the values of its last record in ``order``."""
    return (
        df.select(pid.cast("string").alias("pid"), F.struct(*columns).alias("_v"), F.struct(*order).alias("_o"))
        .groupBy("pid").agg(F.max_by("_v", "_o").alias("_v")).select("pid", "_v.*")
    )


def one_hot(df: DataFrame, age: str, columns: Sequence[str], seen: DataFrame | None = None) -> DataFrame:
    """``pid``, the age as integer (null if not a number), then one 0/1 column per category, in the
    order of ``columns`` and alphabetically within each. Categories are those of ``seen``, all records
    rather than each patient's last, where it is given."""
    found = categories(df if seen is None else seen, columns).limit(MAX_COLUMNS + 1).collect()
    if len(found) > MAX_COLUMNS:
        raise ValueError(f"more than {MAX_COLUMNS} categories; use one_hot_long")
    names = {c: sorted(r["category"] for r in found if r["column"] == c) for c in columns}
    slugs = df.select("pid", F.expr(f"try_cast(`{age}` AS int)").alias(age),
                      *[slug(_text(c)).alias(f"_{c}") for c in columns])
    return slugs.select(
        "pid", age,
        *[(F.col(f"_{c}") == name).cast("int").alias(f"{c}_{name}") for c in columns for name in names[c]],
    )


def one_hot_long(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The non-zero cells of the one-hot matrix ``(pid, column_name)``, for any number of categories."""
    cells = F.array(*[F.concat(F.lit(f"{c}_"), slug(_text(c))) for c in columns])
    return df.select("pid", F.explode(cells).alias("column_name"))


def demographic_vector(wide: DataFrame, age: str) -> tuple[DataFrame, list[str]]:
    """``(pid, vec)`` and the names of its numbers, for use beside text vectors.

    A patient without a readable age stays, with age 0 and a flag of its own.
    """
    names = [c for c in wide.columns if c != "pid"]
    cells = [F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in names]
    missing = F.col(age).isNull().cast("double")
    return wide.select("pid", F.array(*cells, missing).alias("vec")), [*names, f"{age}_missing"]


def age_report(rows: DataFrame, age: str) -> DataFrame:
    """One row: records, records without an age, and records whose age is not a number."""
    text = F.trim(_text(age))
    return rows.agg(F.count("*").alias("num_rows"), F.count_if(text == "").alias("no_age"),
                    F.count_if((text != "") & F.expr(f"try_cast(`{age}` AS int)").isNull()).alias("bad_ages"))


