"""Evaluation of binary predictions held as ``(pid, label, prediction)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import bitmaps


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def confusion(predictions: DataFrame) -> DataFrame:
    """One row: tp, fp, tn, fn, sensitivity and specificity (0 where undefined)."""
    truth, said = F.col("label") == 1, F.col("prediction") == 1
    counts = predictions.agg(
        F.count_if(truth & said).alias("tp"), F.count_if(~truth & said).alias("fp"),
        F.count_if(~truth & ~said).alias("tn"), F.count_if(truth & ~said).alias("fn"),
    )
    return counts.withColumn("sensitivity", _share(F.col("tp"), F.col("tp") + F.col("fn"))).withColumn(
        "specificity", _share(F.col("tn"), F.col("tn") + F.col("fp"))
    )


def report(predictions: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy, macro and weighted means.

    Rows ``(class, precision, recall, f1, support)``; accuracy is repeated in all three numbers.
    """
    c = confusion(predictions)
    tp, fp, tn, fn = F.col("tp"), F.col("fp"), F.col("tn"), F.col("fn")

    def f1(p: Column, r: Column) -> Column:
        return _share(2 * p * r, p + r)

    p1, r1 = _share(tp, tp + fp), _share(tp, tp + fn)
    p0, r0 = _share(tn, tn + fn), _share(tn, tn + fp)
    n1, n0 = tp + fn, tn + fp
    n = n0 + n1
    accuracy = _share(tp + tn, n)

    def line(name: str, p: Column, r: Column, f: Column, support: Column) -> Column:
        return F.struct(F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"), f.alias("f1"),
                        support.alias("support"))

    def macro(a: Column, b: Column) -> Column:
        return (a + b) / 2

    def weighted(a: Column, b: Column) -> Column:
        return _share(a * n0 + b * n1, n)

    return c.select(F.inline(F.array(
        line("0", p0, r0, f1(p0, r0), n0),
        line("1", p1, r1, f1(p1, r1), n1),
        line("accuracy", accuracy, accuracy, accuracy, n),
        line("macro avg", macro(p0, p1), macro(r0, r1), macro(f1(p0, r0), f1(p1, r1)), n),
        line("weighted avg", weighted(p0, p1), weighted(r0, r1), weighted(f1(p0, r0), f1(p1, r1)), n),
    )))


def error_lists(predictions: DataFrame) -> DataFrame:
    """``(kind, pid)`` from ``(pid, label, prediction, is_test)``: true positives, false positives and
    false negatives of the test part and false positives of the training part."""
    truth, said, test = F.col("label") == 1, F.col("prediction") == 1, F.col("is_test")
    kind = (
        F.when(test & truth & said, "true_positives")
        .when(test & ~truth & said, "false_positives")
        .when(test & truth & ~said, "false_negatives")
        .when(~test & ~truth & said, "false_positives_train")
    )
    return predictions.select(kind.alias("kind"), "pid").where(F.col("kind").isNotNull())


def list_overlap(lists: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """``(list, other, overlap_pct)`` from ``(list, pid)``: of each list, the share also in the other.

    Lists become bitmaps over the patients on any of them, and pairs are formed per block of numbers, never per
    patient. ``names`` adds lists that are empty; their own row is null, as a share of nothing is undefined.
    """
    sets = bitmaps.bitmaps(lists, bitmaps.numbered(lists), ["list"])
    shared = bitmaps.overlaps(sets, "list").withColumnRenamed("patients", "_both")
    # The grid of list names: a report of (number of lists) squared rows.
    known = (lists.select("list") if names is None else names.select("list").union(lists.select("list"))).distinct()
    everyone = known.groupBy().agg(F.sort_array(F.collect_set("list")).alias("_names"))
    grid = everyone.select(F.explode("_names").alias("list"), "_names").select("list", F.explode("_names").alias("other"))
    sizes = shared.where(F.col("list") == F.col("other")).select("list", F.col("_both").alias("_size"))
    return (
        grid.join(shared, ["list", "other"], "left").join(sizes, "list", "left")
        .select("list", "other",
                F.when(F.col("_size") > 0, F.coalesce("_both", F.lit(0)) / F.col("_size") * 100).alias("overlap_pct"))
    )
