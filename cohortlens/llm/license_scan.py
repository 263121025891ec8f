"""License notices in texts, by votes of word k-grams for diagonals of known templates; DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import saved, table

GRAM = 4
DRIFT = 6
LEAST_COVERAGE = 0.6
BASE_SCORE = 0.5

# Public license notices, as words.
TEMPLATES = (
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the "
               "license you may obtain a copy of the license at"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an "
               "as is basis without warranties or conditions of any kind either express or implied see the license for the specific "
               "language governing permissions and limitations under the license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license "
            "as published by the free software foundation either version"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty "
            "of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation "
            "files the software to deal in the software without restriction including without limitation the rights to use copy "
            "modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software "
            "is furnished to do so subject to the following conditions"),
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
            "conditions are met"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("reserved", "all rights reserved no part of this publication may be reproduced"),
)
# The words of a base phrase before its last word, which is "license" in each.
BASE = (("mit", ("mit",)), ("apache", ("apache",)), ("gpl", ("general", "public")))


def words(text: Column) -> Column:
    """The words of a text in lower case: runs of letters, digits and everything beyond ASCII."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def gram_at(hashes: Column, i: Column) -> Column:
    return F.xxhash64(*[F.get(hashes, i + j) for j in range(GRAM)])


def starts(n: Column) -> Column:
    """0 .. n - GRAM, or nothing."""
    return F.when(n >= GRAM, F.sequence(F.lit(0), n - GRAM)).otherwise(F.array().cast("array<int>"))


def template_grams(spark: SparkSession) -> DataFrame:
    """Columns template, label, size (grams), at, gram: every gram of the fixed list of templates."""
    rows = F.array(*[F.struct(F.lit(i).alias("template"), F.lit(label).alias("label"), F.split(F.lit(text), " ").alias("w"))
                     for i, (label, text) in enumerate(TEMPLATES)])
    known = spark.range(1).select(F.inline(rows)).withColumn("h", F.transform("w", lambda w: F.xxhash64(w)))
    size = F.size("w") - (GRAM - 1)
    return known.select("template", "label", size.alias("size"), "h", F.explode(starts(F.size("w"))).alias("at")).select(
        "template", "label", "size", "at", gram_at(F.col("h"), F.col("at")).alias("gram"))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", least_coverage: float = LEAST_COVERAGE) -> DataFrame:
    """Columns key, n_words, n_base, first_word, last_word, base_labels, labels, score for every row.

    Each GRAM-word gram that occurs in a template votes for the diagonal (its place minus the place
    in the template). Votes are counted per diagonal; diagonals of one template within DRIFT words of
    each other form one span, so that a few words put in or left out do no harm. In a span a copy
    begins where the place in the template steps back. A span counts when the votes of one of its copies,
    or of all together, cover enough of the template's grams and are not spread much wider than the
    template; so a notice repeated back to back counts like a single one. ``score`` is the best coverage found, BASE_SCORE at least where a base phrase stands.
    Null and empty texts have no words, no places and no labels. Equal rows get equal results.
    """
    grams = template_grams(docs.sparkSession)
    known = [r.gram for r in grams.select("gram").distinct().collect()]  # as many as the fixed templates have
    body = docs.select(F.col(key).alias("key"), F.xxhash64(F.col(key), F.col(text)).alias("row"), words(F.col(text)).alias("w"))
    body = body.withColumn("n", F.size("w")).withColumn("h", F.transform("w", lambda w: F.xxhash64(w)))
    h, w, n = F.col("h"), F.col("w"), F.col("n")
    ends = F.when(F.array_contains(w, "license"), F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, i) == "license")).otherwise(
        F.array().cast("array<int>"))
    body = body.withColumn("ends", ends)

    def places(before: tuple[str, ...]) -> Column:
        return F.filter("ends", lambda e: reduce(lambda a, b: a & b, [
            (e >= len(before)), *[F.coalesce(F.get(w, e - len(before) + j), F.lit("")) == word for j, word in enumerate(before)]]))

    def shifted(by: int):
        return lambda e: e - by

    for label, before in BASE:
        body = body.withColumn(f"base_{label}", F.transform(places(before), shifted(len(before))))
    hits = F.transform(F.filter(starts(n), lambda i: gram_at(h, i).isin(known)), lambda i: F.struct(i.alias("place"), gram_at(h, i).alias("gram")))
    every = F.concat(*[f"base_{label}" for label, _ in BASE])
    named = F.array_compact(F.array(*[F.when(F.size(f"base_{label}") > 0, label) for label, _ in BASE]))
    read = saved(body.select(
        "key", "row", n.cast("bigint").alias("n_words"), F.size(every).cast("bigint").alias("n_base"), F.array_min(every).cast("bigint").alias("first_word"),
        F.array_max(every).cast("bigint").alias("last_word"), F.array_sort(named).alias("base"), hits.alias("hits")), "license-hits")

    votes = read.where(F.size("hits") > 0).select("key", "row", F.explode("hits").alias("hit")).select(
        "key", "row", "hit.place", "hit.gram").join(F.broadcast(grams), "gram")
    of = ["key", "row", "template", "label", "size"]
    places_of = votes.select(*of, "place", "at", (F.col("place") - F.col("at")).alias("diagonal")).distinct()
    order = Window.partitionBy("key", "row", "template").orderBy("diagonal")
    apart = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order) > DRIFT), F.lit(True))
    chains = places_of.withColumn("apart", apart.cast("int")).withColumn("span", F.sum("apart").over(order))
    reading = Window.partitionBy("key", "row", "template", "span").orderBy("place", "at")
    again = F.coalesce(F.col("at") <= F.lag("at").over(reading), F.lit(False))
    copies = (
        chains.withColumn("again", again.cast("int"))
        .withColumn("copy", F.sum("again").over(reading))
        .groupBy(*of, "span", "copy")
        .agg(F.collect_set("at").alias("seen"), F.min("place").alias("first"), F.max("place").alias("last"))
    )
    in_reach = F.col("last") - F.col("first") < 2 * F.col("size") + 2 * DRIFT
    spans = copies.groupBy(*of, "span").agg(
        F.max(F.when(in_reach, F.size("seen"))).alias("one"), F.size(F.array_distinct(F.flatten(F.collect_list("seen")))).alias("every"),
        F.min("first").alias("first"), F.max("last").alias("last"))
    coverage = F.greatest("one", F.when(in_reach, F.col("every"))) / F.col("size")
    verified = spans.where(coverage >= least_coverage)
    found = verified.groupBy(F.col("key").alias("_key"), F.col("row").alias("_row")).agg(F.collect_set("label").alias("found"), F.max(coverage).alias("best"))
    joined = read.drop("hits").join(found, F.col("key").eqNullSafe(F.col("_key")) & (F.col("row") == F.col("_row")), "left")
    none = F.array().cast("array<string>")
    return joined.select(
        F.col("key").alias(key), "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("found", none))), ",").alias("labels"),
        F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.col("n_base") > 0, BASE_SCORE).otherwise(0.0)).alias("score"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


QUERIES = {"op10_license_scan": op10_license_scan}
ORACLE: dict[str, str] = {}
