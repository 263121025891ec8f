"""Bag of words, TF-IDF, projection on a topic basis, and the model matrix."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import tokens
from ..session import shuffles_freed
from .terms import listed_tokens

# Task functions travel with the job, so executors need numpy and pyarrow but not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed value: weights this close to zero are not stored.
TINY = 1e-12
# A table is sent to every executor only where its rows (or doubles) are known to stay below this.
BROADCAST_ROWS = 2_000_000
BROADCAST_CELLS = 20_000_000

KEYS = ("scope", "odds")


def _small(df: DataFrame, size: int | None, limit: int) -> DataFrame:
    """Hint a broadcast when the caller's size bound allows it; otherwise Spark decides."""
    return F.broadcast(df) if size is not None and size <= limit else df


def bag_of_words(documents: DataFrame, masks: DataFrame, scopes: Sequence[str], vocabulary: DataFrame,
                 vocabulary_rows: int | None = None) -> DataFrame:
    """``(scope, odds, pid, term_id, tf)`` for every member patient, test patients included.

    ``vocabulary_rows`` is the vocabulary's bound (terms x scopes x odds). Words outside all
    vocabularies leave before the only shuffle, which carries one row per patient and word.
    """
    words = documents.select("pid", F.explode(tokens(F.col("text"))).alias("token"))
    known = vocabulary.select("token").distinct()
    counts = (
        words.join(_small(known, vocabulary_rows, BROADCAST_ROWS), "token", "left_semi")
        .groupBy("pid", "token").agg(F.count("*").alias("tf"))
    )
    return _in_scopes(counts, masks, scopes, vocabulary, vocabulary_rows)


def bag_of_tokens(table: DataFrame, masks: DataFrame, scopes: Sequence[str], vocabulary: DataFrame,
                  vocabulary_rows: int | None = None, others: Sequence[str] = ()) -> DataFrame:
    """``bag_of_words`` from a token table ``(pid, token, tf)`` or from lists, which have the masks already, without another look at the texts.
    ``others`` of the table's columns, such as the split, stay beside the counts."""
    return _in_scopes(listed_tokens(table) if "words" in table.columns else table, masks, scopes, vocabulary, vocabulary_rows, others)


def _in_scopes(counts: DataFrame, masks: DataFrame, scopes: Sequence[str], vocabulary: DataFrame, vocabulary_rows: int | None,
               others: Sequence[str] = ()) -> DataFrame:
    """A word meets the vocabularies once, and each that holds it asks the mask for its scope."""
    bits = F.coalesce(*[F.when(F.col("scope") == scope, F.lit(3 << (2 * i)).cast("bigint")) for i, scope in enumerate(scopes)])
    entries = vocabulary.select("token", F.struct("scope", "odds", "term_id", bits.alias("bits")).alias("_entry")).where(F.col("_entry.bits").isNotNull())
    holding = entries.groupBy("token").agg(F.collect_list("_entry").alias("_in"))
    known = counts.join(_small(holding, vocabulary_rows, BROADCAST_ROWS), "token")
    masked = known.where(F.col("mask").isNotNull()) if "mask" in counts.columns else known.join(masks.hint("shuffle_hash"), "pid")
    in_scope = masked.select("pid", "tf", "mask", *others, F.inline("_in"))
    return in_scope.where(F.col("mask").bitwiseAND(F.col("bits")) != 0).select("scope", "odds", "pid", "term_id", "tf", *others)


def nested_bag(bag: DataFrame) -> DataFrame:
    """One row per patient with its ``(term_id, tf)`` list in term order; at most one vocabulary long."""
    return bag.groupBy("scope", "odds", "pid").agg(F.sort_array(F.collect_list(F.struct("term_id", "tf"))).alias("bow"))


def term_weights(vocabulary: DataFrame) -> DataFrame:
    """Add ``idf`` = log2(N / cf), with cf the total count of the term and N the sum of all cf."""
    totals = vocabulary.groupBy(*KEYS).agg(F.sum("cf").alias("_n"))
    return (
        vocabulary.join(F.broadcast(totals), list(KEYS))
        .withColumn("idf", F.log2(F.col("_n") / F.col("cf"))).drop("_n")
    )


def tfidf(bag: DataFrame, vocabulary: DataFrame, vocabulary_rows: int | None = None, others: Sequence[str] = ()) -> DataFrame:
    """``(scope, odds, pid, term_id, w)``, unit length per patient, and ``others`` of the bag's columns."""
    weights = term_weights(vocabulary).select("scope", "odds", "term_id", "idf")
    raw = (
        bag.join(_small(weights, vocabulary_rows, BROADCAST_ROWS), ["scope", "odds", "term_id"])
        .where(F.abs("idf") > TINY)
        .withColumn("_w", F.col("tf") * F.col("idf"))
    )
    # A patient's group is at most one vocabulary long. The id comes first, as rows are sorted fastest by a column that tells them apart.
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy("pid", "scope", "odds")))
    return raw.select("scope", "odds", "pid", "term_id", (F.col("_w") / norm).alias("w"), *others).where(F.abs("w") > TINY)


def basis_rows(basis: DataFrame, topics: int) -> DataFrame:
    """Long basis ``(scope, odds, term_id, topic, v)`` as one array of ``topics`` numbers per term."""
    return (
        basis.where(F.col("topic") < topics).groupBy("scope", "odds", "term_id")
        .agg(F.map_from_entries(F.collect_list(F.struct("topic", "v"))).alias("_m"))
        .select("scope", "odds", "term_id", F.transform(
            F.sequence(F.lit(0), F.lit(topics - 1)),
            lambda t: F.coalesce(F.try_element_at("_m", t), F.lit(0.0)),
        ).alias("loadings"))
    )


def basis_of_terms(basis: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """The rows of a basis for the terms of a vocabulary; no weight meets any other. What is left is as small as the
    vocabulary, however many terms the basis has."""
    known = vocabulary.select(*KEYS, "term_id").distinct()
    return basis.join(known, [*KEYS, "term_id"], "left_semi")


def project(weights: DataFrame, basis: DataFrame, topics: int, basis_terms: int | None = None) -> DataFrame:
    """``(scope, odds, pid, vec)``: the dense topic vector x V of each patient, not scaled.

    Where the basis is known to be small it is broadcast, and the weights of a patient that lie next to each other are multiplied in
    one product; these partial vectors are then added up by ``topics`` plain aggregates. Else every weight meets the loadings of its term in a join, and
    the aggregates reduce the rows before the shuffle. Patients whose vector is empty are left out; numbers close to zero become zero.
    """
    rows = basis_rows(basis, topics)
    if basis_terms is not None and basis_terms * topics <= BROADCAST_CELLS:
        joined = _products(weights, rows, topics).withColumn("w", F.lit(1.0))
    else:
        joined = weights.join(rows, ["scope", "odds", "term_id"])
    sums = joined.groupBy("scope", "odds", "pid").agg(
        *[F.sum(F.col("w") * F.get("loadings", F.lit(t))).alias(f"_t{t}") for t in range(topics)]
    )
    cleaned = F.array(*[F.when(F.abs(f"_t{t}") > TINY, F.col(f"_t{t}")).otherwise(0.0) for t in range(topics)])
    return (
        sums.select("scope", "odds", "pid", cleaned.alias("vec"))
        .where(F.exists("vec", lambda v: v != 0.0))
    )


def _products(weights: DataFrame, rows: DataFrame, topics: int) -> DataFrame:
    """``(scope, odds, pid, loadings)``: weights times the loadings of their terms, added up for each run of rows of the same patient."""
    with shuffles_freed(rows.sparkSession):
        found = rows.where(F.col("scope").isNotNull() & F.col("odds").isNotNull() & F.col("term_id").isNotNull()).select(
            "scope", "odds", "term_id", "loadings").orderBy("scope", "odds", "term_id").toArrow().combine_chunks()
    bases: list[list[int]] = []
    names: dict[tuple, int] = {}
    for i, key in enumerate(zip(found["scope"].to_pylist(), found["odds"].to_pylist())):
        if key not in names:
            names[key] = len(bases)
            bases.append([i, i])
        bases[names[key]][1] = i + 1
    # Loadings stay in the order of these rows, so a weight needs the number of its row and of its basis only.
    spark, count = rows.sparkSession, [b - a for a, b in bases]
    places = found.select(["scope", "odds", "term_id"]).append_column("_basis", pa.array(np.repeat(np.arange(len(bases), dtype=np.int32), count))).append_column(
        "_row", pa.array(np.arange(len(found), dtype=np.int32)))
    loadings = found["loadings"].combine_chunks() if len(found) else pa.array([], pa.list_(pa.float64()))
    sent = spark.sparkContext.broadcast(loadings.flatten().to_numpy(zero_copy_only=False).reshape(-1, topics))

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            new = np.append(True, np.zeros(n - 1, dtype=bool))
            for key in ("_basis", "pid"):
                code = pc.fill_null(batch[key].dictionary_encode().indices, -1).to_numpy()
                new[1:] |= code[1:] != code[:-1]
            starts = np.flatnonzero(new)
            row, w = batch["_row"].to_numpy(), pc.fill_null(batch["w"], 0.0).to_numpy()
            out = np.empty((len(starts), topics))
            for i, (a, b) in enumerate(zip(starts.tolist(), np.append(starts[1:], n).tolist())):
                out[i] = w[a:b] @ sent.value.take(row[a:b], axis=0)
            yield pa.RecordBatch.from_arrays(
                [*(batch[c].take(pa.array(starts)) for c in ("_basis", "pid")),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(starts) + 1, dtype=np.int32) * topics), pa.array(out.ravel()))],
                names=["_basis", "pid", "loadings"])

    kinds = {c: weights.schema[c].dataType.simpleString() for c in ("scope", "odds", "pid")}
    place = spark.createDataFrame(places, f"scope {rows.schema['scope'].dataType.simpleString()}, odds {rows.schema['odds'].dataType.simpleString()}, "
                                  f"term_id {rows.schema['term_id'].dataType.simpleString()}, _basis int, _row int")
    # Weights of terms that the basis has not are left out where they lie.
    known = weights.join(F.broadcast(place), ["scope", "odds", "term_id"]).select("_basis", "pid", "_row", F.col("w").cast("double").alias("w"))
    named = spark.createDataFrame([(i, *key) for key, i in names.items()], f"_basis int, scope {kinds['scope']}, odds {kinds['odds']}")
    return known.mapInArrow(products, f"_basis int, pid {kinds['pid']}, loadings array<double>").join(F.broadcast(named), "_basis").drop("_basis")


def topic_weights(vectors: DataFrame) -> DataFrame:
    """The sparse long form ``(scope, odds, pid, topic, v)`` of dense vectors, with any other columns that stand beside these."""
    others = [c for c in vectors.columns if c not in ("scope", "odds", "pid", "vec")]
    return vectors.select("scope", "odds", "pid", *others, F.posexplode("vec").alias("topic", "v")).where(F.col("v") != 0.0)


def densify(weights: DataFrame, topics: int) -> DataFrame:
    """Long topic weights ``(pid, topic, v)`` as dense arrays, 0 where a topic is missing."""
    return (
        weights.groupBy("pid")
        .agg(*[F.coalesce(F.max(F.when(F.col("topic") == t, F.col("v"))), F.lit(0.0)).alias(f"_t{t}") for t in range(topics)])
        .select("pid", F.array(*[F.col(f"_t{t}") for t in range(topics)]).alias("vec"))
    )


def vector_gaps(patients: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: patients without a vector, and vectors with fewer non-zero topics than asked for."""
    missing = patients.select("pid").join(vectors.select("pid"), "pid", "left_anti").select(
        F.lit(1).alias("no_vector"), F.lit(0).alias("fewer_topics"))
    partial = vectors.where(F.exists("vec", lambda v: v == 0.0)).select(
        F.lit(0).alias("no_vector"), F.lit(1).alias("fewer_topics"))
    return missing.unionByName(partial).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("no_vector", "fewer_topics")]
    )


def column_names(table: str, topics: int, kind: str = "lsi") -> list[str]:
    if kind != "lsi":
        raise ValueError(f"unknown vector type: {kind}")
    return [f"{table}_{kind}_{topic}" for topic in range(topics)]


def overlap(tables: Sequence[DataFrame]) -> DataFrame:
    """Patients that have a row in every table."""
    return reduce(lambda a, b: a.join(b.select("pid"), "pid", "left_semi"), [t.select("pid") for t in tables])


def join_tables(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per patient found in every table, with one array column per table. Each table is
    hash-partitioned by patient once and every join reuses that."""
    return reduce(
        lambda a, b: a.join(b, "pid"),
        [t.select("pid", F.col("vec").alias(_vec(name))) for name, t in tables.items()],
    )


def _vec(name: str) -> str:
    return f"_vec_{name}"


def side_by_side(joined: DataFrame, names: Sequence[str]) -> DataFrame:
    """``(pid, features)``: the numbers of the named tables, concatenated in that order."""
    return joined.select("pid", F.concat(*[F.col(_vec(name)) for name in names]).alias("features"))


def assemble_matrix(tables: Mapping[str, DataFrame], only: Sequence[str] = ()) -> DataFrame:
    """``(pid, features)`` for patients found in every table; ``only`` keeps some tables' numbers
    for those same patients."""
    return side_by_side(join_tables(tables), [name for name in tables if not only or name in only])


def as_vector(features: Column) -> Column:
    """An array of doubles as the vector type that learners take."""
    return array_to_vector(features)
