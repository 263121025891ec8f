"""Case/control term counts, odds ratios and the vocabulary, for all scopes in one pass.

A scope is a named population with its own cases (all patients, heart failure only, ...).
Membership arrives as ``(scope, pid, label)``. Each patient's memberships are packed into one
bigint ``mask`` with two bits per scope (member as control, member as case), so texts are
tokenised and counted once for all scopes rather than once per scope.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.keys import BUCKETS_PER_FOLDER, FIRST_TEST_BUCKET, FOLDER, bucket, is_test
from ..functions.text import found_words, tokens
from ..session import cut_lineage
from .ordering import top_n

# Task functions travel with the job, so executors need numpy and pyarrow but not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_SCOPES = 31
# Rows that the counting of words hands over at a time.
COUNTED_ROWS = 1 << 17
# Pieces of a patient whose words are counted in one row; those of a longer text are counted word by word.
ROW_PARTS = 1024
# Whether a row's patient is a training patient, where that has been decided.
TRAINING = "training"


def with_split(df: DataFrame) -> DataFrame:
    """Add the column that ``training`` goes by, worked out once for each row of patients before they become many rows."""
    return df.withColumn(TRAINING, ~is_test(bucket(F.col("pid"))))


@dataclass(frozen=True)
class VocabularyRules:
    # The default thresholds.
    case_share: float = 0.85
    control_share: float = 0.6
    min_case_count: int = 10
    min_control_count: int = 50
    top_case_terms: int = 10_000
    total_terms: int = 50_000


def training(df: DataFrame) -> DataFrame:
    """Rows of training patients; the split depends on the id alone. On a stored split table
    the test folders are not even opened, and a table that has the split as a column ``training`` is not asked for it row by row."""
    if TRAINING in df.columns:
        return df.where(F.col(TRAINING))
    if FOLDER in df.columns:
        return df.where(F.col(FOLDER) < FIRST_TEST_BUCKET // BUCKETS_PER_FOLDER)
    return df.where(~is_test(bucket(F.col("pid"))))


def membership_masks(membership: DataFrame, scopes: Sequence[str]) -> DataFrame:
    """``(pid, mask)`` from ``(scope, pid, label)``; a patient listed both ways counts as a case."""
    if len(scopes) > MAX_SCOPES:
        raise ValueError(f"at most {MAX_SCOPES} scopes per pass; split the grid")
    bit = F.lit(None).cast("bigint")
    for i, scope in enumerate(scopes):
        bit = F.when(
            F.col("scope") == scope,
            F.when(F.col("label") == 1, F.lit(2 << (2 * i))).otherwise(F.lit(1 << (2 * i))).cast("bigint"),
        ).otherwise(bit)
    return (
        membership.select("pid", bit.alias("_bit")).where(F.col("_bit").isNotNull())
        .groupBy("pid").agg(F.bit_or("_bit").alias("mask"))
    )


def scope_labels(mask: Column, scopes: Sequence[str]) -> Column:
    """The memberships packed in a mask, as ``array<struct<scope, label>>``."""
    cells = []
    for i, scope in enumerate(scopes):
        pair = F.shiftright(mask, 2 * i).bitwiseAND(F.lit(3))
        cells.append(F.when(pair > 0, F.struct(F.lit(scope).alias("scope"), (pair >= 2).cast("int").alias("label"))))
    return F.array_compact(F.array(*cells))


def training_masks(masks: DataFrame) -> DataFrame:
    """The masks of training patients, decided once per patient. As the condition names the mask, Spark does not infer
    it for the other side of a join on the id, where it would be worked out for every word."""
    return masks.where(F.when(~is_test(bucket(F.col("pid"))), F.col("mask")).isNotNull())


def token_table(documents: DataFrame) -> DataFrame:
    """``(pid, token, tf)``: each patient's words once, from one pass over the texts."""
    return listed_tokens(_lists(documents))


def token_lists(documents: DataFrame, masks: DataFrame) -> DataFrame:
    """``(pid, words, times, mask, training)``: the token table with a patient's words in few rows, each beside the patient's mask
    and whether it is a training patient. Written to a table, it serves the counts and the bag of words, and
    no word has to be moved to its patient's mask again. Patients without a mask have none here.
    """
    known = masks.select("pid", "mask", (~is_test(bucket(F.col("pid")))).alias("training"))
    return _lists(documents).join(known.hint("shuffle_hash"), "pid", "left")


def listed_tokens(lists: DataFrame) -> DataFrame:
    """One row ``(token, tf)`` for each word of the lists, with all their other columns."""
    others = [c for c in lists.columns if c not in ("words", "times")]
    placed = lists.select(*others, "times", F.posexplode(F.split("words", " ")).alias("_at", "token"))
    return placed.select(*others, "token", F.get("times", F.col("_at")).alias("tf"))


def _lists(documents: DataFrame) -> DataFrame:
    """``(pid, words, times)`` of each patient.

    Words are counted where their text lies and nothing is moved; only the counts of patients with several rows are
    added up, and these then have a row for each word. One pass over the ids finds those, and normally there are none.
    """
    several = cut_lineage(documents.groupBy("pid").agg(F.count("*").alias("_n")).where(F.col("_n") > 1).select(F.col("pid").alias("_pid")))
    lists = _listed_in_rows(documents)
    if several.isEmpty():
        return lists
    same = F.col("pid").eqNullSafe(F.col("_pid"))
    added = listed_tokens(lists.join(several, same, "left_semi")).groupBy("pid", "token").agg(F.sum("tf").alias("tf"))
    return lists.join(several, same, "left_anti").unionByName(added.select("pid", F.col("token").alias("words"), F.array("tf").alias("times")))


def _listed_in_rows(documents: DataFrame, others: Sequence[str] = ()) -> DataFrame:
    """``(pid, words, times)`` for every row of the documents by itself: its distinct words, joined by spaces, and how often
    each stands there, and ``others`` of its columns. Rows without a word have none here."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, sizes, words, times = [], [], [], []
            for i, text in enumerate(batch["text"]):
                found = Counter(found_words(text.as_py() or ""))
                if found:
                    at.append(i)
                    sizes.append(len(found))
                    words.append(" ".join(found))
                    times.extend(found.values())
                if len(times) >= COUNTED_ROWS or i == len(batch) - 1:
                    listed = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(times, pa.int64()))
                    yield pa.RecordBatch.from_arrays(
                        [*(batch[c].take(pa.array(at, pa.int64())) for c in kept), pa.array(words, pa.string()), listed], names=[*kept, "words", "times"])
                    at, sizes, words, times = [], [], [], []

    kept = ["pid", *others]
    schema = T.StructType([*(documents.schema[c] for c in kept), T.StructField("words", T.StringType()), T.StructField("times", T.ArrayType(T.LongType()))])
    return documents.select(*kept, F.lower("text").alias("text")).mapInArrow(counted, schema)


def term_counts(documents: DataFrame, masks: DataFrame, scopes: Sequence[str]) -> DataFrame:
    """``(scope, token, case_df, case_tf, ctrl_df, ctrl_tf)`` over training documents of each scope.

    A document in one row is counted in that row, and only its list of words moves to the mask. The pieces of a document of up to ROW_PARTS
    pieces move once, to its mask, and are counted there as one row. The words of a longer one are added up per patient first, so that
    its pieces never meet in one task.
    """
    known = training(documents)
    rows = _list_counts(_listed_in_rows(known.where(F.col("parts") == 1)).join(masks.hint("shuffle_hash"), "pid"))
    pieces = known.where(F.col("parts") != 1)
    texts = pieces.where(F.col("parts") <= ROW_PARTS).groupBy("pid").agg(F.array_join(F.collect_list("text"), " ").alias("text"))
    few = _list_counts(_listed_in_rows(texts.join(masks.hint("shuffle_hash"), "pid"), ("mask",)))
    words = pieces.where(F.col("parts") > ROW_PARTS).select("pid", F.explode(tokens(F.col("text"))).alias("token"))
    many = words.groupBy("pid", "token").agg(F.count("*").alias("tf")).join(masks, "pid")
    return _by_scope(rows.unionByName(few).unionByName(many.select("mask", "token", F.lit(1).alias("df"), "tf")), scopes)


def counts_of_tokens(table: DataFrame, masks: DataFrame, scopes: Sequence[str]) -> DataFrame:
    """``term_counts`` from a token table, or from lists, which have the masks already. The split is decided once per patient, on the masks."""
    if "words" in table.columns:
        return _by_scope(_list_counts(table.where(F.col("training") & F.col("mask").isNotNull())), scopes)
    # One row per patient against many: a hash of the few, and the words are not sorted.
    rows = table.join(training_masks(masks).hint("shuffle_hash"), "pid")
    return _by_scope(rows.select("mask", "token", F.lit(1).alias("df"), "tf"), scopes)


def _list_counts(lists: DataFrame) -> DataFrame:
    """``(mask, token, df, tf)`` rows whose sums are the counts, added up for each batch of lists."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = batch["mask"].to_numpy()
            for mask in np.unique(kinds).tolist():
                part = batch.filter(pa.array(kinds == mask))
                coded = pc.split_pattern(part["words"], " ").flatten().dictionary_encode()
                at, n = coded.indices.to_numpy(), len(coded.dictionary)
                # Sums of doubles are exact up to 2^53.
                tf = np.bincount(at, part["times"].flatten().to_numpy(), n).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, mask)), coded.dictionary, pa.array(np.bincount(at, minlength=n)), pa.array(tf)], names=["mask", "token", "df", "tf"])

    return lists.select("mask", "words", "times").mapInArrow(added, "mask bigint, token string, df bigint, tf bigint")


def _by_scope(parts: DataFrame, scopes: Sequence[str]) -> DataFrame:
    by_mask = parts.groupBy("mask", "token").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"))
    rows = by_mask.select("token", "df", "tf", F.inline(scope_labels(F.col("mask"), scopes)))
    case, control = F.col("label") == 1, F.col("label") == 0

    def total(name: str, which: Column, out: str) -> Column:
        return F.coalesce(F.sum(F.when(which, F.col(name))), F.lit(0)).cast("bigint").alias(out)

    return rows.groupBy("scope", "token").agg(
        total("df", case, "case_df"), total("tf", case, "case_tf"),
        total("df", control, "ctrl_df"), total("tf", control, "ctrl_tf"),
    )


def patient_counts(documents: DataFrame, masks: DataFrame, scopes: Sequence[str]) -> DataFrame:
    """``(scope, cases, controls)``: training patients with a document, also those without a word."""
    patients = training(documents.where(F.col("part") == 0)).select("pid")
    by_mask = patients.join(masks, "pid").groupBy("mask").agg(F.count("*").alias("n"))
    return (
        by_mask.select("n", F.inline(scope_labels(F.col("mask"), scopes)))
        .groupBy("scope").agg(
            F.coalesce(F.sum(F.when(F.col("label") == 1, F.col("n"))), F.lit(0)).alias("cases"),
            F.coalesce(F.sum(F.when(F.col("label") == 0, F.col("n"))), F.lit(0)).alias("controls"),
        )
    )


def _with_totals(counts: DataFrame, patients: DataFrame) -> DataFrame:
    # One row per scope, and scopes are at most MAX_SCOPES.
    return counts.join(F.broadcast(patients), "scope")


def _case_term_kept(rules: VocabularyRules) -> Column:
    return (
        (F.col("case_df") > 0) & (F.col("ctrl_df") > 0)
        & (F.col("case_df") <= F.lit(rules.case_share) * F.col("cases"))
        & (F.col("ctrl_df") <= F.lit(rules.control_share) * F.col("controls"))
    )


def _odds() -> Column:
    case_odds = F.col("case_df") / (F.col("cases") - F.col("case_df"))
    control_odds = F.col("ctrl_df") / (F.col("controls") - F.col("ctrl_df"))
    defined = (F.col("cases") != F.col("case_df")) & (F.col("controls") != F.col("ctrl_df"))
    return F.when(defined & (F.col("ctrl_df") > 0) & (F.col("case_df") > 0), case_odds / control_odds)


def odds_ratios(counts: DataFrame, patients: DataFrame, rules: VocabularyRules = VocabularyRules()) -> DataFrame:
    """``(scope, token, odds_ratio)`` for the case terms that pass the frequency rules."""
    return (
        _with_totals(counts, patients).where(_case_term_kept(rules))
        .select("scope", "token", _odds().alias("odds_ratio"))
        .where(F.col("odds_ratio").isNotNull())
    )


def vocabulary(counts: DataFrame, patients: DataFrame, odds: Sequence[float] = (3.5,),
               rules: VocabularyRules = VocabularyRules()) -> DataFrame:
    """``(scope, odds, term_id, token, cf)`` with dense ids per (scope, odds).

    Terms of cases come first, by case count; then terms of controls alone, by control count, until
    the total is reached. Terms tied closely to either class (ratio at or beyond ``odds`` or
    its inverse) are left out. Equal counts are ordered by token.
    """
    totals = _with_totals(counts, patients)
    limits = F.explode(F.array(*[F.lit(float(o)) for o in odds])).alias("odds")
    from_cases = (
        totals.where(_case_term_kept(rules))
        .where((F.col("case_tf") >= rules.min_case_count) & (F.col("ctrl_tf") >= rules.min_control_count))
        .withColumn("_ratio", _odds()).where(F.col("_ratio").isNotNull())
        .select("*", limits)
        .where((F.col("_ratio") < F.col("odds")) & (F.col("_ratio") > F.lit(1.0) / F.col("odds")))
        .select("scope", "odds", "token", F.col("case_tf").alias("_weight"),
                (F.col("case_tf") + F.col("ctrl_tf")).alias("cf"))
    )
    from_controls = (
        totals.where((F.col("case_df") == 0) & (F.col("ctrl_tf") >= rules.min_control_count))
        .where(F.col("ctrl_df") <= F.lit(rules.control_share) * F.col("controls"))
        .select("*", limits)
        .select("scope", "odds", "token", F.col("ctrl_tf").alias("_weight"), F.col("ctrl_tf").alias("cf"))
    )
    keys, ties = ["scope", "odds"], [F.asc("token")]
    first = top_n(from_cases, keys, F.col("_weight"), ties, min(rules.top_case_terms, rules.total_terms), "_rank")
    second = top_n(from_controls, keys, F.col("_weight"), ties, rules.total_terms, "_rank")
    # One row per (scope, odds) of the grid.
    used = first.groupBy(*keys).agg(F.count("*").alias("_used"))
    second = (
        second.join(F.broadcast(used), keys, "left")
        .withColumn("_rank", F.col("_rank") + F.coalesce("_used", F.lit(0)))
        .where(F.col("_rank") <= rules.total_terms).drop("_used")
    )
    return first.unionByName(second).select(
        "scope", "odds", (F.col("_rank") - 1).cast("int").alias("term_id"), "token", "cf"
    )
