"""Blanking of repeated spans: where the 30 characters starting at a position occurred before,
at least 30 characters earlier in the same document, they become blanks.

A document that fits one row is handled where it lies, without a shuffle, by array arithmetic on
Arrow batches. A document too long for one row is held as pieces; for it the same rule is a
shuffle on (patient, hash of the span), which spreads over the cluster.
"""

from __future__ import annotations

import re
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

# Send the small helpers below along with the plan, so executors need numpy and pandas only.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed value: characters per compared span.
SPAN = 30
# Characters per block when spans are cut: substring() walks from the start of its argument.
BLOCK = 256
# Multiplier of the span hash; any odd number is right, a good mix only saves comparisons.
HASH_BASE = 0x9E3779B97F4A7C15


def squeeze(text: Column) -> Column:
    """Tab runs become a blank, then blank runs become one blank; line breaks stay."""
    return F.regexp_replace(F.regexp_replace(text, "\t+", " "), " +", " ")


def _span_hashes(codes: np.ndarray, span: int) -> np.ndarray:
    """Hash of every full span, built by doubling: a span of 2m is two spans of m."""
    with np.errstate(over="ignore"):
        wide = codes.astype(np.uint64)
        power, step = wide * np.uint64(0xBF58476D1CE4E5B9) ^ (wide << np.uint64(17)), 1
        hashes, length, remaining = None, 0, span
        while remaining:
            shift = np.uint64(pow(HASH_BASE, step, 1 << 64))
            if remaining & 1:
                size = len(codes) - (length + step) + 1
                tail = power[length:length + size]
                hashes = tail if hashes is None else hashes[:size] * shift + tail
                length += step
            remaining >>= 1
            if remaining:
                power = power[:-step] * shift + power[step:]
                step *= 2
    return hashes


def repeat_starts(codes: np.ndarray, span: int = SPAN) -> np.ndarray:
    """Positions whose full span occurred first at least ``span`` positions earlier."""
    if len(codes) < 2 * span:
        return np.empty(0, dtype=np.int64)
    hashes = _span_hashes(codes, span)
    ordered = np.sort(hashes)
    shared = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(shared):
        return np.empty(0, dtype=np.int64)
    slot = np.minimum(np.searchsorted(shared, hashes), len(shared) - 1)
    at = np.flatnonzero(shared[slot] == hashes)
    group = slot[at]
    first = np.full(len(shared), len(codes), dtype=np.int64)
    np.minimum.at(first, group, at)
    late = at >= first[group] + span
    starts, origin = at[late], first[group[late]]
    views = np.lib.stride_tricks.sliding_window_view(codes, span)
    if all((views[a] == views[b]).all() for a, b in _chunks(starts, origin)):
        return starts
    # A hash collision: settle this one document by the spans themselves.
    seen: dict[bytes, int] = {}
    return np.array([i for i in range(len(views))
                     if i >= seen.setdefault(views[i].tobytes(), i) + span], dtype=np.int64)


def _chunks(left: np.ndarray, right: np.ndarray, size: int = 65_536):
    for lo in range(0, len(left), size):
        yield left[lo:lo + size], right[lo:lo + size]


def _blank(text: str, span: int) -> str:
    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    starts = repeat_starts(codes, span)
    if len(starts):
        edges = np.zeros(len(codes) + 1, dtype=np.int64)
        edges[starts] += 1
        edges[starts + span] -= 1
        codes = np.where(np.cumsum(edges[:-1]) > 0, np.uint32(32), codes)
        text = codes.astype("<u4").tobytes().decode("utf-32-le")
    if "\t" in text or "  " in text:
        text = re.sub(" +", " ", re.sub("\t+", " ", text))
    return text


def blank_in_row(text: Column, span: int = SPAN) -> Column:
    """The rule on a text that fits one row."""

    @F.pandas_udf("string")
    def blanked(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _blank(t, span), na_action="ignore")

    return blanked(text)


def blank_pieces(pieces: DataFrame, piece_chars: int, key: str = "pid", span: int = SPAN) -> DataFrame:
    """The rule on documents held as pieces ``(key, part, parts, text)``, each but the last of
    exactly ``piece_chars`` characters. Hashes only choose candidates, which are then compared as text.
    """
    if piece_chars < span:
        raise ValueError("a piece must hold at least one span")
    overlap = span - 1
    start = F.col("part").cast("bigint") * piece_chars
    heads = pieces.select(
        key, (F.col("part") - 1).alias("part"), F.substring("text", 1, overlap).alias("_next")
    )
    blocks = (
        pieces.join(heads, [key, "part"], "left")
        .withColumn("_all", F.concat("text", F.coalesce("_next", F.lit(""))))
        .where(F.length("_all") >= span)
        .select(
            key, "part",
            F.posexplode(F.transform(
                F.sequence(F.lit(0), F.floor((F.length("_all") - 1) / BLOCK).cast("int")),
                lambda b: F.substring(F.col("_all"), b * BLOCK + 1, F.lit(BLOCK + overlap)),
            )).alias("_block", "_chars"),
        )
        .where(F.length("_chars") >= span)
    )
    spans = blocks.select(
        key, "part",
        (start + F.col("_block") * BLOCK).alias("_base"),
        F.posexplode(F.transform(
            F.sequence(F.lit(1), F.length("_chars") - overlap),
            lambda p: F.substring(F.col("_chars"), p, F.lit(span)),
        )).alias("_in_block", "_span"),
    ).select(key, "part", (F.col("_base") + F.col("_in_block")).alias("_pos"), "_span",
             F.xxhash64("_span").alias("_hash"))
    candidates = (
        spans.groupBy(key, "_hash")
        .agg(F.min("_pos").alias("_lo"), F.max("_pos").alias("_hi"))
        .where(F.col("_hi") >= F.col("_lo") + span)
        .select(key, "_hash")
    )
    shared = spans.join(candidates, [key, "_hash"], "left_semi")
    first = shared.groupBy(key, "_span").agg(F.min("_pos").alias("_first"))
    repeated = (
        shared.join(first, [key, "_span"])
        .where(F.col("_pos") >= F.col("_first") + span)
        .select(key, "part", (F.col("_pos") - start).cast("int").alias("_at"))
    )
    # A span that runs over the end of its piece also blanks the head of the next one.
    spill = repeated.where(F.col("_at") + span > piece_chars).select(
        key, (F.col("part") + 1).alias("part"), (F.col("_at") - piece_chars).alias("_at")
    )
    marks = (
        repeated.select(key, "part", "_at").unionByName(spill)
        .groupBy(key, "part").agg(F.sort_array(F.collect_list("_at")).alias("_marks"))
    )

    @F.pandas_udf("string")
    def blank_at(texts: pd.Series, marks: pd.Series) -> pd.Series:
        def one(text, at):
            if at is None or not len(at):
                return text
            codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
            at = np.asarray(at, dtype=np.int64)
            edges = np.zeros(len(codes) + 1, dtype=np.int64)
            np.add.at(edges, np.clip(at, 0, len(codes)), 1)
            np.add.at(edges, np.clip(at + span, 0, len(codes)), -1)
            codes = np.where(np.cumsum(edges[:-1]) > 0, np.uint32(32), codes)
            return codes.astype("<u4").tobytes().decode("utf-32-le")
        return pd.Series([one(t, a) for t, a in zip(texts, marks)])

    marked = pieces.join(marks, [key, "part"], "left")
    # A piece's end is blank if the text says so or its last repeat reaches the end; knowing
    # that from the marks, the neighbours need no look at the finished text.
    ends_blank = F.col("text").rlike("[ \t]\\z") | F.coalesce(F.array_max("_marks") + span >= F.length("text"), F.lit(False))
    seams = marked.select(key, (F.col("part") + 1).alias("part"), ends_blank.alias("_after_blank"))
    squeezed = marked.withColumn("text", squeeze(blank_at("text", "_marks")))
    return (
        squeezed.join(seams, [key, "part"], "left")
        .withColumn("text", F.when(F.col("_after_blank"), F.regexp_replace("text", "^ ", "")).otherwise(F.col("text")))
        .drop("_marks", "_after_blank")
    )
