"""Sets of patients as bitmaps over dense patient numbers.

A set is a row per block of 32,768 numbers in which it has members, with a bit for each number, in the layout
of Spark's bitmap functions. Set algebra and sizes work on blocks: nothing is shuffled, compared or counted
patient by patient once the bitmaps are made.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from .ordering import positions

# Task functions travel with the job, so executors need numpy and pyarrow but not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Numbers in a block, fixed by the bitmap functions.
BLOCK = 1 << 15
# Numbers of a block that are compared at once when sets meet in pairs.
SLICE = 1 << 12
LISTS_AT_ONCE = 512


def numbered(patients: DataFrame) -> DataFrame:
    """``(pid, number)``: the distinct patients with dense numbers from 0, in the order of their ids."""
    return positions(patients.select("pid").where(F.col("pid").isNotNull()).distinct(), [], ["pid"], "number")


def place(number: Column) -> tuple[Column, Column]:
    """The block of a number and its bit there."""
    return F.bitmap_bucket_number(number + 1).alias("block"), F.bitmap_bit_position(number + 1)


def bitmaps(sets: DataFrame, numbers: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``(keys, block, bits)`` of the sets ``(keys, pid)``, repeated rows counting once; patients without a number are in no set."""
    block, bit = place(F.col("number"))
    rows = sets.select(*keys, "pid").join(numbers, "pid").select(*keys, block, bit.alias("bit"))
    return rows.groupBy(*keys, "block").agg(F.bitmap_construct_agg("bit").alias("bits"))


def flag_bitmaps(flags: DataFrame, numbers: DataFrame, names: Sequence[str], key: str) -> DataFrame:
    """``(key, block, bits)``: for each of the boolean columns ``names`` the set of patients where it holds, from one aggregate."""
    block, bit = place(F.col("number"))
    rows = flags.join(numbers, "pid").select(block, bit.alias("bit"), *names)
    wide = rows.groupBy("block").agg(*[F.bitmap_construct_agg(F.when(F.col(n), F.col("bit"))).alias(n) for n in names])
    listed = F.array(*[F.struct(F.lit(n).alias(key), F.col(n).alias("bits")) for n in names])
    return wide.select("block", F.inline(listed)).where(F.bitmap_count("bits") > 0).select(key, "block", "bits")


def union(*sets: DataFrame) -> DataFrame:
    """``(block, bits)`` of the patients in any of the sets."""
    return _together(sets).groupBy("block").agg(F.bitmap_or_agg("bits").alias("bits"))


def intersection(*sets: DataFrame) -> DataFrame:
    """``(block, bits)`` of the patients in all of the sets; a block that one of them lacks is empty."""
    found = _together(sets).groupBy("block").agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("n"))
    return found.where((F.col("n") == len(sets)) & (F.bitmap_count("bits") > 0)).select("block", "bits")


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(block, bits)`` of the patients in ``left`` but not in ``right``."""

    def without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [a if b is None else (np.frombuffer(a, np.uint8) & ~np.frombuffer(b, np.uint8)).tobytes()
                    for a, b in zip(batch["bits"].to_pylist(), batch["other"].to_pylist())]
            yield pa.RecordBatch.from_arrays([batch["block"], pa.array(bits, pa.binary())], names=["block", "bits"])

    rows = left.select("block", "bits").join(right.select("block", F.col("bits").alias("other")), "block", "left")
    return rows.mapInArrow(without, "block bigint, bits binary").where(F.bitmap_count("bits") > 0)


def _together(sets: Sequence[DataFrame]) -> DataFrame:
    rows = sets[0].select("block", "bits")
    for more in sets[1:]:
        rows = rows.unionByName(more.select("block", "bits"))
    return rows


def sizes(sets: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``(keys, patients)``: the members of every set."""
    return sets.groupBy(*keys).agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("patients"))


def members(sets: DataFrame, numbers: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``(keys, pid)``: the sets written out again."""
    fields = [sets.schema[k] for k in keys]

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                bits = np.flatnonzero(np.unpackbits(np.frombuffer(batch["bits"][i].as_py(), np.uint8), bitorder="little"))
                own = [pa.array([batch[k][i].as_py()] * len(bits), batch[k].type) for k in keys]
                yield pa.RecordBatch.from_arrays([*own, pa.array(bits + (batch["block"][i].as_py() - 1) * BLOCK, pa.int64())], names=[*keys, "number"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "number bigint"])
    return sets.select(*keys, "block", "bits").mapInArrow(listed, schema).join(numbers, "number").select(*keys, "pid")


def overlaps(sets: DataFrame, key: str) -> DataFrame:
    """``(key, other, patients)``: how many patients every two sets share, a set with itself included, in both orders;
    pairs that share nobody have no row.

    The sets of a block meet in one task, some hundred rows against some hundred at a time, as a product of their bits; a
    task sends on one number per pair, whatever the number of patients.
    """
    kind = sets.schema[key].dataType.simpleString()

    def met(group: pa.Table) -> pa.Table:
        group = group.sort_by(key)
        names, raw = group[key], group["bits"].to_pylist()
        n = len(raw)
        unpacked: Callable[[int, int, int], np.ndarray] = lambda a, b, at: np.unpackbits(
            np.frombuffer(b"".join(r[at:at + SLICE // 8] for r in raw[a:b]), np.uint8).reshape(b - a, -1), axis=1, bitorder="little").astype(np.float32)
        left, right, both = [], [], []
        for a in range(0, n, LISTS_AT_ONCE):
            for b in range(a, n, LISTS_AT_ONCE):
                ea, eb = min(a + LISTS_AT_ONCE, n), min(b + LISTS_AT_ONCE, n)
                # Sums stay below 2^24, so they are exact.
                found = sum(unpacked(a, ea, at) @ unpacked(b, eb, at).T for at in range(0, BLOCK // 8, SLICE // 8))
                i, j = np.nonzero(found)
                some = (i + a) <= (j + b)
                left.append(i[some] + a)
                right.append(j[some] + b)
                both.append(found[i[some], j[some]].astype(np.int64))
        i, j = np.concatenate(left), np.concatenate(right)
        return pa.table({"left": names.take(pa.array(i)), "right": names.take(pa.array(j)), "both": np.concatenate(both)})

    counts = sets.select(key, "block", "bits").groupBy("block").applyInArrow(met, f"left {kind}, right {kind}, both bigint")
    pairs = counts.groupBy("left", "right").agg(F.sum("both").alias("patients"))
    one = pairs.select(F.col("left").alias(key), F.col("right").alias("other"), "patients")
    turned = pairs.where(F.col("left") != F.col("right")).select(F.col("right").alias(key), F.col("left").alias("other"), "patients")
    return one.unionByName(turned)
