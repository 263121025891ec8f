"""Ordered positions and top-n without ever putting one key's rows into one task."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..session import settled

# Task functions travel with the job, so executors need numpy and pyarrow but not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BINS_PER_OCTAVE = 64
# Above the bins of the smallest number that is not zero.
FIRST_BIN = 1075 * BINS_PER_OCTAVE
LARGEST = sys.float_info.max


def running_total(df: DataFrame, keys: Sequence[str], order: Sequence[str], weight: Column, name: str) -> DataFrame:
    """Add ``name``: the sum of ``weight`` over the rows of the same key that sort before this row.

    Rows are range-partitioned by (keys, order), so a hot key spreads over many slices. Each slice
    adds up its own rows while they pass; a slice's starting value is the sum of the key's earlier slices, of which
    there are at most as many as partitions. Rows equal in every column are interchangeable. The slices are files, the attribute
    ``slices`` of the result, which may be deleted (``unsettle``) once nothing reads the result any more.
    """
    marked = (
        df.withColumn("_weight", weight.cast("bigint"))
        .withColumn("_tie", F.xxhash64(*[F.col(c) for c in df.columns]))
        .withColumn("_same", F.monotonically_increasing_id())
    )
    # What only orders the rows is not needed after that.
    columns = [*df.columns, "_weight"]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, held = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            weights = pc.fill_null(batch["_weight"], 0).to_numpy()
            new = np.append(True, np.zeros(n - 1, dtype=bool))
            for key in keys:
                code = pc.fill_null(batch[key].dictionary_encode().indices, -1).to_numpy()
                new[1:] |= code[1:] != code[:-1]
            starts = np.flatnonzero(new)
            sizes = np.diff(np.append(starts, n))
            before = np.cumsum(weights) - weights
            local = before - np.repeat(before[starts], sizes)
            if tuple(batch[key][0].as_py() for key in keys) == last:
                local[:sizes[0]] += held
            last, held = tuple(batch[key][n - 1].as_py() for key in keys), int(local[-1] + weights[-1])
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in columns), pa.array(np.full(n, part, dtype=np.int32)), pa.array(local, pa.int64())],
                                             names=[*columns, "_slice", "_local"])

    schema = T.StructType([*(marked.schema[c] for c in columns), T.StructField("_slice", T.IntegerType()), T.StructField("_local", T.LongType())])
    by = [F.col(c) for c in (*keys, *order, "_tie", "_same")]
    sliced = settled(marked.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(summed, schema))
    group = [*keys, "_slice"]
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        sliced.groupBy(*group)
        .agg(F.sum("_weight").alias("_slice_sum"))
        .withColumn("_start", F.coalesce(F.sum("_slice_sum").over(earlier), F.lit(0)))
        .drop("_slice_sum")
    )
    # Only the first key of a slice can have begun in an earlier one, so there is at most one row for each slice that is not 0.
    later = starts.where(F.col("_start") != 0)
    placed = sliced.where(reduce(and_, [F.col(k).isNotNull() for k in keys], F.lit(True)))
    found = placed.join(F.broadcast(later), group, "left").withColumn("_start", F.coalesce("_start", F.lit(0)))
    found = found.withColumn(name, F.col("_start") + F.col("_local")).drop("_weight", "_slice", "_start", "_local")
    found.slices = sliced
    return found


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Add ``name``: the 0-based position of each row within its key (or overall, with no key)."""
    return running_total(df, keys, order, F.lit(1), name)


def weight_bin(weight: Column) -> Column:
    """A whole number that grows with a weight: BINS_PER_OCTAVE steps for each doubling, so that a bin holds weights that
    differ by about one part in a hundred and all finite numbers fall into some 300,000 bins. Null and not-a-number come last."""
    size = F.abs(weight.cast("double"))
    octave = F.when(size == 0, F.lit(0)).otherwise(F.floor(F.log2(F.least(size, F.lit(LARGEST))) * BINS_PER_OCTAVE) + FIRST_BIN)
    return F.when(weight.isNull() | F.isnan(size), F.lit(-2 * FIRST_BIN)).otherwise(F.signum(weight.cast("double")) * octave).cast("bigint")


def top_n(df: DataFrame, keys: Sequence[str], weight: Column, ties: Sequence[Column], n: int, rank: str) -> DataFrame:
    """The ``n`` rows of largest ``weight`` per key with their 1-based ``rank``; ``ties`` orders equal weights and should leave none.

    A histogram of the weights, summed up where the rows lie, tells for each key the bin in which the n-th row falls. Rows of
    smaller bins are dropped in place, so what is moved and ranked is n rows and the rest of one bin.
    """
    if not keys:
        return top_n(df.withColumn("_all", F.lit(0)), ["_all"], weight, ties, n, rank).drop("_all")
    binned = df.withColumn("_weight_bin", weight_bin(weight))
    counts = binned.groupBy(*keys, "_weight_bin").agg(F.count("*").alias("_rows"))
    above = Window.partitionBy(*keys).orderBy(F.desc("_weight_bin")).rowsBetween(Window.unboundedPreceding, -1)
    # The last bin that begins within the first n rows.
    cuts = counts.withColumn("_above", F.coalesce(F.sum("_rows").over(above), F.lit(0))).where(F.col("_above") < n) \
        .groupBy(*keys).agg(F.min("_weight_bin").alias("_cut"))
    overall = Window.partitionBy(*keys).orderBy(F.nanvl(weight.cast("double"), F.lit(None)).desc_nulls_last(), *ties)
    return (
        binned.join(cuts, list(keys)).where(F.col("_weight_bin") >= F.col("_cut")).drop("_weight_bin", "_cut")
        .withColumn(rank, F.row_number().over(overall)).where(F.col(rank) <= n)
    )
