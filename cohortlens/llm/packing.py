"""Best-fit packing of token sequences into bins of several permitted lengths."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import table, words_and_end

CAPACITIES = (512, 1024, 2048, 4096, 8192)
# What a sequence costs, in tokens: its own overhead, its length, and attention, which grows with the square of the length.
BIN_COST = 32
ATTENTION = 1 << 17
GROUP_ROWS = 20_000


def sequence_cost(capacity: int, bin_cost: int = BIN_COST, attention: int = ATTENTION) -> float:
    return bin_cost + capacity + capacity * capacity / attention


def best_fit(lengths: Sequence[int], capacities: Sequence[int] = CAPACITIES, bin_cost: int = BIN_COST,
             attention: int = ATTENTION) -> list[tuple[int, int, int]]:
    """(bin, offset, capacity) of each length; every length must fit the largest capacity.

    Longest first, each piece goes into the open bin that it fills best. If none has room, a bin is opened at the capacity that
    costs least per token of what the remaining pieces can fill there. At the end every bin shrinks to the smallest capacity that holds its contents.
    Packings with fewer or single capacities are tried as well, and the cheapest of all is taken.
    """
    capacities, most = sorted(capacities), max(lengths, default=0)
    cost = {c: sequence_cost(c, bin_cost, attention) for c in capacities}
    found = [_packed(lengths, capacities, opened, cost) for i, c in enumerate(capacities) if c >= most for opened in {tuple(capacities[:i + 1]), (c,)}]
    return min(found, key=lambda placed: sum(cost[c] for c in {b: c for b, _, c in placed}.values()))


def _fill(room: int, sizes: list[int], left: dict[int, int]) -> int:
    """Tokens that the remaining pieces, largest first, put into ``room``."""
    filled, at = 0, len(sizes)
    while room > filled and (at := bisect_right(sizes, room - filled, 0, at)):
        at -= 1
        filled += sizes[at] * min(left[sizes[at]], (room - filled) // sizes[at])
    return filled


def _packed(lengths: Sequence[int], capacities: list[int], opened: Sequence[int], cost: Mapping[int, float]) -> list[tuple[int, int, int]]:
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    placed: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    free: list[tuple[int, int]] = []  # (room, bin), ascending
    filled: list[int] = []
    left = Counter(lengths)
    sizes = sorted(left)
    held = lambda n: capacities[bisect_left(capacities, n)]
    for i in order:
        n = lengths[i]
        left[n] -= 1
        if not left[n]:
            sizes.pop()  # the longest
        at = bisect_left(free, (n, -1))
        if at < len(free):
            room, b = free.pop(at)
        else:
            contents = {c: n + _fill(c - n, sizes, left) for c in opened if c >= n}
            room = min(contents, key=lambda c: (cost[held(contents[c])] / contents[c], c))
            b = len(filled)
            filled.append(0)
        placed[i] = (b, filled[b])
        filled[b] += n
        if room > n:
            insort(free, (room - n, b))
    return [(b, offset, held(filled[b])) for b, offset in placed]


def pack(docs: DataFrame, tokens: Column, key: str = "doc_id", capacities: Sequence[int] = CAPACITIES,
         bin_cost: int = BIN_COST, attention: int = ATTENTION, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Columns key, piece, n_tokens, bin (group and number), capacity, offset.

    A row longer than the largest capacity is cut into full pieces and a rest. Pieces are dealt by
    hash to groups of about ``group_rows``, so the work is spread and a group stays small whatever
    the input; each group is packed alone. Rows of no (or null) tokens take no place and do not
    appear. Repeated ids, and rows without one, are packed once for each row; of equal lengths the smaller id goes first.
    An empty table has no rows, and further columns are not read.
    """
    most = max(capacities)
    pieces = (
        docs.select(F.col(key).alias("key"), F.coalesce(tokens.cast("bigint"), F.lit(0)).alias("n"))
        .where("n > 0")
        .select("key", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / most).cast("int"))).alias("piece"))
        .select("key", "piece", F.least(F.lit(most), F.col("n") - F.col("piece") * most).cast("int").alias("n_tokens"))
    )
    groups = max(1, -(-pieces.count() // group_rows))
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("key", "piece"), F.lit(groups)).cast("int"))

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["key", "piece", "n_tokens"], na_position="first")
        found = best_fit(rows.n_tokens.tolist(), capacities, bin_cost, attention)
        names = [f"{g}-{b}" for g, (b, _, _) in zip(rows.group, found)]
        return pd.DataFrame({"key": rows.key, "piece": rows.piece, "n_tokens": rows.n_tokens, "bin": names,
                             "capacity": [c for _, _, c in found], "offset": [o for _, o, _ in found]})

    schema = "key bigint, piece int, n_tokens int, bin string, capacity int, offset int"
    typed = dealt.select(F.col("key").cast("bigint"), "piece", "n_tokens", "group")
    return typed.groupBy("group").applyInPandas(packed, schema).withColumnRenamed("key", key)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), words_and_end(F.col("text")))


QUERIES = {"op3_best_fit_packing": op3_best_fit_packing}
ORACLE: dict[str, str] = {}
