"""Removal of long repeated byte strings, wherever they start, by names of the places of a difference cover.

A difference cover is a set of sampled places such that any two suffixes have a sampled place at the same
distance from their starts. The cover used here is content-defined: every window of LENGTH bytes has an
anchor, the place of its least gram hash, and equal windows have equal anchors at equal distances. So, as
with residues of a modulus, suffixes at sampled places are named first, and all remaining ones are
compared by their distance to a sampled place and its name; yet there is one sampled place in about
ninety bytes instead of two in three, so that the names of a corpus fit on its disks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import rolling
from .common import apart, discard, rejoined, saved, table

LENGTH = 200
GRAM = 24
PIECE_BYTES = 1 << 22
# Texts with more runs than this are in blocks of their own.
BLOCK_RUNS = 1024
# Rows of one gram that a task compares window by window; more are narrowed down node by node.
HOT_ROWS = 20_000
BATCH_ROWS = 20_000
# Windows per node while the ends of a repeat are narrowed down.
NODES = (32, 8, 1)


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def runs_of(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """Runs of windows with one anchor: lo (first window start), size (windows), off (from lo to the anchor),
    gram (hash at the anchor) and name (hash of all bytes of the run's windows and the anchor's place)."""
    parts = []
    width = length - gram + 1
    for first in range(0, max(0, len(data) - length + 1), PIECE_BYTES):
        piece = data[first:first + PIECE_BYTES + length - 1]
        n = len(piece)
        sums = rolling.prefix_sums(piece)
        places = np.arange(n - gram + 1)
        hashes = rolling.span_hashes(sums, places, places + gram)
        # The leftmost of the least: the place breaks ties and is read off the result.
        ranked = (hashes & ~np.uint64(0xFFFFFFFF)) | places.astype(np.uint64)
        blocks = np.full(-(-len(ranked) // width) * width, ~np.uint64(0))
        blocks[:len(ranked)] = ranked
        blocks = blocks.reshape(-1, width)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        starts = np.arange(n - length + 1)
        anchors = (np.minimum(behind[starts], ahead[starts + width - 1]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        lo = np.flatnonzero(np.append(True, anchors[1:] != anchors[:-1]))
        end = np.append(lo[1:], len(starts))
        parts.append((lo + first, end - lo, anchors[lo] - lo, hashes[anchors[lo]],
                      rolling.span_hashes(sums, lo, end + (length - 1)) ^ rolling.mixed((anchors[lo] - lo).astype(np.uint64) + np.uint64(1))))
    columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.empty(0, np.int64)] * 3 + [np.empty(0, np.uint64)] * 2
    return dict(zip(("lo", "size", "off", "gram", "name"), columns))


def with_runs(texts: DataFrame) -> DataFrame:
    """Columns digest, n_bytes and runs (list of lo, size, off, gram, name) of every text."""

    def found_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(len(b), runs_of(np.frombuffer(b, dtype=np.uint8))) for b in (t.as_py().encode() for t in batch.column(1))]
            ends = np.cumsum([0, *(len(r["lo"]) for _, r in found)]).astype(np.int32)
            flat = {c: np.concatenate([r[c] for _, r in found]) for c in ("lo", "size", "off", "gram", "name")}
            kinds = {"lo": np.int64, "size": np.int32, "off": np.int32}
            runs = pa.StructArray.from_arrays(
                [pa.array(flat[c].astype(kinds[c]) if c in kinds else flat[c].view(np.int64)) for c in flat], names=list(flat))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n for n, _ in found], pa.int64()), pa.ListArray.from_arrays(ends, runs)],
                names=["digest", "n_bytes", "runs"])

    return texts.mapInArrow(
        found_runs, "digest binary, n_bytes bigint, runs array<struct<lo:bigint, size:int, off:int, gram:bigint, name:bigint>>")


def node_hashes(runs: DataFrame, windows: int) -> DataFrame:
    """Columns uid, lo, node, core, span for each node of ``windows`` window starts, by distance to the anchor.

    ``core`` is the hash of the bytes that all windows of the node share: unless it repeats, none of
    them does. ``span`` is that of all their bytes, null where the run has not all of them: where it
    repeats, all of them do. ``runs`` may name the larger nodes (parents, of ``parent`` windows) to look into.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            uid, lo, size, off = (batch.column(i).to_numpy() for i in range(4))
            data = batch.column(4).to_pylist()
            base = np.cumsum([0, *map(len, data)])[:-1]
            sums = rolling.prefix_sums(np.frombuffer(b"".join(data), dtype=np.uint8))
            listed = batch.column(5)
            row = np.repeat(np.arange(len(batch)), np.diff(listed.offsets.to_numpy()))
            node = listed.flatten().to_numpy()
            near, far = node * windows, (node + 1) * windows - 1  # distances to the anchor
            least = off - size + 1
            real = (far >= least[row]) & (near <= off[row])
            row, node, near, far = row[real], node[real], near[real], far[real]
            start = base[row] + off[row]
            core = rolling.span_hashes(sums, start - near, start - far + LENGTH) ^ rolling.mixed(node.astype(np.uint64) + np.uint64(1))
            full = (near >= least[row]) & (far <= off[row])
            a, b = np.where(full, start - far, 0), np.where(full, start - near + LENGTH, 0)
            span = rolling.span_hashes(sums, a, b)
            yield pa.RecordBatch.from_arrays(
                [pa.array(uid[row]), pa.array(lo[row]), pa.array(node), pa.array(core.view(np.int64)), pa.array(span.view(np.int64), mask=~full),
                 pa.array(lo[row] + off[row] - np.minimum(far, off[row])), pa.array(lo[row] + off[row] - np.maximum(near, least[row]) + LENGTH)],
                names=["uid", "lo", "node", "core", "span", "start", "stop"])

    return runs.select("uid", "lo", "size", "off", "data", "nodes").mapInArrow(
        hashed, "uid bigint, lo bigint, node bigint, core bigint, span bigint, start bigint, stop bigint")


def compared_windows(runs: DataFrame) -> DataFrame:
    """Rows (uid, start, stop) of the bytes of all windows that a gram's runs share, runs of one gram in one task.

    A task takes as many grams at a time as BATCH_ROWS runs have, or one gram of up to HOT_ROWS.
    """

    def shared(task: pa.Table) -> pa.RecordBatch:
        uid, lo, size, off, gram = (task.column(i).to_numpy() for i in range(5))
        data = task.column(5).to_pylist()
        base = np.cumsum([0, *map(len, data)])[:-1]
        sums = rolling.prefix_sums(np.frombuffer(b"".join(data), dtype=np.uint8))
        ends = np.cumsum(size)
        row = np.repeat(np.arange(len(uid)), size)
        at = np.arange(len(row)) - (ends - size)[row]
        start = base[row] + at
        # A window's suffix: its distance to the anchor with the gram there, and its bytes.
        key = rolling.span_hashes(sums, start, start + LENGTH) ^ rolling.mixed((off[row] - at).astype(np.uint64) + gram.view(np.uint64)[row])
        order = np.argsort(key, kind="stable")
        equal = key[order[1:]] == key[order[:-1]]
        hit = np.zeros(len(key) + 2, dtype=bool)
        hit[1:-1][order] = np.append(False, equal) | np.append(equal, False)
        first = np.append(True, row[1:] != row[:-1])
        # Ranges of neighbouring windows of one run.
        begin = hit[1:-1] & (first | ~hit[:-2])
        stop = hit[1:-1] & (np.append(first[1:], True) | ~hit[2:])
        b, e = np.flatnonzero(begin), np.flatnonzero(stop)
        return pa.RecordBatch.from_arrays([pa.array(uid[row[b]]), pa.array(lo[row[b]] + at[b]), pa.array(lo[row[e]] + at[e] + LENGTH)],
                                          names=["uid", "start", "stop"])

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if len(held) >= BATCH_ROWS:
                gram = held.column(4).to_numpy()
                changes = np.flatnonzero(gram[1:] != gram[:-1]) + 1
                if len(changes):
                    yield shared(held.slice(0, changes[-1]))
                    held = held.slice(changes[-1])
        if held is not None and len(held):
            yield shared(held)

    placed = runs.repartition("gram").sortWithinPartitions("gram").select("uid", "lo", "size", "off", "gram", "data")
    return placed.mapInArrow(tasks, "uid bigint, start bigint, stop bigint")


def narrowed(runs: DataFrame) -> list[DataFrame]:
    """Tables (uid, start, stop) of the repeated bytes in the given runs, found exactly, node by node."""
    spans, asked, last, ratio = [], None, None, None
    for windows in NODES:
        if asked is None:
            nodes = F.sequence(F.floor((F.col("off") - F.col("size") + 1) / windows), F.floor(F.col("off") / windows))
            rows = node_hashes(runs.withColumn("nodes", nodes), windows)
        else:
            ratio = last // windows
            inner = F.flatten(F.transform("parents", lambda p: F.sequence(p * ratio, p * ratio + (ratio - 1))))
            rows = node_hashes(runs.join(asked, ["uid", "lo"]).withColumn("nodes", inner), windows)
        rows = saved(rows, "nodes")
        by_core = rows.groupBy("core").agg(F.count("*").alias("n_core"), F.count("span").alias("n_full"), F.min("span").alias("s1"), F.max("span").alias("s2"))
        by_span = rows.where("span is not null").groupBy("core", "span").agg(F.count("*").alias("n_span"), F.min(F.struct("uid", "lo")).alias("first"))
        shared = rows.join(by_core.where("n_core > 1"), "core").join(by_span, ["core", "span"], "left")
        shared = saved(shared, "shared-nodes")
        spans.append(shared.where("n_span > 1").select("uid", "start", "stop"))
        if windows == NODES[-1]:
            break
        # One node of each span goes on, for others to be compared with; a core of one span only is settled.
        settled = (F.col("n_full") == F.col("n_core")) & (F.col("s1") == F.col("s2"))
        first = (F.col("first.uid") == F.col("uid")) & (F.col("first.lo") == F.col("lo"))
        open_ = shared.where(~settled & (F.col("span").isNull() | (F.col("n_span") == 1) | first))
        asked, last = open_.groupBy("uid", "lo").agg(F.collect_list("node").alias("parents")), windows
    return spans


def joined_places(group: pa.Table) -> pa.Table:
    """For every text of a block the ranges of bytes that the listed runs cover, neighbours joined."""
    places = pc.list_flatten(group["places"].combine_chunks())
    uid, lo, size = (pc.struct_field(places, i).to_numpy() for i in range(3))
    order = np.lexsort((lo, uid))
    uid, start, stop = uid[order], lo[order], lo[order] + size[order] + (LENGTH - 1)
    # Texts are laid out one after another, so that one running maximum serves all.
    first = np.append(True, uid[1:] != uid[:-1])
    shift = (np.cumsum(first) - 1) * (int(stop.max(initial=0)) + 1)
    reach = np.maximum.accumulate(stop + shift)
    new = np.flatnonzero(np.append(True, first[1:] | ((start + shift)[1:] > reach[:-1])))
    ends = (reach - shift)[np.append(new[1:], len(uid)) - 1]
    owner = np.flatnonzero(np.append(True, uid[new][1:] != uid[new][:-1]))
    ranges = pa.StructArray.from_arrays([pa.array(start[new]), pa.array(ends)], names=["start", "stop"])
    listed = pa.ListArray.from_arrays(np.append(owner, len(new)).astype(np.int32), ranges)
    return pa.table({"uid": pa.array(uid[new][owner]), "spans": listed})


def repeated_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """Columns digest, spans: the byte ranges (start, stop, overlapping as found) of every distinct text of ``docs``
    that a string of LENGTH bytes covers which also starts elsewhere; texts without any do not appear.

    Equal texts are taken once; if there are several of LENGTH bytes or more, all their bytes count.
    """
    texts = docs.select(digest(F.col(text)).alias("digest"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    once = with_runs(texts).groupBy("digest").agg(F.count("*").alias("copies"), F.first("n_bytes").alias("n_bytes"), F.first("runs").alias("runs"))
    distinct = saved(once.withColumn("uid", F.monotonically_increasing_id()), "runs-of-texts")
    # A block has up to 1,024 texts of up to 1,024 runs, or a mebibyte of a longer text.
    block = F.when(F.col("n_runs") <= BLOCK_RUNS, F.shiftright("uid", 10)).otherwise(F.xxhash64("uid", F.shiftright("lo", 20)))
    runs = distinct.select("uid", F.size("runs").alias("n_runs"), F.inline("runs")).withColumn("block", block).drop("n_runs")
    # Counts are tables of their own, so that Spark can split a frequent gram when it joins.
    common = saved(runs.groupBy("gram").agg(F.count("*").alias("_n")).where("_n > 1").select("gram"), "grams")
    runs = saved(runs.join(common, "gram"), "runs")
    ids = saved(distinct.select("digest", "copies", "n_bytes", "uid"), "texts")
    discard(distinct, common)

    # Equal names: sampled suffixes that agree in every window of their runs. Places of a name are listed by block,
    # and stay listed until the ranges of a text are put together.
    packed = saved(runs.groupBy("gram", "name", "block").agg(
        F.collect_list(F.struct("uid", "lo", "size")).alias("places"), F.min(F.struct("uid", "lo", "size", "off")).alias("first")), "places")
    kinds = saved(packed.groupBy("gram", "name").agg(F.sum(F.size("places")).alias("n"), F.min("first").alias("first")), "kinds")
    same = packed.join(kinds.where("n > 1").select("gram", "name"), ["gram", "name"], "left_semi").select("block", "places")
    same = saved(same.groupBy("block").applyInArrow(joined_places, "uid bigint, spans array<struct<start: bigint, stop: bigint>>"), "same")
    found = []
    discard(runs, packed)

    # Names that differ though the gram is shared: the windows at the ends of a repeat. One run stands for each name.
    several = saved(kinds.groupBy("gram").agg(F.count("*").alias("names")).where("names > 1"), "several")
    asked = saved(kinds.join(several, "gram").select("gram", "names", "first.*"), "asked")
    wanted = asked.join(ids, "uid").groupBy("digest", "uid").agg(F.collect_list(F.struct("lo", "size", "off", "gram", "names")).alias("runs"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = ([], [], [], [], [], [], [])
            for uid, body, listed in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                data = body.as_py().encode()
                for r in listed.as_py():
                    part = data[r["lo"]:r["lo"] + r["size"] + LENGTH - 1]
                    for column, value in zip(out, (uid, r["lo"], r["size"], r["off"], r["gram"], r["names"], part)):
                        column.append(value)
            kinds = (*[pa.int64()] * 6, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)],
                                             names=["uid", "lo", "size", "off", "gram", "names", "data"])

    once = texts.groupBy("digest").agg(F.first("text").alias("text"))  # copies meet before the shuffle
    bodies = once.join(wanted, "digest").select("uid", "text", "runs").mapInArrow(
        cut, "uid bigint, lo bigint, size bigint, off bigint, gram bigint, names bigint, data binary")
    bodies = saved(bodies, "run-bytes")
    discard(asked, kinds, several)
    found.append(saved(compared_windows(bodies.where(F.col("names") <= HOT_ROWS)), "ends"))
    hot = bodies.where(F.col("names") > HOT_ROWS)
    if not hot.isEmpty():
        found += narrowed(hot)
    found.append(ids.where(f"copies > 1 and n_bytes >= {LENGTH}").select("uid", F.lit(0).cast("bigint").alias("start"), F.col("n_bytes").alias("stop")))
    spans = found[0]
    for more in found[1:]:
        spans = spans.unionByName(more)
    listed = spans.groupBy("uid").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    listed = same.unionByName(listed).groupBy("uid").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    return saved(listed.join(ids, "uid").select("digest", "spans"), "spans")


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal ranges of the bytes that the spans cover."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["start"], s["stop"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remaining(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for s in spans for x in s), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))


def removals(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns key, n_bytes, n_removed, n_spans, kept_sha256 for every row.

    A byte goes if it lies in a string of LENGTH bytes that also starts anywhere else in the input,
    the same text included; all its occurrences go. Null texts are empty; texts under LENGTH bytes
    keep everything; rows that repeat an id are different places.
    """
    spans = repeated_spans(docs, text)

    def reported(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = ([], [], [], [])
            for body, listed in zip(batch.column(1), batch.column(2)):
                data, found = body.as_py().encode(), merged(listed.as_py())
                for column, value in zip(out, (len(data), sum(b - a for a, b in found), len(found), hashlib.sha256(remaining(data, found)).hexdigest())):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds))],
                                             names=["key", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), digest(F.col(text)).alias("digest"))
    return rows.join(spans, "digest", "left").select("key", "text", "spans").mapInArrow(
        reported, "key bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string").withColumnRenamed("key", key)


def without_repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with the repeated bytes taken out of their texts; what a cut leaves of a character goes too."""
    @F.pandas_udf("string")
    def shortened(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if s is None else remaining(t.encode(), merged(list(s))).decode("utf-8", "ignore") for t, s in zip(texts, spans)])

    own = F.col(f"row.`{text}`")
    rows = apart(docs, digest=digest(F.col(text))).join(repeated_spans(docs, text), "digest", "left")
    return rejoined(rows, docs, **{text: F.when(F.col("spans").isNull(), own).otherwise(shortened(own, F.col("spans")))})


def op8_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removals(table(spark, sf_dir, "documents"))


QUERIES = {"op8_passage_dedup": op8_passage_dedup}
ORACLE = {"op8_passage_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, hash(substr(h, 2 * p + 1, 400)) AS k FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 199)) AS p FROM d WHERE len(h) >= 400)),
again AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
gone AS (SELECT doc_id, p, coalesce(p > 200 + lag(p) OVER (PARTITION BY doc_id ORDER BY p), true)::INTEGER AS new FROM w SEMI JOIN again USING (k)),
numbered AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM gone),
spans AS (SELECT doc_id, span, min(p) AS a, max(p) + 200 AS b FROM numbered GROUP BY doc_id, span),
cuts AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans),
kept AS (SELECT c.doc_id, sum(c.b - c.a) AS n_removed, count(*) AS n_spans,
  string_agg(substr(d.h, 2 * c.before + 1, 2 * (c.a - c.before)), '' ORDER BY c.a) || substr(any_value(d.h), 2 * max(c.b) + 1) AS h
  FROM cuts c JOIN d ON d.doc_id = c.doc_id GROUP BY c.doc_id)
SELECT d.doc_id, len(d.h) // 2 AS n_bytes, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed, coalesce(k.n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(k.h, d.h))) AS kept_sha256
FROM d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""}
