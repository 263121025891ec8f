"""Near-duplicate documents: an LSH forest over MinHash signatures, confirmed on whole shingle sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import rolling
from .common import apart, rejoined, saved, table
from .graph import components

WORDS = 5
TREES = 16
HASHES_PER_TREE = 8
SIGNATURE = TREES * HASHES_PER_TREE
# Prefix lengths of the sorted orders: a region that stays crowded is read at the next one.
DEPTHS = (2, 4, 8, 16, 32, 64, 128)
CROWDED = 16
# Nodes of a crowded region meet block by block; one block has about so many rows and bytes at most.
BLOCK_ROWS = 1024
BLOCK_BYTES = 1 << 23
SIMILAR_PERCENT = 75
# Estimates below this share of equal hashes are five deviations from the threshold.
LEAST_ESTIMATE = 0.56


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text, A-Z taken as a-z. A text of fewer
    words is one shingle, one without words has none."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.empty(0, dtype=np.uint64)
    data = np.frombuffer(b" ".join(parts), dtype=np.uint8)
    blanks = np.flatnonzero(data == 32)
    start, end = np.append(0, blanks + 1), np.append(blanks, len(data))
    last = max(1, len(parts) - words + 1)
    return np.unique(rolling.span_hashes(rolling.prefix_sums(data), start[:last], end[-last:]))


def _multipliers() -> np.ndarray:
    return rolling.mixed(np.arange(1, SIGNATURE + 1, dtype=np.uint64) * np.uint64(rolling.BASE)) | np.uint64(1)


def signature(hashes: np.ndarray) -> np.ndarray:
    """MinHash values (32 bits each) of a set that is not empty."""
    factors, least = _multipliers()[:, None], np.full(SIGNATURE, ~np.uint64(0))
    for i in range(0, len(hashes), 4096):
        least = np.minimum(least, (factors * hashes[None, i:i + 4096]).min(axis=1))
    return (least >> np.uint64(32)).astype(np.uint32)


def prefix_keys(signatures: np.ndarray, tree: np.ndarray | int, depth: int) -> np.ndarray:
    """Region keys: a hash of the first ``depth`` values of each signature in the tree's own order."""
    places = (np.atleast_1d(tree)[:, None] * HASHES_PER_TREE + np.arange(depth)[None, :]) % SIGNATURE
    values = np.take_along_axis(signatures, np.broadcast_to(places, (len(signatures), depth)), axis=1).astype(np.uint64)
    key = np.zeros(len(signatures), dtype=np.uint64)
    for i in range(depth):
        key = rolling.mixed(key * np.uint64(rolling.BASE) + values[:, i] + np.uint64(1))
    return key.view(np.int64)


def sketches(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Columns key, n_shingles, node (a digest of the shingle set; null without shingles) and signature."""

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, nodes, signed = [], [], []
            for body in batch.column(1):
                found = shingles(body.as_py())
                sizes.append(len(found))
                nodes.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                signed.append(signature(found).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), pa.array(signed, pa.binary())],
                names=["key", "n_shingles", "node", "signature"])

    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(sketched, "key bigint, n_shingles bigint, node binary, signature binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(len(column), SIGNATURE)


def first_regions(nodes: DataFrame) -> DataFrame:
    """Columns tree, region, node: the region of every node in every tree at the first depth."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signatures = _matrix(batch.column(1))
            keys = np.stack([prefix_keys(signatures, t, DEPTHS[0]) for t in range(TREES)], axis=1)
            listed = pa.ListArray.from_arrays(np.arange(len(batch) + 1, dtype=np.int32) * TREES, keys.ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0), listed], names=["node", "keys"])

    keys = nodes.select("node", "signature").mapInArrow(keyed, "node binary, keys array<bigint>")
    return keys.select(F.posexplode("keys").alias("tree", "region"), "node")


def next_regions(crowded: DataFrame, nodes: DataFrame, depth: int) -> DataFrame:
    """The rows (tree, region, node) of crowded regions at a longer prefix."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = prefix_keys(_matrix(batch.column(2)), batch.column(1).to_numpy(zero_copy_only=False), depth)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(keys), batch.column(0)], names=["tree", "region", "node"])

    rows = crowded.join(nodes.select("node", "signature"), "node").select("node", "tree", "signature")
    return rows.mapInArrow(keyed, "tree int, region bigint, node binary")


def forest(nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The regions (tree, region, node) of two to CROWDED nodes, each at the depth where it got so small,
    the pairs (a, b) of every node with the first node of each region it was in at any depth, and
    the larger regions of the first depth, whose nodes part without being compared at the next ones.

    Nodes alone in a region have no neighbour with that prefix and go no further. Regions that are
    crowded at the full depth hold equal signatures; their pairs with the first node stand for them.
    """
    rows, small, stars, large = first_regions(nodes), [], [], None
    for level, depth in enumerate(DEPTHS):
        found = rows.groupBy("tree", "region").agg(F.count("*").alias("n"), F.min("node").alias("first")).where("n > 1")
        shared = saved(rows.join(found, ["tree", "region"]), "regions")
        stars.append(shared.where(F.col("node") != F.col("first")).select(F.col("first").alias("a"), F.col("node").alias("b")))
        small.append(shared.where(F.col("n") <= CROWDED).select(F.lit(level).alias("level"), "tree", "region", "node"))
        crowded = shared.where(F.col("n") > CROWDED).select("tree", "region", "node")
        large = crowded if level == 0 else large
        if depth == DEPTHS[-1] or crowded.isEmpty():
            break
        rows = saved(next_regions(crowded, nodes, DEPTHS[level + 1]), "region-rows")
    regions, pairs = small[0], stars[0]
    for more in small[1:]:
        regions = regions.unionByName(more)
    for more in stars[1:]:
        pairs = pairs.unionByName(more)
    return regions, pairs.distinct(), large


def likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs whose set sizes and signatures allow the similarity asked for."""

    def estimated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            equal = (_matrix(batch.column(2)) == _matrix(batch.column(3))).mean(axis=1)
            yield batch.select([0, 1]).filter(pa.array(equal >= LEAST_ESTIMATE))

    side = lambda s: nodes.select(F.col("node").alias(s), F.col("signature").alias(f"s{s}"), F.col("n_shingles").alias(f"n{s}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b").where(
        100 * F.least("na", "nb") >= SIMILAR_PERCENT * F.greatest("na", "nb")).select("a", "b", "sa", "sb")
    return rows.mapInArrow(estimated, "a binary, b binary")


def confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets are similar."""
    pairs = saved(likely(pairs, nodes), "pairs")
    sets = shingle_sets(pairs.select(F.explode(F.array("a", "b")).alias("node")), nodes, docs, key, text)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                p, q = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                same.append(100 * both >= SIMILAR_PERCENT * (len(p) + len(q) - both))
            yield batch.select([0, 1]).filter(pa.array(same, pa.bool_()))

    side = lambda s: sets.select(F.col("node").alias(s), F.col("shingles").alias(f"s{s}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb").mapInArrow(compared, "a binary, b binary")


def shingle_sets(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """Columns node, shingles of the wanted nodes at least, made anew from the texts concerned."""
    needed = nodes.join(wanted.distinct(), "node", "left_semi").select(F.col("first_key").alias("_wanted"))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t.as_py()).tobytes() for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([hashlib.blake2b(s, digest_size=16).digest() for s in found], pa.binary()), pa.array(found, pa.binary())],
                names=["node", "shingles"])

    rows = docs.select(F.col(key).cast("bigint").alias("_key"), F.col(text).alias("text"))
    rows = rows.join(needed.distinct(), F.col("_key").eqNullSafe(F.col("_wanted")), "left_semi").select("text")
    return saved(rows.mapInArrow(listed, "node binary, shingles binary").dropDuplicates(["node"]), "shingles")


def in_blocks(rows: DataFrame, size: Column) -> DataFrame:
    """Every row once for each pair of blocks (i, j) of its region in which its block stands, every pair dealt on its own:
    the grouping would be content with rows that lie together by region."""
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK_ROWS, F.sum(size) / BLOCK_BYTES)).cast("int")
    counts = rows.groupBy("tree", "region").agg(blocks.alias("blocks"))
    dealt = rows.join(counts, ["tree", "region"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("blocks", "other")
    return dealt.repartition("tree", "region", "i", "j")


def _open_pairs(batch: pa.RecordBatch, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers of the two blocks and a matrix of the pairs that are likely, of different labels and in one region in no earlier tree."""
    block, i, j, tree = batch["block"].to_numpy(), batch["i"][0].as_py(), batch["j"][0].as_py(), batch["tree"][0].as_py()
    a, b = np.flatnonzero(block == i), np.flatnonzero(block == j)
    signatures, sizes = _matrix(batch["signature"]), batch["n_shingles"].to_numpy()
    left, right = np.ascontiguousarray(signatures[a].T), np.ascontiguousarray(signatures[b].T)
    equal, met = np.zeros((len(a), len(b)), dtype=np.int16), np.zeros((len(a), len(b)), dtype=bool)
    for c in range(SIGNATURE):
        same = left[c][:, None] == right[c][None, :]
        equal += same
        t, place = divmod(c, HASHES_PER_TREE)
        if t < tree and place < DEPTHS[0]:
            prefix = same if place == 0 else prefix & same
            if place == DEPTHS[0] - 1:
                met |= prefix
    na, nb = sizes[a][:, None], sizes[b][None, :]
    found = (equal >= LEAST_ESTIMATE * SIGNATURE) & ~met & (labels[a][:, None] != labels[b][None, :])
    found &= 100 * np.minimum(na, nb) >= SIMILAR_PERCENT * np.maximum(na, nb)
    return a, b, np.triu(found, 1) if i == j else found


def _one_batch(group: pa.Table) -> tuple[pa.RecordBatch, np.ndarray]:
    """The rows of a pair of blocks, and a number for each row's root."""
    batch = group.combine_chunks().to_batches()[0]
    return batch, batch["root"].dictionary_encode().indices.to_numpy().copy()


def crowded_links(crowded: DataFrame, roots: DataFrame, nodes: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """Links (a, b) that join all similar nodes of crowded regions which ``roots`` leave apart.

    All pairs of a region are compared by signature, block by block; nodes with a likely partner meet
    again with their whole sets. A task returns a spanning forest of the links it finds, never pairs.
    """
    joined = saved(crowded.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "crowded-roots")
    split = joined.groupBy("tree", "region").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 < r2")
    apart = joined.join(split.select("tree", "region"), ["tree", "region"], "left_semi")
    rows = saved(apart.join(nodes.select("node", "n_shingles", "signature"), "node"), "crowded")

    def promising(group: pa.Table) -> pa.Table:
        batch, labels = _one_batch(group)
        a, b, found = _open_pairs(batch, labels)
        at = pa.array(np.union1d(a[found.any(axis=1)], b[found.any(axis=0)]))
        return pa.table([batch[c].take(at) for c in ("tree", "region", "node")], names=["tree", "region", "node"])

    meeting = ["tree", "region", "i", "j"]
    likely_rows = in_blocks(rows, F.lit(4 * SIGNATURE)).groupBy(*meeting).applyInArrow(promising, "tree int, region bigint, node binary")
    likely_rows = saved(likely_rows.distinct(), "promising")
    sets = shingle_sets(likely_rows.select("node"), nodes, docs, key, text)
    rows = rows.join(likely_rows, ["tree", "region", "node"], "left_semi").join(sets, "node")

    def linked(group: pa.Table) -> pa.Table:
        batch, labels = _one_batch(group)
        a, b, found = _open_pairs(batch, labels)
        sizes, links = batch["n_shingles"].to_numpy(), []
        if found.any():
            ends = np.cumsum(sizes)
            names = np.unique(np.frombuffer(b"".join(batch["shingles"].to_pylist()), dtype=np.uint64), return_inverse=True)[1]
            has = np.zeros(len(names), dtype=bool)
            for n in np.flatnonzero(found.any(axis=1)):
                x = a[n]
                own = names[ends[x] - sizes[x]:ends[x]]
                has[own] = True
                for y in b[found[n]]:
                    if labels[x] != labels[y]:
                        both = np.count_nonzero(has[names[ends[y] - sizes[y]:ends[y]]])
                        if 100 * both >= SIMILAR_PERCENT * (sizes[x] + sizes[y] - both):
                            labels[labels == labels[y]] = labels[x]
                            links.append((x, y))
                has[own] = False
        sides = np.array(links, dtype=np.int64).reshape(-1, 2).T
        return pa.table([batch["node"].take(pa.array(side)) for side in sides], names=["a", "b"])

    return in_blocks(rows, 4 * SIGNATURE + 8 * F.col("n_shingles")).groupBy(*meeting).applyInArrow(linked, "a binary, b binary")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns key, n_shingles, component_id, kept for every row: documents are linked when their shingle
    sets have a Jaccard similarity of SIMILAR_PERCENT or more, and a component keeps its smallest id.

    Rows with equal sets form one node first, so copies never meet in pairs. Each node is then
    compared with the first node of its regions; what these comparisons leave apart is compared
    pair by pair within the final regions, of at most CROWDED nodes, and then block by block within
    the larger regions of the first depth. Null, empty and blank texts
    have no shingles and link with nothing. Rows that repeat an id get a row each.
    """
    rows = saved(sketches(docs, key, text), "sketches")
    nodes = saved(
        rows.where(F.col("node").isNotNull()).groupBy("node").agg(
            F.min("key").alias("first_key"), F.min(F.struct("n_shingles", "signature")).alias("r")).select(
            "node", "first_key", "r.n_shingles", "r.signature"), "nodes")
    regions, stars, crowded = forest(nodes)
    links = saved(confirmed(stars, nodes, docs, key, text), "links")
    roots = components(links)
    joined = regions.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    joined = saved(joined, "region-roots")
    split = joined.groupBy("level", "tree", "region").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 < r2")
    left = joined.join(split.select("level", "tree", "region"), ["level", "tree", "region"], "left_semi")
    left = left.select("level", "tree", "region", F.col("node").alias("a"), F.col("root").alias("ra"))
    right = left.select("level", "tree", "region", F.col("a").alias("b"), F.col("ra").alias("rb"))
    rest = left.join(right, ["level", "tree", "region"]).where((F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb"))).select("a", "b")
    rest = rest.distinct().join(stars, ["a", "b"], "left_anti")
    links = links.unionByName(confirmed(rest, nodes, docs, key, text))
    if not crowded.isEmpty():
        links = saved(links, "links")
        links = links.unionByName(crowded_links(crowded, components(links), nodes, docs, key, text))
    roots = components(links).withColumnRenamed("root", "group")
    grouped = nodes.join(roots, "node", "left").withColumn("group", F.coalesce("group", "node"))
    names = grouped.groupBy("group").agg(F.min("first_key").alias("component_id"))
    labels = grouped.select("node", "group").join(names, "group").select("node", "component_id")
    out = rows.select("key", "n_shingles", "node").join(labels, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("key")).otherwise(F.col("component_id"))
    return out.select(F.col("key").alias(key), "n_shingles", component.alias("component_id"),
                      F.col("key").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps: one id of each component."""
    kept = near_duplicates(docs, key, text).where("kept").select(F.col(key).alias("_kept")).distinct()
    return docs.join(kept, F.col(key).cast("bigint").eqNullSafe(F.col("_kept")), "left_semi")


def keep_one_row(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Exactly one row of ``docs`` for each component, also where rows repeat an id or have none: the one
    with the smallest id, then the smallest hash of its text. Rows without shingles all stay.

    Where ids are unique, only ids travel besides what is compared. Else the rows are numbered in a copy of the table, as nothing else
    tells them apart. No column of ``docs`` is touched, whatever its name; an empty table stays empty.
    """
    number = F.col(key).cast("bigint")
    if docs.select(number.alias("id")).groupBy("id").count().where("id is null or count > 1").isEmpty():
        dropped = near_duplicates(docs, key, text).where("not kept").select(F.col(key).alias("dropped"))
        return rejoined(apart(docs, id=number).join(dropped, F.col("id") == F.col("dropped"), "left_anti"), docs)
    numbered = saved(apart(docs, number=F.monotonically_increasing_id(), id=number, text=F.col(text)), "numbered")
    place = F.struct(F.col("id").isNull().alias("unnamed"), F.col("id"), F.xxhash64("text").alias("digest"), F.col("number").alias("own"))
    least = near_duplicates(numbered, "number", "text").select("number", "component_id").join(numbered.select("number", place.alias("place")), "number")
    kept = least.groupBy("component_id").agg(F.min("place").alias("place")).select(F.col("place.own").alias("number"))
    return rejoined(numbered.join(kept, "number", "left_semi"), docs)


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op7_near_dedup": op7_near_dedup}
ORACLE = {"op7_near_dedup": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM d),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS n_both
  FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM shared WHERE 100 * n_both >= 75 * (na + nb - n_both)
  UNION SELECT b, a FROM shared WHERE 100 * n_both >= 75 * (na + nb - n_both)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
roots AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, r.component_id, s.doc_id = r.component_id AS kept
FROM s JOIN roots r ON r.a = s.doc_id
"""}
