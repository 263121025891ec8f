"""Near-duplicate vectors: binary codes of randomly rotated vectors, with stored correction factors, decide
which pairs need their exact cosine."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import saved, table
from .graph import components
from .vector_tables import matrix, packed

COSINE = 0.9
MISS = 1e-3
BUCKET_ROWS = 512
BLOCK_ROWS = 1024
DEVIATIONS = 3.0
SEED = 5


def rotation(width: int, number: int) -> np.ndarray:
    """A random orthogonal matrix, always the same for (width, number)."""
    q, r = np.linalg.qr(np.random.default_rng((SEED, width, number)).standard_normal((width, width)))
    return q * np.sign(np.diag(r))


def tables_for(rows: int, cosine: float = COSINE, miss: float = MISS, bucket_rows: int = BUCKET_ROWS) -> tuple[int, int]:
    """(bits of a bucket, number of tables), so that buckets hold about ``bucket_rows`` and a pair at
    the threshold shares no bucket with a probability of ``miss``."""
    bits = min(28, max(2, math.ceil(math.log2(max(1.0, rows / bucket_rows)))))
    together = (1 - math.acos(min(1.0, cosine)) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log(1 - together)))


def codes(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sign bits of the rotated unit vectors, packed, and the correction factor of each: its inner product
    with the unit vector that its code stands for."""
    turned = vectors @ rotation(vectors.shape[1], 0).T
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(axis=1) / math.sqrt(vectors.shape[1])


def bucket_keys(vectors: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """Bucket numbers [rows, tables]: ``bits`` signs of rotated vectors for each table."""
    width = vectors.shape[1]
    count = math.ceil(bits * tables / width)
    signs = np.concatenate([vectors @ rotation(width, 1 + i).T > 0 for i in range(count)], axis=1)[:, :bits * tables]
    return signs.reshape(len(vectors), tables, bits).astype(np.int64) @ (1 << np.arange(bits, dtype=np.int64))


def linked_pairs(left: np.ndarray, right: np.ndarray, left_code: np.ndarray, left_factor: np.ndarray, same: bool,
                 cosine: float, deviations: float = DEVIATIONS) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs with an exact cosine of at least ``cosine``.

    The code's inner product with the rotated right vector, over the stored factor, estimates the
    cosine without bias; pairs whose upper confidence bound stays below the threshold are left out,
    all others are computed again from the vectors in double precision.
    """
    width = left.shape[1]
    signs = np.unpackbits(left_code, axis=1)[:, :width].astype(np.float64) * 2 - 1
    estimate = (signs / (math.sqrt(width) * left_factor[:, None])) @ (right @ rotation(width, 0).T).T
    error = deviations * np.sqrt(np.maximum(0.0, 1 - left_factor**2)) / left_factor / math.sqrt(max(1, width - 1))
    open_ = estimate + error[:, None] >= cosine - 1e-9
    if same:
        open_ = np.triu(open_, 1)
    i, j = np.nonzero(open_)
    near = np.empty(len(i), dtype=bool)
    for at in range(0, len(i), 1 << 16):
        part = slice(at, at + (1 << 16))
        near[part] = np.einsum("ij,ij->i", left[i[part]], right[j[part]]) >= cosine
    return i[near], j[near]


def _units(column: pa.Array) -> np.ndarray:
    v = matrix(column)
    # Scaled first, so that very large or small components neither overflow nor vanish.
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def near_vectors(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """Columns key, n_links, component_id, kept for every row.

    Equal vectors form one node first. Nodes meet in buckets of rotated signs, in as many tables as
    the number of nodes needs for a miss of MISS at the threshold; a crowded bucket is dealt to
    blocks and every two blocks meet in a task of their own. A task returns counts and a spanning
    forest of its links, never the pairs; a pair that shares buckets in several tables counts in
    the first. Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing, and vectors of different widths never link. Rows that repeat an id get a row each.
    """
    rows = saved(packed(vectors, key, column), "vectors")
    zero = F.regexp_replace(F.hex("vec"), "0", "") == ""
    nodes = saved(
        rows.where(F.col("vec").isNotNull() & ~zero).groupBy("vec").agg(F.min("key").alias("first_key"), F.count("*").alias("n")).withColumn(
            "node", F.monotonically_increasing_id()), "nodes")
    bits, tables = tables_for(nodes.count(), cosine)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = pc.binary_length(batch.column(2)).to_numpy()
            for width in np.unique(widths):
                part = batch.filter(pa.array(widths == width))
                unit = _units(part.column(2))
                code, factor = codes(unit)
                keys = bucket_keys(unit, bits, tables)
                listed = pa.ListArray.from_arrays(np.arange(len(part) + 1, dtype=np.int32) * tables, keys.ravel())
                own = keys.astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([u.tobytes() for u in unit], pa.binary()),
                     pa.array([c.tobytes() for c in code], pa.binary()), pa.array(factor), pa.array([k.tobytes() for k in own], pa.binary()),
                     listed], names=["node", "n", "unit", "code", "factor", "own", "keys"])

    placed = nodes.select("node", "n", "vec").mapInArrow(
        keyed, "node bigint, n bigint, unit binary, code binary, factor double, own binary, keys array<bigint>")
    placed = placed.select("node", "n", "unit", "code", "factor", "own", F.length("unit").alias("width"), F.posexplode("keys").alias("table", "bucket"))
    bucket = ["width", "table", "bucket"]
    sizes = placed.groupBy(*bucket).agg(F.count("*").alias("_size")).where("_size > 1").withColumn(
        "blocks", F.ceil(F.col("_size") / BLOCK_ROWS).cast("int"))
    split = placed.join(sizes, bucket).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    met = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        *bucket, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "n", "unit", "code", "factor", "own", "blocks")
    pair = [*bucket, "i", "j"]
    # Pairs of blocks are dealt on their own, as the grouping would be content with rows that lie together by bucket.
    dealt = [met.where("blocks = 1").drop("blocks"), met.where("blocks > 1").drop("blocks").repartition(*pair)]

    def compared(task: pa.Table) -> pa.Table:
        task = task.combine_chunks()
        col = {c: task.column(c).chunk(0) if task.column(c).num_chunks else task.column(c).combine_chunks() for c in task.column_names}
        node, weight = col["node"].to_numpy(), col["n"].to_numpy()
        unit, own, block = matrix(col["unit"]), matrix(col["own"], np.int32), col["block"].to_numpy()
        code, factor = matrix(col["code"], np.uint8), col["factor"].to_numpy()
        i, j, table_ = col["i"][0].as_py(), col["j"][0].as_py(), col["table"][0].as_py()
        a = np.flatnonzero(block == i)
        b = a if i == j else np.flatnonzero(block == j)
        p, q = linked_pairs(unit[a], unit[b], code[a], factor[a], i == j, cosine)
        p, q = a[p], b[q]
        root = np.arange(len(node))
        while True:  # smallest index within each linked group
            low = np.minimum(root[p], root[q])
            before = root.copy()
            np.minimum.at(root, p, low)
            np.minimum.at(root, q, low)
            root = root[root]
            if (root == before).all():
                break
        links = np.zeros(len(node), dtype=np.int64)
        new = ~(own[p, :table_] == own[q, :table_]).any(axis=1)
        np.add.at(links, p[new], weight[q[new]])
        np.add.at(links, q[new], weight[p[new]])
        some = np.flatnonzero((links > 0) | (root != np.arange(len(node))))
        return pa.table({"node": node[some], "links": links[some], "root": node[root[some]]})

    few, many = (part.groupBy(*pair).applyInArrow(compared, "node bigint, links bigint, root bigint") for part in dealt)
    found = saved(few.unionByName(many), "links")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    grouped = nodes.join(counts, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = grouped.groupBy("root").agg(F.min("first_key").alias("component_id"))
    labels = grouped.join(names, "root").select("vec", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    return rows.join(labels, "vec", "left").select(
        F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("component_id", "key").alias("component_id"), F.col("key").eqNullSafe(F.coalesce("component_id", "key")).alias("kept"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {"op9_embedding_dedup": op9_embedding_dedup}
ORACLE = {"op9_embedding_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
          WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
roots AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(c.n_links, 0) AS BIGINT) AS n_links, r.component_id, e.vec_id = r.component_id AS kept
FROM embeddings e JOIN roots r ON r.a = e.vec_id LEFT JOIN counts c ON c.a = e.vec_id
"""}
