"""A Merkle manifest of a table: a tree of digests per group, one root over all, and a proof for every row.

Time-forward processing: nodes are labelled (level, place), a parent after its children. Forward, every
node sends its digest to its parent through a priority queue ordered by label, so a parent finds its
children's digests at the head of the queue when its turn comes. Backward, every node sends its children
what leads from it to the root. The queue of the whole table is Spark's sorted exchange: places run along
ranges of the sorted rows, messages to labels of one block of 3^HEIGHT leaves meet in one task, which
keeps its own queue for the labels in between and sends only the block's root on to the next round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from .common import saved, table

ARITY = 3
HEIGHT = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
# A path has, for every level, the digests left of the node, MARK, those right of it, and END.
MARK, END = "*", "/"


def framed(fields: Sequence[Column]) -> Column:
    """The fields one after another, each as its number of UTF-8 bytes, a colon and its value, or ``-`` if null."""
    text = [f.cast("string") for f in fields]
    return F.concat(*[F.coalesce(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f), F.lit("-")) for f in text])


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def height(n: int) -> int:
    """Levels above the leaves of a tree of ``n`` leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def _hash(digests: Sequence[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def sweep_up(leaves: Sequence[str], levels: int) -> tuple[str, list[tuple[tuple[int, int], list[str]]]]:
    """The root of a block after ``levels`` levels, and the nodes above its leaves in the order of their
    labels, each with its children's digests as the queue delivered them."""
    if not levels:
        return leaves[0], []
    queue = [((1, i // ARITY), i % ARITY, d) for i, d in enumerate(leaves)]  # in order, so a heap
    nodes, root = [], ""
    while queue:
        label, children = queue[0][0], []
        while queue and queue[0][0] == label:
            children.append(heappop(queue)[2])
        nodes.append((label, children))
        root = _hash(children)
        level, place = label
        if level < levels:
            heappush(queue, ((level + 1, place // ARITY), place % ARITY, root))
    return root, nodes


def sweep_down(leaves: Sequence[str], levels: int, above: str) -> list[str]:
    """The path of every leaf of a block to the top, given the path ``above`` of the block's root."""
    paths = {(levels, 0): above}
    for (level, place), children in reversed(sweep_up(leaves, levels)[1]):
        suffix = paths.pop((level, place))
        for c in range(len(children)):
            step = "".join(children[:c]) + MARK + "".join(children[c + 1:]) + END
            paths[level - 1, place * ARITY + c] = step + suffix
    return [paths[0, i] for i in range(len(leaves))]


def folded(leaf: str, path: str) -> str:
    """The root that follows from a leaf's digest and its path."""
    for step in path.split(END)[:-1]:
        left, right = step.split(MARK)
        leaf = _hash((left, leaf, right))
    return leaf


def placed(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``at``, their place from 0 within their ``tree`` by ``order`` (total), and ``n``, its size.

    Rows are range-partitioned, so a large tree spreads over many tasks; each task numbers its own
    rows, and a tree's earlier tasks, at most as many as partitions, give the number to start from.
    """
    names = rows.columns
    schema = T.StructType([*rows.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("within", T.LongType())])

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, held = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not len(batch):
                continue
            tree = batch["tree"].dictionary_encode().indices.to_numpy()
            first = np.flatnonzero(np.append(True, tree[1:] != tree[:-1]))
            sizes = np.diff(np.append(first, len(tree)))
            within = np.arange(len(tree)) - np.repeat(first, sizes)
            if batch["tree"][0].as_py() == last:
                within[:sizes[0]] += held
            last, held = batch["tree"][len(tree) - 1].as_py(), int(within[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(tree), part, dtype=np.int32)), pa.array(within)],
                                             names=[*names, "part", "within"])

    sliced = saved(rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).mapInArrow(numbered, schema), "placed")
    sizes = sliced.groupBy("tree", "part").agg(F.count("*").alias("size"))
    earlier = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("tree", "part", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("start"),
                          F.sum("size").over(Window.partitionBy("tree")).alias("n"))
    return sliced.join(starts, ["tree", "part"]).select(*names, (F.col("start") + F.col("within")).alias("at"), "n")


def blocks_of(rows: DataFrame) -> DataFrame:
    """One row per block of 3^HEIGHT neighbouring nodes (tree, at, n, digest and ``carried``): tree, block, n, the number
    of levels, the digests and the carried bytes of its nodes in order, its root, and whether that is the tree's."""
    width = ARITY ** HEIGHT

    def packed(group: pa.Table) -> pa.Table:
        group = group.sort_by("at")
        n = group["n"][0].as_py()
        levels = height(n) if n <= width else HEIGHT
        raw = group["digest"].to_pylist()
        root = bytes.fromhex(sweep_up([d.hex() for d in raw], levels)[0])
        return pa.table({"tree": group["tree"][:1], "block": pa.array([group["at"][0].as_py() // width], pa.int64()), "n": pa.array([n], pa.int64()),
                         "levels": pa.array([levels], pa.int32()), "digests": pa.array([b"".join(raw)], pa.binary()),
                         "carried": pa.array([group["carried"].to_pylist()], pa.list_(pa.binary())), "root": pa.array([root], pa.binary()),
                         "top": pa.array([n <= width])})

    rows = rows.select("tree", "at", "n", "digest", "carried", F.floor(F.col("at") / width).alias("block"))
    schema = "tree string, block bigint, n bigint, levels int, digests binary, carried array<binary>, root binary, top boolean"
    return saved(rows.groupBy("tree", "block").applyInArrow(packed, schema), "blocks")


def grown(rows: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The tables of blocks, round by round from the leaves up, and the root (tree, root) of every tree."""
    width, rounds, tops = ARITY ** HEIGHT, [], None
    while True:
        found = blocks_of(rows)
        rounds.append(found)
        ended = found.where("top").select("tree", "root")
        tops = ended if tops is None else tops.unionByName(ended)
        if found.where("not top").isEmpty():
            return rounds, tops
        rows = found.where("not top").select("tree", F.col("block").alias("at"), F.ceil(F.col("n") / width).alias("n"),
                                             F.col("root").alias("digest"), F.lit(None).cast("binary").alias("carried"))


def led_down(rounds: Sequence[DataFrame], above: DataFrame) -> DataFrame:
    """Columns tree, at, digest, carried, path, subroot of all leaves: the reversed sweep from the paths ``above``
    (tree, path, subroot) of the trees' roots."""
    width, given = ARITY ** HEIGHT, None

    def delivered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                tree, block, levels, path, top = (batch[c][i].as_py() for c in ("tree", "block", "levels", "path", "subroot"))
                raw = batch["digests"][i].as_py()
                raw = [raw[j:j + 32] for j in range(0, len(raw), 32)]
                found = sweep_down([d.hex() for d in raw], levels, path)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([tree] * len(raw), pa.string()), pa.array(range(block * width, block * width + len(raw)), pa.int64()),
                     pa.array(raw, pa.binary()), batch["carried"][i].values, pa.array(found, pa.string()), pa.array([top] * len(raw), pa.string())],
                    names=["tree", "at", "digest", "carried", "path", "subroot"])

    for found in reversed(rounds):
        blocks = found.select("tree", "block", "levels", "digests", "carried", "top")
        paths = blocks.where("top").join(above, "tree")
        if given is not None:
            sent = given.select("tree", F.col("at").alias("block"), "path", "subroot")
            paths = paths.unionByName(blocks.where("not top").join(sent, ["tree", "block"]))
        out = paths.drop("top").mapInArrow(delivered, "tree string, at bigint, digest binary, carried binary, path string, subroot string")
        given = out if found is rounds[0] else saved(out, "paths")
    return given


def manifest(docs: DataFrame, key: str = "doc_id", group: str = "source", fields: Sequence[str] = FIELDS,
             altered: Mapping[str, Column] | None = None) -> DataFrame:
    """Columns key, leaf, subroot, root, path, folded_root, verified of every row; digests are lower-case hex.

    A leaf is the digest of the row's ``fields`` in that order (``framed``). The leaves of a group ascend by key, then by
    digest; every three neighbours, the last fewer, have their digest as parent, until one remains, the group's subroot (a
    lone leaf is its own). The subroots in byte order of the groups give the root in the same way. ``path`` lists, level by
    level, the siblings left and right of the way to the root. ``altered`` replaces columns by what a reader found in their
    place: ``folded_root`` is computed from the leaf of these values along the path of the original, and ``verified`` says
    whether it is the root.

    Null keys come first and null groups form a group of their own, before all others; null fields differ from empty ones.
    Rows that repeat a key or are equal in all fields are leaves of their own and have places next to each other.
    Texts leave no task, whatever their length: only digests do. An empty table has no rows and no root. Further columns, whatever their
    names, are not read unless they are among ``fields``.
    """
    leaf = digest(framed([F.col(f) for f in fields]))
    other = digest(framed([(altered or {}).get(f, F.col(f)) for f in fields]))
    tree = F.when(F.col(group).isNull(), "-").otherwise(F.concat(F.lit(":"), F.col(group).cast("string")))
    # The digest, the altered row's digest and the key's text travel; the row number only parts equal rows.
    leaves = saved(docs.select(
        tree.alias("tree"), F.col(key).alias("key"), leaf.alias("digest"),
        F.concat(other, F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")).alias("carried"),
        F.monotonically_increasing_id().alias("row")), "leaves")
    lower = placed(leaves, ["key", "digest", "row"])
    rounds, subroots = grown(lower)
    subroots = saved(subroots, "subroots")
    upper = placed(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("group"), F.col("root").alias("digest")), ["group"])
    upper = upper.withColumn("carried", F.col("group").cast("binary"))
    upper_rounds, root = grown(upper)
    top = root.select(F.lower(F.hex("root"))).first()
    to_root = led_down(upper_rounds, root.select("tree", F.lit("").alias("path"), F.lit("").alias("subroot")))
    ways = saved(to_root.select(F.col("carried").cast("string").alias("tree"), "path", F.lower(F.hex("digest")).alias("subroot")), "ways")

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            carried = batch["carried"].to_pylist()
            found = [folded(c[:32].hex(), path) for c, path in zip(carried, batch["path"].to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([c[32:].decode() or None for c in carried], pa.string()),
                 pa.array([d.hex() for d in batch["digest"].to_pylist()], pa.string()), batch["subroot"], batch["path"], pa.array(found, pa.string())],
                names=["key", "leaf", "subroot", "path", "folded_root"])

    rows = led_down(rounds, ways).mapInArrow(checked, "key string, leaf string, subroot string, path string, folded_root string")
    return rows.select(F.col("key").cast(docs.schema[key].dataType).alias(key), "leaf", "subroot",
                       F.lit(top[0] if top else None).cast("string").alias("root"), "path", "folded_root",
                       (F.col("folded_root") == F.lit(top[0] if top else None)).alias("verified"))


def proof(path: Column) -> Column:
    """The siblings on a path, from the leaf's to the root's level, left to right."""
    return F.translate(path, MARK + END, "")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    altered = {"text": F.when(tampered, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))}
    found = manifest(table(spark, sf_dir, "documents"), altered=altered)
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(proof(F.col("path")).cast("binary"), 256).alias("proof_sha256"),
                        "folded_root", "verified")


QUERIES = {"op12_merkle_manifest": op12_merkle_manifest}
ORACLE = {"op12_merkle_manifest": r"""
WITH RECURSIVE
docs AS (SELECT doc_id, source, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head, text,
  -- The lowest bit of the CRC-32, byte by byte and bit by bit.
  xor(list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], range(8)), lambda x, step: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) & 1 AS odd
  FROM documents),
leaves AS (SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
  sha256(head || coalesce(strlen(CASE WHEN odd = 0 THEN replace(text, chr(10), '') ELSE text END) || ':'
    || CASE WHEN odd = 0 THEN replace(text, chr(10), '') ELSE text END, '-')) AS found,
  row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM docs),
lower_nodes AS (SELECT source, 0 AS level, i, n, leaf AS digest FROM leaves
  UNION ALL SELECT source, level + 1, i // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY i)) FROM lower_nodes WHERE n > 1
  GROUP BY source, level, i // 3, n),
subroots AS (SELECT source, digest, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM lower_nodes WHERE n = 1),
upper_nodes AS (SELECT 0 AS level, i, n, digest FROM subroots
  UNION ALL SELECT level + 1, i // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY i)) FROM upper_nodes WHERE n > 1 GROUP BY level, i // 3, n),
lower_steps AS (SELECT a.source, a.level, a.i, coalesce(string_agg(b.digest, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l,
  coalesce(string_agg(b.digest, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r FROM lower_nodes a JOIN lower_nodes b
  ON a.source IS NOT DISTINCT FROM b.source AND a.level = b.level AND a.i // 3 = b.i // 3 WHERE a.n > 1 GROUP BY ALL),
upper_steps AS (SELECT a.level, a.i, coalesce(string_agg(b.digest, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l,
  coalesce(string_agg(b.digest, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r FROM upper_nodes a JOIN upper_nodes b
  ON a.level = b.level AND a.i // 3 = b.i // 3 WHERE a.n > 1 GROUP BY ALL),
lower_way AS (SELECT doc_id, source, leaf, 0 AS level, i, n, found AS now, '' AS proof FROM leaves
  UNION ALL SELECT doc_id, w.source, leaf, w.level + 1, w.i // 3, (n + 2) // 3, sha256(l || now || r), proof || l || r
  FROM lower_way w JOIN lower_steps s ON w.source IS NOT DISTINCT FROM s.source AND w.level = s.level AND w.i = s.i),
upper_way AS (SELECT doc_id, leaf, s.digest AS subroot, 0 AS level, s.i, s.n, now, proof
  FROM lower_way w JOIN subroots s ON w.source IS NOT DISTINCT FROM s.source WHERE w.n = 1
  UNION ALL SELECT doc_id, leaf, subroot, w.level + 1, w.i // 3, (n + 2) // 3, sha256(l || now || r), proof || l || r
  FROM upper_way w JOIN upper_steps s ON w.level = s.level AND w.i = s.i)
SELECT doc_id, leaf, subroot, u.digest AS root, sha256(proof) AS proof_sha256, now AS folded_root, now = u.digest AS verified
FROM upper_way w JOIN upper_nodes u ON w.n = 1 AND u.n = 1
"""}
