"""Token ids of texts in wavelet-matrix shards, written in the order of the ids and read back."""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from tokenizers import Tokenizer

from cohortlens.session import work_folder

from .common import ROW_GROUP_BYTES, step, table
from .token_counts import Merges
from .wavelet import WaveletMatrix, build

END_ID = 2
SHARD_TOKENS = 1 << 20
# A partition's recurring chunks are encoded once, so large partitions encode fewer.
PARTITION_BYTES = 1 << 26
# Chunks that an encoder remembers, some 200 bytes each.
CACHED_CHUNKS = 250_000
# Bytes of text encoded together.
SLICE_BYTES = 1 << 22
# Rows are whole shards, so pages and row groups are looked at after each row; by default the first look is after a hundred.
SHARD_OPTIONS = {"parquet.block.size": ROW_GROUP_BYTES, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}
# Characters that the normaliser below only lower-cases, one by one.
BEYOND_PLAIN = regex.compile(r"[^\s\x21-\x7EÀ-ÖØ-öø-įĲ-ňŊ-ž]")
# The steps before the merges that make a chunk between white space independent of what stands around it (fixed values of such files).
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLITTERS = {"type": "Split", "behavior": "Removed", "invert": True}
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# These separate words for other libraries but not for the tokenizer.
SEPARATORS = "\x1c\x1d\x1e\x1f"


def _ragged(data: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The stretches of ``data`` from ``starts``, of ``counts`` numbers each, one after another."""
    before = np.cumsum(counts) - counts
    return data[np.repeat(starts - before, counts) + np.arange(int(counts.sum()))]


def _listed(values: pa.Array) -> list:
    """The same as ``to_pylist`` for strings, faster."""
    return values.to_numpy(zero_copy_only=False).tolist()


class Encoder:
    """Ids of texts, many at a time.

    If the tokenizer's file has the normalisers and the splitter above, it treats every chunk between white space alone. Then texts of
    plain characters are divided into chunks, the distinct ones that are new are merged together, and their ids, kept in one array, are
    gathered for all places. The other texts, and all texts for other files, go to the tokenizer whole.
    """

    def __init__(self, content: str):
        # The library's tokenizer is made when the first text needs it.
        self.content, self.tokenizer, file = content, None, json.loads(content)
        normalizer, splitter = file["normalizer"] or {}, file["pre_tokenizer"] or {}
        steps = splitter.get("pretokenizers") or [{}]
        self.by_chunk = normalizer.get("normalizers") == NORMALIZERS and len(steps) == 2 \
            and steps[0] == SPLITTERS | {"pattern": {"Regex": PIECES}} and steps[1].get("type") == "ByteLevel" \
            and not steps[1].get("add_prefix_space") and not steps[1].get("use_regex", True) \
            and not any(t[k] for t in file["added_tokens"] for k in ("single_word", "lstrip", "rstrip"))
        self.apart = [*SEPARATORS, *(t["content"] for t in file["added_tokens"])]
        if self.by_chunk:
            self.merges, self.pieces = Merges(file["model"]), regex.compile(PIECES).findall
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.starts, self.counts = np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def whole(self, text: str) -> np.ndarray:
        self.tokenizer = self.tokenizer or Tokenizer.from_str(self.content)
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def plain(self, text: str) -> bool:
        return self.by_chunk and (text.isascii() or not BEYOND_PLAIN.search(text)) and not any(s in text for s in self.apart)

    def learn(self, chunks: list[str], lasting: int) -> None:
        """Chunks of letters are one piece each, with one other character behind them two, the others as many as the splitter finds. Only the first ``lasting`` of them get
        into ``known``; the rest have their ids at the end of the arrays, until ``drop``."""
        listed = [[c] if c.isalpha() else [c[:-1], c[-1]] if c[:-1].isalpha() and c[-1].isascii() else self.pieces(c) for c in chunks]
        coded = pa.array(chain.from_iterable(listed), pa.string()).dictionary_encode()
        pieces = coded.indices.to_numpy()
        counts, symbols = self.merges.merged(_listed(coded.dictionary.cast(pa.binary())), keep=True)
        starts = np.cumsum(counts) - counts
        sizes = np.fromiter(map(len, listed), dtype=np.int64, count=len(listed))
        found = _ragged(self.merges.ids[symbols].astype(np.uint32), starts[pieces], counts[pieces])
        ends = np.append(0, np.cumsum(counts[pieces]))[np.append(0, np.cumsum(sizes))]
        self.known.update(zip(chunks[:lasting], range(len(self.known), len(self.known) + lasting)))
        self.starts = np.append(self.starts, ends[:-1] + len(self.ids))
        self.counts = np.append(self.counts, np.diff(ends))
        self.ids = np.append(self.ids, found)

    def drop(self) -> None:
        """The ids of chunks that are not in ``known`` go."""
        n = len(self.known)
        if n < len(self.starts):
            self.starts, self.counts, self.ids = self.starts[:n].copy(), self.counts[:n].copy(), self.ids[:self.starts[n]].copy()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and how many each has."""
        listed = texts.to_pylist()
        plain = np.fromiter(map(self.plain, listed), dtype=bool, count=len(listed))
        counts = np.zeros(len(listed), dtype=np.int64)
        odd = {i: self.whole(listed[i]) for i in np.flatnonzero(~plain).tolist()}
        for i, found in odd.items():
            counts[i] = len(found)
        # Case makes no difference, so fewer chunks are distinct without it.
        chunks = pc.utf8_split_whitespace(pc.utf8_lower(texts.filter(pa.array(plain))))
        ends = chunks.offsets.to_numpy()
        coded = chunks.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
        distinct, places = _listed(coded.dictionary), coded.indices.to_numpy()
        often = np.bincount(places, minlength=len(distinct)) > 1
        # Each chunk is looked up once; new ones get the numbers that follow. Those that stand here once are not remembered: most never come again.
        numbers = np.fromiter(map(self.known.get, distinct, repeat(-1)), dtype=np.int64, count=len(distinct))
        new = np.flatnonzero(numbers < 0)
        if len(self.known) + np.count_nonzero(often[new]) > CACHED_CHUNKS:
            self.forget()
            new = np.arange(len(distinct))
        if len(new):
            new = np.concatenate([new[often[new]], new[~often[new]]])
            numbers[new] = np.arange(len(self.known), len(self.known) + len(new))
            self.learn([distinct[i] for i in new.tolist()], np.count_nonzero(often[new]))
        at = numbers[places]
        sizes = self.counts[at] if len(at) else np.zeros(0, dtype=np.int64)
        sums = np.append(0, np.cumsum(sizes))[ends - ends[0]]
        counts[plain] = np.diff(sums)
        data = _ragged(self.ids, self.starts[at], sizes) if len(at) else np.zeros(0, dtype=np.uint32)
        self.drop()
        if not odd:
            return data, counts
        row = np.cumsum(plain) - 1
        return np.concatenate([odd[i] if i in odd else data[sums[row[i]]:sums[row[i] + 1]] for i in range(len(listed))]), counts


def write_shards(docs: DataFrame, tokenizer_file: str, path: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID) -> None:
    """Encode every whole text, append ``end_id``, and write shards in ascending order of (key, text) to ``path``.

    Rows are range-partitioned; a partition writes its shards one by one, each of about SHARD_TOKENS
    (a longer text has a shard of its own), so memory does not grow with the data. A null text is
    empty; null keys come first; repeated keys are kept.
    """
    with open(tokenizer_file, encoding="utf-8") as file:
        content = docs.sparkSession.sparkContext.broadcast(file.read())
    bits = max(1, int(max(Tokenizer.from_file(tokenizer_file).get_vocab_size() - 1, end_id)).bit_length())
    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // PARTITION_BYTES))
    placed = rows.repartitionByRange(parts, "key").sortWithinPartitions("key", "text")

    def sharded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(content.value)
        part, number = TaskContext.get().partitionId(), 0
        narrow = np.uint16 if bits <= 16 else np.uint32

        def encoded(batch: pa.RecordBatch) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
            """Some megabytes of the batch at a time: keys, ids with the end id after each text, and counts."""
            ends = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False), dtype=np.int64)
            a = 0
            while a < len(batch):
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + SLICE_BYTES, side="right")))
                ids, counts = encoder.encode(batch.column(1).slice(a, b - a))
                yield batch.column(0).slice(a, b - a).to_pylist(), np.insert(ids, np.cumsum(counts), end_id).astype(narrow), counts + 1
                a = b

        def shard(keys: list, counts: list, data: list) -> pa.RecordBatch:
            ids = np.concatenate(data)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([len(ids)], pa.int64()),
                 pa.array([build(ids, bits, keys, counts)], pa.binary())], names=["part", "number", "n_tokens", "file"])

        keys, counts, data, held = [], [], [], 0
        for batch in batches:
            for found, ids, sizes in encoded(batch):
                at = taken = 0
                for k, n in zip(found, sizes.tolist()):
                    if held and held + n > SHARD_TOKENS:
                        yield shard(keys, counts, [*data, ids[taken:at]])
                        keys, counts, data, held, number, taken = [], [], [], 0, number + 1, at
                    keys.append(k)
                    counts.append(n)
                    held, at = held + n, at + n
                data.append(ids[taken:at])
        if held:
            yield shard(keys, counts, data)

    with step(docs.sparkSession):
        placed.mapInArrow(sharded, "part int, number int, n_tokens bigint, file binary").write.options(**SHARD_OPTIONS).parquet(path)


def read_texts(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """Columns key, start, n_tokens, ids_crc32 of every text, decoded from the shards at ``path``."""
    files = spark.read.parquet(path)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, number, data in zip(batch.column(0), batch.column(1), batch.column(2)):
                matrix = WaveletMatrix(data.as_py())
                ids, ends = matrix.tokens().astype("<u4", copy=False), np.cumsum(matrix.counts)
                starts = ends - matrix.counts
                sums = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends)]
                n = len(sums)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.as_py()] * n, pa.int32()), pa.array([number.as_py()] * n, pa.int32()), pa.array(matrix.keys, pa.int64()),
                     pa.array(starts, pa.int64()), pa.array(matrix.counts, pa.int64()), pa.array(sums, pa.int64())],
                    names=["part", "number", "key", "inside", "n_tokens", "ids_crc32"])

    rows = files.select("part", "number", "file").mapInArrow(
        decoded, "part int, number int, key bigint, inside bigint, n_tokens bigint, ids_crc32 bigint")
    # Three levels: the totals of a thousand partitions, of a partition, then the shards within it.
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    sizes = files.select("part", "number", "n_tokens")
    totals = sizes.groupBy("part").agg(F.sum("n_tokens").alias("all")).withColumn("run", F.floor(F.col("part") / 1000))
    runs = totals.groupBy("run").agg(F.sum("all").alias("all")).withColumn("one", F.lit(0))
    runs = runs.select("run", F.coalesce(F.sum("all").over(before("one", "run")), F.lit(0)).alias("before"))
    inside = F.coalesce(F.sum("all").over(before("run", "part")), F.lit(0))
    totals = totals.select("part", "run", inside.alias("inside")).join(runs, "run").select("part", (F.col("before") + F.col("inside")).alias("base"))
    starts = sizes.join(totals, "part").select(
        "part", "number", (F.col("base") + F.coalesce(F.sum("n_tokens").over(before("part", "number")), F.lit(0))).alias("from"))
    return rows.join(starts, ["part", "number"]).select(
        F.col("key").alias(key), (F.col("from") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def op6_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{work_folder(spark)}/token-shards-{uuid.uuid4().hex}"
    write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), path)
    return read_texts(spark, path)


QUERIES = {"op6_wavelet_tokens": op6_wavelet_tokens}
ORACLE: dict[str, str] = {}
