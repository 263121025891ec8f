"""Token counts of a byte-level pair vocabulary, by merges on ragged numpy arrays of pre-tokens."""

from __future__ import annotations

import json
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F
from tokenizers import Tokenizer

from .common import table

LIMIT = 1024
# How byte-level pre-tokenizers divide a text (a fixed value of such files).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Blocks of characters whose classes are the same in every Unicode version in use; texts with others are divided by the tokenizer.
UNSETTLED = regex.compile("[^\x00-ͷЀ-ԧ‐-‧‰-⁞₠-₹←-⏿ぁ-ゖァ-ヿ一-龥가-힣]")
CACHED_PIECES = 400_000
SLICE_CHARS = 1 << 22
# Longer pre-tokens are merged one by one, from a queue of ranks, so their time grows with their length only.
LONG = 1024
NONE = np.int32(np.iinfo(np.int32).max)


class Merges:
    """The merges of a byte-level pair model. Symbols are the 256 bytes, the same at the end of a word if the model marks
    these, and then the products in order of rank; ``ids`` has the vocabulary's id of each."""

    def __init__(self, model: dict):
        if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
            raise ValueError("not a plain pair vocabulary")
        marks, suffix = byte_marks(), model.get("end_of_word_suffix") or ""
        self.ends = 256 if suffix else 0
        symbol = {mark: byte for byte, mark in marks.items()} | ({mark + suffix: 256 + byte for byte, mark in marks.items()} if suffix else {})
        self.first = len(symbol)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.empty(len(pairs), dtype=np.int64)
        self.width = self.first + len(pairs)
        for rank, (a, b) in enumerate(pairs):
            # A merge uses symbols that exist by then, and makes a new one: so ranks only grow while a sequence is merged.
            if a not in symbol or b not in symbol or a + b in symbol:
                raise ValueError(f"the merge of {a!r} and {b!r} is out of order")
            keys[rank] = symbol[a] * self.width + symbol[b]
            symbol[a + b] = self.first + rank
        if any(token not in model["vocab"] for token in symbol):
            raise ValueError("the vocabulary lacks a symbol")
        self.ids = np.empty(self.width, dtype=np.int64)
        for token, number in symbol.items():
            self.ids[number] = model["vocab"][token]
        self.order = np.argsort(keys).astype(np.int32)
        self.keys = keys[self.order]
        both = np.arange(self.first)
        self.pairs = self._look_up((both[:, None] * self.width + both[None, :]).ravel()).reshape(self.first, self.first)
        self.by_pair = None

    def _look_up(self, key: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], NONE) if len(self.keys) else np.full(len(key), NONE)

    def counts(self, words: list[bytes]) -> np.ndarray:
        """The number of symbols that each word is left with."""
        return self.merged(words)[0]

    def merged(self, words: list[bytes], keep: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The number of symbols that each word is left with, and if ``keep`` these symbols, word by word.

        All words lie one after another in one array. A round finds every word's lowest rank among
        its adjacent pairs, merges all places of that pair in all words at once, and looks up anew
        only the pairs beside the merged places. Words without a pair left drop out.
        """
        out = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ended = [(np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int32))]
        short = np.flatnonzero((out > 0) & (out <= LONG))
        for i in np.flatnonzero(out > LONG):
            left = self.merge_long(words[i])
            out[i] = len(left)
            ended.append((np.full(len(left), i, dtype=np.int32), np.array(left, dtype=np.int32)))
        owner = np.repeat(short.astype(np.int32), out[short])
        symbols = np.frombuffer(b"".join([words[i] for i in short.tolist()]), dtype=np.uint8).astype(np.int32)
        if self.ends:
            symbols[np.cumsum(out[short]) - 1] += self.ends
        rank = np.full(len(symbols), NONE, dtype=np.int32)
        if len(symbols) > 1:
            rank[:-1] = self.pairs[symbols[:-1], symbols[1:]]
            rank[:-1][owner[:-1] != owner[1:]] = NONE
        while len(symbols):
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            least = np.minimum.reduceat(rank, starts)
            lowest = np.repeat(least, np.diff(np.append(starts, len(owner))))
            going = lowest != NONE
            if keep:
                done = np.flatnonzero(~going)
                ended.append((owner[done], symbols[done]))
            at = np.flatnonzero((rank == lowest) & going)
            if not len(at):
                break
            # Where places of a pair overlap (a a a), every second one is merged, from the left.
            run = np.append(True, np.diff(at) != 1)
            first = np.flatnonzero(run)
            at = at[(np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))) % 2 == 0]
            symbols[at] = self.first + rank[at]
            out -= np.bincount(owner[at], minlength=len(out))
            going[at + 1] = False
            changed = np.zeros(len(symbols), dtype=bool)
            changed[at] = True
            left = np.flatnonzero(going)
            symbols, owner, rank, changed = symbols[left], owner[left], rank[left], changed[left]
            changed[:-1] |= changed[1:]
            look = np.flatnonzero(changed)
            inside = look[(look + 1 < len(owner))]
            inside = inside[owner[inside] == owner[inside + 1]]
            rank[look] = NONE
            rank[inside] = self._look_up(symbols[inside].astype(np.int64) * self.width + symbols[inside + 1])
        owner, symbols = (np.concatenate(side) for side in zip(*ended))
        return out, symbols[np.argsort(owner, kind="stable")]

    def merge_long(self, word: bytes) -> list[int]:
        """The same for one long word: ranks come from a queue, each with all places of its pair."""
        if self.by_pair is None:
            self.by_pair = dict(zip(self.keys.tolist(), self.order.tolist()))
        rank_of, width = self.by_pair.get, self.width
        symbols, n = list(word), len(word)
        symbols[-1] += self.ends
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        places: dict[int, list[int]] = {}
        queue: list[int] = []

        def offer(i: int) -> None:
            j = after[i]
            rank = rank_of(symbols[i] * width + symbols[j]) if j >= 0 else None
            if rank is not None:
                if rank not in places:
                    places[rank] = []
                    heappush(queue, rank)
                places[rank].append(i)

        for i in range(n):
            offer(i)
        while queue:
            rank = heappop(queue)
            for i in sorted(places.pop(rank)):
                j = after[i]
                if symbols[i] < 0 or j < 0 or rank_of(symbols[i] * width + symbols[j]) != rank:
                    continue
                symbols[i], symbols[j], after[i] = self.first + rank, -1, after[j]
                if after[j] >= 0:
                    before[after[j]] = i
                offer(i)
                if before[i] >= 0:
                    offer(before[i])
        return [s for s in symbols if s >= 0]


def byte_marks() -> dict[int, str]:
    """Byte-level vocabularies write a byte as itself where it is printable, the others as characters from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class Counter:
    """Tokens of texts; the counts of distinct pre-tokens are remembered, up to CACHED_PIECES of them."""

    def __init__(self, content: str):
        file = json.loads(content)
        splitter, added = file["pre_tokenizer"] or {}, file["added_tokens"]
        if file["normalizer"] or splitter.get("type") != "ByteLevel" or splitter.get("add_prefix_space") or not splitter.get("use_regex", True) \
                or file["model"].get("end_of_word_suffix"):
            raise ValueError("not a byte-level pair vocabulary with its usual division of texts")
        if any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that look at their surroundings are not supported")
        self.merges, self.known = Merges(file["model"]), {}
        self.pieces = regex.compile(PIECES).findall
        self.own = Tokenizer.from_str(content)
        # Where added tokens begin at one place, the library takes the longest.
        special = sorted((t["content"] for t in added), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None

    def divided(self, text: str) -> list[str]:
        if UNSETTLED.search(text):
            return [text[a:b] for _, (a, b) in self.own.pre_tokenizer.pre_tokenize_str(text)]
        return self.pieces(text)

    def counts(self, texts: list[str]) -> list[int]:
        listed, extra = [], []
        for text in texts:
            found = len(self.special.findall(text)) if self.special else 0
            extra.append(found)
            listed.append([p for part in self.special.split(text) for p in self.divided(part)] if found else self.divided(text))
        new = list(set().union(*listed) - self.known.keys())
        if len(self.known) + len(new) > CACHED_PIECES:
            self.known.clear()
            new = list(set().union(*listed))
        self.known.update(zip(new, self.merges.counts([w.encode() for w in new]).tolist()))
        return [n + sum(map(self.known.__getitem__, pieces)) for n, pieces in zip(extra, listed)]


def token_counts(docs: DataFrame, tokenizer_file: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """Columns key, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit`` tokens) of every whole text.

    ``tokenizer_file`` is a byte-level pair vocabulary of the tokenizers library; other kinds raise.
    Added tokens count one wherever their strings stand. Nothing is shuffled: each task divides its
    texts, merges the distinct pre-tokens of some megabytes at a time, and adds up. A null text counts as empty, with no
    bytes and tokens. Repeated rows and null ids get a row each, ties cannot arise, an empty table gives an empty one, and
    further columns of ``docs``, whatever their names, are not read.
    """
    with open(tokenizer_file, encoding="utf-8") as file:
        content = docs.sparkSession.sparkContext.broadcast(file.read())
    Counter(content.value)  # refuses files of other kinds before any task starts

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(content.value)
        for batch in batches:
            bodies, tokens, held, size = batch.column(1), [], [], 0
            for body in bodies:
                held.append(body.as_py())
                size += len(held[-1])
                if size >= SLICE_CHARS:
                    tokens += counter.counts(held)
                    held, size = [], 0
            if held:
                tokens += counter.counts(held)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pc.binary_length(bodies).cast(pa.int64()), pa.array(tokens, pa.int64())],
                names=["key", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = rows.mapInArrow(counted, "key bigint, n_bytes bigint, n_tokens bigint")
    return found.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op13_token_counts": op13_token_counts}
ORACLE: dict[str, str] = {}
