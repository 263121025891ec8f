"""Ranked lexical search by NRA: impact-sorted lists are read in turn until every score that matters is known."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import saved, table

MOST_RESULTS = 20
# Texts of items that are searched for at once: their terms are broadcast, so more items are asked block by block.
BLOCK_BYTES = 1 << 23
SHARD_DOCS = 8192
SHARD_POSTINGS = 1 << 21
FIRST_READ = 64
# Items of more terms read their lists to the end in one go, without a table of terms by documents.
MOST_OPEN_TERMS = 1024
NO_KEY = -(1 << 63)
# Only digits, letters and bytes beyond ASCII belong to a term; A-Z count as a-z.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in order, with repeats."""
    return (text or "").encode().translate(TERM_BYTES).split()


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def length_norms(lengths: np.ndarray, documents: int, total: int) -> np.ndarray:
    """Per document length, what it adds below the fraction of an impact; integers of any size on the way."""
    distinct, at = np.unique(lengths, return_inverse=True)
    return np.array([75 + 25 * n * documents // total for n in distinct.tolist()], dtype=np.int64)[at]


def impacts(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 12 * norm)


def shards(docs: DataFrame, vocabulary: Sequence[bytes], key: str, text: str) -> DataFrame:
    """Documents in shards of up to SHARD_DOCS, a row each: how many hold a term, all their terms with repeats, and for
    those that hold a term of ``vocabulary`` their keys and lengths, and by term the documents and occurrences.

    Every task makes its own shards of the texts it reads; nothing is shuffled.
    """
    words = docs.sparkSession.sparkContext.broadcast(list(vocabulary))

    def sharded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {w: i for i, w in enumerate(words.value)}
        known = number.__contains__
        totals, keys, lengths, counts, found, times = [0, 0], [], [], [], [], []

        def shard() -> pa.RecordBatch:
            term, tf = np.array(found, dtype=np.int64), np.array(times, dtype=np.int64)
            doc = np.repeat(np.arange(len(keys), dtype=np.int32), counts)
            order = np.argsort(term, kind="stable")
            listed, sizes = np.unique(term, return_counts=True)
            whole = lambda values, kind: pa.array([values.tolist()], pa.list_(kind))
            packed = lambda values: pa.array([values.tobytes()], pa.binary())
            row = [pa.array([totals[0]], pa.int64()), pa.array([totals[1]], pa.int64()), packed(np.array(keys, dtype=np.int64)),
                   packed(np.array(lengths, dtype=np.int64)), whole(listed, pa.int32()), whole(sizes, pa.int64()), packed(doc[order]), packed(tf[order])]
            totals[:] = [0, 0]
            for held in (keys, lengths, counts, found, times):
                held.clear()
            return pa.RecordBatch.from_arrays(row, names=["documents", "total", "keys", "lengths", "term", "df", "doc", "tf"])

        for batch in batches:
            for k, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                listed = terms(body.as_py())
                if not listed:
                    continue
                totals[0] += 1
                totals[1] += len(listed)
                held = Counter(filter(known, listed))
                if held:
                    keys.append(NO_KEY if k is None else k)
                    lengths.append(len(listed))
                    counts.append(len(held))
                    found.extend(map(number.__getitem__, held))
                    times.extend(held.values())
                if totals[0] >= SHARD_DOCS or len(found) >= SHARD_POSTINGS:
                    yield shard()
        if totals[0]:
            yield shard()

    schema = "documents bigint, total bigint, keys binary, lengths binary, term array<int>, df array<bigint>, doc binary, tf binary"
    return saved(docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text")).mapInArrow(sharded, schema), "postings")


def resolved(lists: Sequence[tuple[np.ndarray, np.ndarray]], keys: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The best ``most`` documents of one shard with their exact scores, and how many list entries were read.

    ``lists`` has for each term of the item its documents and what they gain by it, in descending order of gain. A round
    reads on in the lists that are still needed, twice as far as before. A document's score lies between the gains read so
    far and these plus, for every list in which it was not met yet, the gain that comes next there. Documents that cannot reach the
    ``most``-th best lower end any more are out; a list is needed while a document that is not out may stand in its rest.
    It ends when all documents that are left have their exact scores, so that members, ties and scores are settled.
    """
    low = np.zeros(len(keys), dtype=np.int64)
    wide = len(lists) > MOST_OPEN_TERMS
    seen = np.zeros((0 if wide else len(lists), len(keys)), dtype=bool)
    place, ends = [0] * len(lists), [len(d) for d, _ in lists]
    ahead = np.array([g[0] for _, g in lists], dtype=np.int64)
    needed, alive, step, reads = range(len(lists)), np.arange(len(keys)), max(ends, default=0) if wide else FIRST_READ, 0
    while True:
        for t in needed:
            docs, gains = lists[t]
            a, b = place[t], min(place[t] + step, ends[t])
            low[docs[a:b]] += gains[a:b]
            if not wide:
                seen[t, docs[a:b]] = True
            place[t], ahead[t] = b, gains[b] if b < ends[t] else 0
            reads += b - a
        step *= 2
        least = max(1, int(np.partition(low, -most)[-most])) if len(low) >= most else 1
        high = low[alive] + ahead.sum() - (0 if wide else ahead @ seen[:, alive])
        alive, high = alive[high >= least], high[high >= least]
        unsettled = alive[high > low[alive]]
        if not len(unsettled):
            break
        needed = np.flatnonzero((ahead > 0) & ~seen[:, unsettled].all(axis=1)).tolist()
    best = alive[np.lexsort((keys[alive], -low[alive]))][:most]
    return best, low[best], reads


def ranked(index: DataFrame, questions: Sequence[Sequence[tuple[int, int]]], weights: Sequence[int], documents: int, total: int,
           most: int) -> DataFrame:
    """Columns question, key, score: the best of every shard. ``questions`` list their terms' numbers and repeats."""
    asked = index.sparkSession.sparkContext.broadcast((list(questions), np.array(weights, dtype=np.int64)))

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        questions, weights = asked.value
        for batch in batches:
            for i in range(len(batch)):
                keys, lengths, tf = (np.frombuffer(batch[c][i].as_py(), dtype=np.int64) for c in ("keys", "lengths", "tf"))
                doc = np.frombuffer(batch["doc"][i].as_py(), dtype=np.int32)
                numbers, sizes = batch["term"][i].values.to_numpy(), batch["df"][i].values.to_numpy()
                impact = impacts(tf, length_norms(lengths, documents, total)[doc])
                order = np.lexsort((doc, -impact, np.repeat(np.arange(len(numbers)), sizes)))
                doc, impact, starts = doc[order], impact[order], np.append(0, np.cumsum(sizes))
                lists = {n: (doc[a:b], impact[a:b]) for n, a, b in zip(numbers.tolist(), starts, starts[1:]) if weights[n] > 0}
                out = []
                for q, listed in enumerate(questions):
                    own = [(lists[t][0], weights[t] * times * lists[t][1]) for t, times in listed if t in lists]
                    if own:
                        best, scores, _ = resolved(own, keys, most)
                        out += zip([q] * len(best), [None if k == NO_KEY else k for k in keys[best].tolist()], scores.tolist())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else ([], [], []), (pa.int32(), pa.int64(), pa.int64()))],
                                                 names=["question", "key", "score"])

    return index.select("keys", "lengths", "term", "df", "doc", "tf").mapInArrow(answered, "question int, key bigint, score bigint")


def search(docs: DataFrame, items: DataFrame, most: int = MOST_RESULTS, key: str = "doc_id", text: str = "text",
           item: str = "item_id", item_text: str = "text") -> DataFrame:
    """Columns item, rank, key, score: the ``most`` documents of highest score above 0 for every item, equal scores by key.

    Shards of documents are searched alone, each with its own impact-sorted lists, and their best meet at the end. Items
    come in blocks of about BLOCK_BYTES of text (an item is not divided); each block is one pass over the documents.

    Null and empty texts, and texts without terms, are found by nothing and count nowhere; items without terms get no rows.
    Rows that repeat a key are documents of their own, null keys come first among equal scores. Rows that repeat an item and its
    text are asked once; one id with several texts gets a ranking for each. Empty tables give no rows. Further columns are not read.
    """
    asked = items.select(F.col(item).alias("item"), F.col(item_text).alias("text")).where(F.col("text").isNotNull()).distinct()
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES)
    kind, out = items.schema[item].dataType.simpleString(), None
    for block in range(blocks):
        # About BLOCK_BYTES of items, by the sum just taken.
        rows = asked.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).collect()
        counted = [Counter(terms(r.text)) for r in rows]
        vocabulary = sorted(set().union(*counted))
        number = {w: i for i, w in enumerate(vocabulary)}
        index = shards(docs, vocabulary, key, text)
        documents, total = index.agg(F.coalesce(F.sum("documents"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
        holding = index.select(F.explode(F.arrays_zip("term", "df")).alias("e")).groupBy("e.term").agg(F.sum("e.df").alias("df"))
        df = {r.term: r.df for r in holding.collect()}  # a number per term of the block
        weights = [weight(documents, df[i]) if i in df else 0 for i in range(len(vocabulary))]
        questions = [[(number[w], times) for w, times in sorted(c.items())] for c in counted]
        found = ranked(index, questions, weights, documents, total, most)
        first = Window.partitionBy("question").orderBy(F.desc("score"), F.asc_nulls_first("key"))
        found = found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= most)
        names = docs.sparkSession.createDataFrame([(q, r["item"]) for q, r in enumerate(rows)], f"question int, item {kind}")
        found = found.join(F.broadcast(names), "question").select(F.col("item").alias(item), "rank", F.col("key").alias(key), "score")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return docs.sparkSession.createDataFrame([], f"`{item}` {kind}, rank int, `{key}` bigint, score bigint")
    return out


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op11_ranked_search": op11_ranked_search}
ORACLE = {"op11_ranked_search": r"""
WITH words AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
asked AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
lengths AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
totals AS (SELECT count(*) AS N_all, CAST(sum(n) AS BIGINT) AS L_all FROM lengths),
norms AS (SELECT doc_id, 75 + (25 * n * N_all) // L_all AS m FROM lengths, totals),
postings AS (SELECT doc_id, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(N_all) + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM postings, totals GROUP BY term),
scores AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM asked JOIN postings USING (term) JOIN weights USING (term) JOIN norms USING (doc_id) GROUP BY ALL),
ranks AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranks WHERE rank <= 20
"""}
