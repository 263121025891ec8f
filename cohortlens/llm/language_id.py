"""Language identification by compression: a text belongs to the language whose dictionary shrinks it most."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import fold, least_by_hash, stretches, table

DICTIONARY_BYTES = 1 << 17
SAMPLE_ROWS = 400
MOST_LANGUAGES = 256
# Matches of four bytes tell more than the presets' five to seven.
SEARCH = {"strategy": zstandard.STRATEGY_LAZY, "min_match": 4, "window_log": 19, "hash_log": 16, "chain_log": 17, "search_log": 4}
NARROW_BITS = 0.02


def letters_only(text: Column) -> Column:
    """Lower case, with every run of other characters as one blank: marks and digits tell no language."""
    return F.regexp_replace(F.lower(text), r"\P{L}+", " ")


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
          dictionary_bytes: int = DICTIONARY_BYTES, sample_rows: int = SAMPLE_ROWS) -> dict[str, bytes]:
    """A raw-content dictionary per language, the most frequent language first: the letters of a bounded sample, joined.

    The fit is bounded by two parameters: about ``sample_rows`` rows of each language, chosen by
    the hash of the id, and ``dictionary_bytes`` of their text, of long texts stretches from all over them; more than
    MOST_LANGUAGES labels raise. Rows with a null label or no letter teach nothing; repeated rows come with their id, and
    their text is then in the dictionary as often. An empty table teaches no language. Further columns are not read.
    """
    known = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")).where(
        F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    ranked = [r.lang for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES + 1).collect()]
    if len(ranked) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} labels in {lang}")
    chosen = least_by_hash(known, "lang", "key", sample_rows).distinct()
    # No text gives more than its share, from all over it, so that one long text does not fill a dictionary.
    share = max(8, dictionary_bytes // 32)
    taken = F.concat_ws(" ", stretches(F.col("text"), share, F.col("key")))
    sample = known.join(F.broadcast(chosen), ["lang", "key"]).select("lang", F.xxhash64("key").alias("place"), letters_only(taken).alias("text"))
    texts: dict[str, list] = {}
    for row in sample.collect():
        texts.setdefault(row.lang, []).append((row.place, row.text))
    return {name: "".join(t for _, t in sorted(texts[name])).encode()[:dictionary_bytes] for name in ranked if name in texts}


def classify(docs: DataFrame, dictionaries: dict[str, bytes], key: str = "doc_id", text: str = "text",
             narrow_bits: float = NARROW_BITS) -> DataFrame:
    """Columns key, lang_pred, score, rejected and bits (compressed bits per byte in the best language).

    The letters of each whole text are compressed once per dictionary; the smallest result wins, a
    tie going to the language that comes first in ``dictionaries``. ``score`` falls from 1 towards 1/2 and below as the
    next languages come near; ``rejected`` marks texts whose margin is under ``narrow_bits`` bits
    a byte, and they keep their best guess. A text that is null or has no letter is ``und`` with
    score 0, and rejected; so is every text if no language was learned. Repeated rows are judged alike, an empty table
    gives no rows, further columns are not read.
    """
    names = list(dictionaries)
    schema = "key bigint, lang_pred string, score double, rejected boolean, bits double"

    def compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def compressor(name: str):
            parameters = zstandard.ZstdCompressionParameters(
                write_checksum=False, write_content_size=False, write_dict_id=False, **SEARCH)
            content = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(compression_params=parameters)
            return zstandard.ZstdCompressor(compression_params=parameters, dict_data=content)

        compressors = [compressor(n) for n in names]

        def one(body: str | None, letters: bool):
            if not letters or not names:
                return "und", 0.0, True, None
            data = body.encode()
            sizes = [len(c.compress(data)) for c in compressors]
            best = min(sizes)
            # Code lengths are log-probabilities; their scale is damped, as errors within a text are not independent.
            scale = math.log(2) * 8 / max(1.0, math.sqrt(len(data)) / 4)
            score = 1 / sum(math.exp(-min(700.0, (s - best) * scale)) for s in sizes)
            second = min((s for i, s in enumerate(sizes) if i != sizes.index(best)), default=best + len(data))
            return names[sizes.index(best)], score, (second - best) * 8 < narrow_bits * len(data), best * 8 / len(data)

        for batch in batches:
            results = [one(t, ok) for t, ok in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            columns = list(zip(*results)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.float64(), pa.bool_(), pa.float64())))],
                names=["key", "lang_pred", "score", "rejected", "bits"])

    rows = docs.select(F.col(key).cast("bigint").alias("key"), letters_only(F.col(text)).alias("text"),
                       F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    return rows.mapInArrow(compressed, schema).withColumnRenamed("key", key)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    dictionaries = learn(docs.where(fold(F.col("doc_id"), 4) != 2))
    return classify(docs, dictionaries).select(
        "doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "rejected", "bits")


QUERIES = {"op1_language_id": op1_language_id}
ORACLE: dict[str, str] = {}
