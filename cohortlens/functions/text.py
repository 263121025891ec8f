"""Text functions: whitespace rules, category slug, tokeniser, word pairs."""

from __future__ import annotations

import re
import sys
from functools import reduce

from pyspark import cloudpickle
from pyspark.sql import Column, functions as F

# Task functions travel with the job, so executors do not need this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The whitespace characters (the Unicode set), as the inside of a Java regex class.
SPACE_CHARS = (
    r"\t\n\x0b\f\r \x1c\x1d\x1e\x1f\x85\xa0"
    r"\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
)
# Token length limits. The lower one holds for words, the upper one for raw
# whitespace-separated chunks before punctuation is removed.
MIN_TOKEN = 3
MAX_TOKEN = 64
# Chunks that look like web addresses.
WEB_STARTS = ("http", "www")
WEB_ENDS = (".edu", ".com", ".org")

SPACE = f"[{SPACE_CHARS}]"


def strip_space(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+\z", "")


def slug(text: Column) -> Column:
    """Lower-case category name without outer whitespace, inner runs joined by an underscore."""
    return F.regexp_replace(strip_space(F.lower(text)), f"{SPACE}+", "_")


def tokens(text: Column, min_len: int = MIN_TOKEN, max_len: int = MAX_TOKEN) -> Column:
    """Words of a text, in order, as ``array<string>``.

    A word is a run of at least ``min_len`` letters a-z inside a kept chunk. Most texts hold neither
    a web address nor an over-long chunk; a few byte searches find that out and only the others are
    taken apart chunk by chunk. The extraction of words is then a single pass.
    """

    def words(lowered: Column) -> Column:
        suspicious = reduce(
            lambda a, b: a | b,
            [F.contains(lowered, F.lit(mark)) for mark in (*WEB_STARTS, *WEB_ENDS)],
            lowered.rlike(rf"(?<![^ \n])[^ \n]{{{max_len + 1}}}"),
        )
        kept_chunks = F.filter(F.split(lowered, f"{SPACE}+"), keep_chunk)
        kept = F.when(suspicious, F.array_join(kept_chunks, " ")).otherwise(lowered)
        return F.regexp_extract_all(kept, F.lit(f"[a-z]{{{min_len},}}"), F.lit(0))

    def keep_chunk(chunk: Column) -> Column:
        web = [F.startswith(chunk, F.lit(m)) for m in WEB_STARTS] + [F.endswith(chunk, F.lit(m)) for m in WEB_ENDS]
        return (F.length(chunk) <= max_len) & ~reduce(lambda a, b: a | b, web)

    # Through a one-element array the lower-cased text is made once and read several times.
    return F.get(F.transform(F.array(F.lower(text)), words), F.lit(0))


def token_text(text: Column) -> Column:
    """Words joined by single spaces: the normalised form that is stored as clean text."""
    return F.array_join(tokens(text), " ")


def found_words(lowered: str) -> list[str]:
    """The words that ``tokens`` takes from a text, for use inside a task, on the text as Spark's ``lower`` gives it.

    Python divides at the same white space, and no word holds any, so only the texts that may hold a chunk to be left out are taken apart.
    """
    chunks = lowered.split()
    if max(map(len, chunks), default=0) > MAX_TOKEN or any(mark in lowered for mark in (*WEB_STARTS, *WEB_ENDS)):
        lowered = " ".join([c for c in chunks if len(c) <= MAX_TOKEN and not c.startswith(WEB_STARTS) and not c.endswith(WEB_ENDS)])
    return re.findall(f"[a-z]{{{MIN_TOKEN},}}", lowered)


def ngrams(words: Column, n: int) -> Column:
    """Single words (n = 1) or neighbouring pairs joined by an underscore (n = 2).

    Pass a materialised column for pairs, since it is read more than once.
    """
    if n == 1:
        return words
    if n != 2:
        raise NotImplementedError("only single words and pairs are defined")
    pairs = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(
        F.slice(words, F.lit(1), pairs),
        F.slice(words, F.lit(2), pairs),
        lambda left, right: F.concat_ws("_", left, right),
    )


def row_text(*cols: str) -> Column:
    """The text of one record: its text columns in declared order, one per line, missing as empty."""
    return F.concat_ws("\n", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])
