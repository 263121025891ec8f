"""One document per patient out of many text records.

A document is a DataFrame row ``(pid, part, parts, text)``. A patient whose text fits one row has
a single part; a longer one keeps its text in consecutive pieces of equal length (the last may
be shorter) that concatenate to the document, so no patient is gathered whole into one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import ngrams, token_text, tokens
from ..session import cut_lineage, settled, unsettle
from .ordering import positions, running_total
from .repeats import blank_in_row, blank_pieces

# Longest text kept in a single row, and the piece length beyond it, in characters.
ROW_CHARS = 4_000_000
PIECE_CHARS = 65_536

SCHEMA = ("pid", "part", "parts", "text")


def whole(df: DataFrame, pid: Column, text: Column) -> DataFrame:
    """Documents that arrive as one row per patient already."""
    return df.select(
        pid.cast("string").alias("pid"),
        F.lit(0).alias("part"), F.lit(1).alias("parts"),
        F.coalesce(text, F.lit("")).alias("text"),
    )


def assemble(rows: DataFrame, pid: Column, text: Column, order: Sequence[Column], separator: str = "\n",
             skip_empty: bool = False, size: Column | None = None,
             row_chars: int = ROW_CHARS, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """Join each patient's texts in ``order`` (ties by the text itself) with ``separator``.

    ``size`` is an upper bound of a record's text length that is cheap to read, such as a stored
    character count; the default measures the text. One pass over it finds the patients too
    long for one row; normally there are none and the plan is a single grouping.
    """
    order_names = [f"_o{i}" for i in range(len(order))]
    measured = F.coalesce(F.length(text) if size is None else size, F.lit(0)).cast("bigint").alias("_size")
    columns = [
        pid.cast("string").alias("pid"),
        *[c.alias(n) for c, n in zip(order, order_names)],
        F.coalesce(text, F.lit("")).alias("_text"),
    ]
    records = rows.select(*columns)
    sizes = rows.select(pid.cast("string").alias("pid"), measured)
    long_ids = cut_lineage(
        sizes.groupBy("pid").agg(F.sum(F.col("_size") + len(separator)).alias("_total"))
        .where(F.col("_total") > row_chars).select("pid")
    )
    if long_ids.isEmpty():
        return _in_rows(records, order_names, separator, skip_empty)
    # A record that is too long by itself is no short patient's and need not be moved to find that out. Records without an id stay in one row.
    able = F.col("pid").isNull() | (F.col("_size") + len(separator) <= row_chars)
    short = rows.select(*columns, measured).where(able).drop("_size").join(long_ids, "pid", "left_anti")
    long = records.join(long_ids, "pid", "left_semi")
    pieces = _in_pieces(long, order_names, separator, skip_empty, piece_chars)
    found = _in_rows(short, order_names, separator, skip_empty).unionByName(pieces)
    found.pieces = pieces
    return found


def _in_rows(records: DataFrame, order: Sequence[str], separator: str, skip_empty: bool) -> DataFrame:
    entries = F.sort_array(F.collect_list(F.struct(*order, "_text")))
    grouped = records.groupBy("pid").agg(entries.alias("_entries")).select("pid", F.col("_entries._text").alias("_texts"))
    texts = F.filter("_texts", lambda t: t != "") if skip_empty else F.col("_texts")
    return grouped.select(
        "pid", F.lit(0).alias("part"), F.lit(1).alias("parts"),
        F.array_join(texts, separator).alias("text"),
    )


def _in_pieces(records: DataFrame, order: Sequence[str], separator: str, skip_empty: bool,
               piece_chars: int) -> DataFrame:
    """The pieces, settled: later steps read them several times and must not cut the texts again."""
    counted = F.length("_text").cast("bigint") + len(separator)
    if skip_empty:
        counted = F.when(F.col("_text") == "", F.lit(0).cast("bigint")).otherwise(counted)
    placed = running_total(records, ["pid"], [*order, "_text"], counted, "_before")
    slices = placed.slices
    joined = F.when(F.col("_before") == 0, F.col("_text")).otherwise(F.concat(F.lit(separator), F.col("_text")))
    if skip_empty:
        joined = F.when(F.col("_text") == "", F.lit("")).otherwise(joined)
    placed = (
        placed.select("pid", "_before", joined.alias("_joined"),
                      F.greatest(F.col("_before") - len(separator), F.lit(0)).alias("_start"))
        .where((F.col("_joined") != "") | (F.col("_before") == 0))
    )
    # Cut each record where a piece ends, so that all pieces but the last are exactly full.
    length = F.length("_joined")
    first_part = F.floor(F.col("_start") / piece_chars)
    last_part = F.floor((F.col("_start") + F.greatest(length, F.lit(1)) - 1) / piece_chars)
    first_chars = ((first_part + 1) * piece_chars - F.col("_start")).cast("int")
    # The rest is divided in one pass; a substring for each piece would count the characters before it again.
    rest = F.regexp_extract_all(F.substring("_joined", first_chars + 1, length), F.lit(f"(?s).{{1,{piece_chars}}}"), F.lit(0))
    cut = (
        placed.select("pid", "_before", first_part.alias("_first"), F.posexplode(F.concat(
            F.array(F.substring("_joined", F.lit(1), first_chars)), rest)).alias("_at", "_chunk"))
        .select("pid", (F.col("_first") + F.col("_at")).cast("int").alias("part"), "_before", "_chunk")
    )
    pieces = cut.groupBy("pid", "part").agg(
        F.sort_array(F.collect_list(F.struct("_before", "_chunk"))).alias("_entries")
    ).select("pid", "part", F.array_join("_entries._chunk", "").alias("text"))
    counts = placed.groupBy("pid").agg((F.max(last_part) + 1).cast("int").alias("parts"))
    # In two steps, so that the shuffle of the one is gone when the other moves the pieces.
    alone, counted = settled(pieces), settled(counts)
    unsettle(slices)
    found = settled(alone.join(counted, "pid").select(*SCHEMA))
    unsettle(alone, counted)
    return found


def blank_repeats(documents: DataFrame, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """Blank the repeated spans of every document, in the row or across pieces."""
    in_row = documents.where(F.col("parts") == 1).withColumn("text", blank_in_row(F.col("text")))
    pieces = documents.where(F.col("parts") > 1)
    return in_row.unionByName(blank_pieces(pieces, piece_chars).select(*SCHEMA))


def whole_words(documents: DataFrame) -> DataFrame:
    """Clean documents whose pieces end where a word ends: what a piece begins with of a word goes to the piece before.

    Pieces were cut at fixed lengths, which no word of a clean text exceeds, so a word lies in two
    pieces at most. The text as a whole stays the same; patients in one row are left alone.
    """
    # Read several times, so settled once, if ``assemble`` has not just done so. Only the beginnings of words that move meet other pieces.
    known = getattr(documents, "pieces", None)
    rest = settled(documents.where(F.col("parts") > 1)) if known is None else known.where(F.col("parts") > 1)
    if rest.isEmpty():
        if known is None:
            unsettle(rest)
        return documents
    ends_inside = rest.where(F.col("text").rlike("[^ ]\\z")).select("pid", (F.col("part") + 1).alias("part"))
    heads = rest.select("pid", "part", F.regexp_extract("text", "^[^ ]*", 0).alias("_head")).where(F.col("_head") != "")
    given = heads.join(ends_inside, ["pid", "part"]).select("pid", F.inline(F.array(
        F.struct("part", F.length("_head").alias("_cut"), F.lit("").alias("_tail")),
        F.struct((F.col("part") - 1).alias("part"), F.lit(0).alias("_cut"), F.col("_head").alias("_tail")))))
    changes = given.groupBy("pid", "part").agg(F.max("_cut").alias("_cut"), F.max("_tail").alias("_tail"))
    moved = rest.join(changes, ["pid", "part"], "left").select(
        "pid", "part", "parts",
        F.concat(F.substring("text", F.coalesce("_cut", F.lit(0)) + 1, F.length("text")), F.coalesce("_tail", F.lit(""))).alias("text"))
    found = settled(moved)
    if known is None:
        unsettle(rest)
    return documents.where(F.col("parts") == 1).unionByName(found)


def document_bigrams(documents: DataFrame) -> DataFrame:
    """``(pid, part, pairs)``: the neighbouring words of clean documents, joined by ``_``; a pair that two
    pieces hold belongs to the first of them. Pieces without a word do not appear."""
    words = documents.select("pid", "part", tokens(F.col("text")).alias("words")).where(F.size("words") > 0)
    # Numbered, as a piece between two others may have no word left.
    placed = words.join(positions(words.select("pid", "part"), ["pid"], ["part"], "_at"), ["pid", "part"])
    following = placed.select("pid", (F.col("_at") - 1).alias("_at"), F.col("words")[0].alias("_next"))
    row = placed.join(following, ["pid", "_at"], "left").select(
        "pid", "part", F.concat("words", F.array_compact(F.array("_next"))).alias("_words"))
    return row.select("pid", "part", ngrams(F.col("_words"), 2).alias("pairs"))


def review_documents(rows: DataFrame, pid: Column, text: Column, order: Sequence[Column],
                     piece_chars: int = PIECE_CHARS, **limits) -> tuple[DataFrame, DataFrame]:
    """The raw document and the same with repeated spans blanked, for reading by people."""
    raw = assemble(rows, pid, text, order, piece_chars=piece_chars, **limits)
    return raw, blank_repeats(raw, piece_chars)


def clean_documents(rows: DataFrame, pid: Column, text: Column, order: Sequence[Column],
                    piece_chars: int = PIECE_CHARS, **limits) -> DataFrame:
    """The stored clean text: words only, repeated spans blanked.

    Words are taken record by record, ahead of the grouping: records are joined by a line break,
    which no word spans, and the shuffle then carries words instead of raw text.
    """
    limits.setdefault("size", F.length(text))
    words = assemble(rows, pid, token_text(text), order, separator=" ", skip_empty=True,
                     piece_chars=piece_chars, **limits)
    return whole_words(blank_repeats(words, piece_chars))


def document_of(documents: DataFrame, pid: str) -> DataFrame:
    """The document rows of one patient, in reading order."""
    return documents.where(F.col("pid") == pid).orderBy("part")
