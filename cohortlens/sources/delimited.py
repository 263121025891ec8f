"""Delimited text tables with declared, positional schemas.

Fields may hold line breaks, so whether a line begins a record depends on all quotes before it. Files are
still read block by block: a first pass reduces every block where it lies to what it does with either
state, open or closed, that the text before may leave; a scan over these few rows settles the state and the number of
records at the start of each block; a second pass parses the blocks in place. Only the lines of records
that reach over the end of a block are brought together. The rows of a file are the same however it is divided.
"""

from __future__ import annotations

import csv
import re
import sys
from collections.abc import Iterator, Sequence
from dataclasses import replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window, WindowSpec, functions as F

from ..operators.quality import ID_LENGTH
from ..session import cut_lineage
from .catalog import TableSpec

# Task functions travel with the job, so executors need numpy and pyarrow but not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CORRUPT = "_corrupt"
FILE = "_file"
BLOCK = "_block_start"
LINE = "_line"
# Rows (one per block) that may be broadcast; with blocks of 128 MB these are 25 TB of one table.
MOST_BLOCKS = 200_000
# Smaller blocks are read several by one task, up to about so many bytes.
TASK_BYTES = 1 << 27
# A record is put together up to about this length; a longer one, in practice a quote that is never closed, is cut there and malformed.
MOST_RECORD = 1 << 29
FIELD_LIMIT = (1 << 31) - 1
# Files of which the first rows are looked up together.
FILES_AT_ONCE = 64


class QuoteRule:
    """Whether a quoted field is open after a line, if none was open before it and if one was.

    A quote opens a field only where the field begins; inside, a doubled quote is text and a single
    one closes. Whatever follows up to the next delimiter is text, quotes included.
    """

    def __init__(self, delimiter: str, quote: str):
        q, d = re.escape(quote), re.escape(delimiter)
        closing = f"(?:[^{q}]++|{q}{q})*+{q}(?!{q})[^{d}]*+"
        field = f"(?:{q}{closing}|(?!{q})[^{d}]*+)"
        self.closed = re.compile(f"{field}(?:{d}{field})*+", re.DOTALL)
        self.closes = re.compile(f"{closing}(?:{d}{field})*+", re.DOTALL)

    def after(self, line: str, is_open: bool) -> bool:
        return not (self.closes if is_open else self.closed).fullmatch(line)


def read_table(spark: SparkSession, path: str, spec: TableSpec, header: bool = True, limit: int | None = None,
               report: bool = False) -> DataFrame:
    """All rows of the table's files in a folder (or of one file), as strings.

    Columns are taken by position and a missing field is the empty string. A short, long or
    otherwise malformed row is kept with what could be read. Lines end with ``\\n``, ``\\r\\n`` or ``\\r``, and a line break
    inside a field becomes ``\\n``; empty lines between records are passed over. A quote that is never closed takes the rest of
    its file into its field. ``report`` adds the row's place (file, block and number of the record) and
    ``_corrupt``, the raw text of a malformed row.

    ``limit`` keeps that many rows of each file and reads only so many lines of it as hold them, whatever its size; these
    rows are written to the shared folder at once. The encoding must agree with ASCII where characters do.
    """
    rows, _ = scan(spark, path, spec, header, limit)
    return rows if report else rows.select(*spec.columns)


def scan(spark: SparkSession, path: str, spec: TableSpec, header: bool = True, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows of ``read_table`` with their places, and ``(_file, num_rows)`` of every file that has rows, which the first pass knows."""
    if spec.encoding.upper().replace("-", "").startswith(("UTF16", "UTF32")):
        raise ValueError(f"{spec.encoding} cannot be divided at line ends")
    if limit is not None:
        rows = _first(spark, path, spec, header, limit)
        return rows, rows.groupBy(FILE).agg(F.count("*").alias("num_rows"))
    rows, blocks = _all(spark, path, spec, header)
    counts = blocks.groupBy(FILE).agg((F.sum("_begins") - int(header)).alias("num_rows"))
    return rows, counts.where("num_rows > 0")


def _matching(reader, path: str, spec: TableSpec):
    return reader if path.endswith(".csv") else reader.option("pathGlobFilter", spec.pattern)


def _lines(spark: SparkSession, path: str, spec: TableSpec) -> DataFrame:
    raw = _matching(spark.read, path, spec).text(path)
    utf8 = spec.encoding.upper() in ("UTF-8", "UTF8")
    value = F.make_valid_utf8("value") if utf8 else F.decode(F.col("value").cast("binary"), spec.encoding)
    return raw.select(F.col("_metadata.file_path").alias(FILE), F.col("_metadata.file_block_start").alias(BLOCK), value.alias("_text"))


def _in_few_tasks(lines: DataFrame) -> DataFrame:
    """The same blocks, each still read from its beginning to its end, in no more tasks than their bytes and the cores ask for."""
    spark, blocks = lines.sparkSession, lines.rdd.getNumPartitions()
    number, unit = re.fullmatch(r"(\d+)([kmgtp]?)b?", spark.conf.get("spark.sql.files.maxPartitionBytes").strip().lower()).groups()
    size = int(number) << 10 * " kmgtp".index(unit or " ")
    tasks = max(-(-blocks * size // TASK_BYTES), 4 * spark.sparkContext.defaultParallelism)
    return lines.coalesce(tasks) if tasks < blocks else lines


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """The stretches of a batch that lie in one block: file, block and rows."""
    if not len(batch):
        return
    file, block = batch[FILE].dictionary_encode().indices.to_numpy(), batch[BLOCK].to_numpy()
    starts = np.flatnonzero(np.append(True, (file[1:] != file[:-1]) | (block[1:] != block[:-1])))
    for a, b in zip(starts, np.append(starts[1:], len(batch))):
        yield batch[FILE][a].as_py(), int(block[a]), batch.slice(a, b - a)


def _summaries(lines: DataFrame, spec: TableSpec) -> DataFrame:
    """One row per block: its characters and lines and, for either state before it, the state after it and how many records it begins."""
    delimiter, quote = spec.delimiter, spec.quote

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule, place, size, count, states, numbers = QuoteRule(delimiter, quote), None, 0, 0, [False, True], [0, 0]

        def summary() -> pa.RecordBatch:
            values = (*place, size, count, *map(int, states), *numbers)
            kinds = (pa.string(), *[pa.int64()] * 3, *[pa.int32()] * 2, *[pa.int64()] * 2)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)],
                                              names=[FILE, BLOCK, "_size", "_lines", "_shut", "_opened", "_starts0", "_starts1"])

        for batch in batches:
            for file, block, part in _parts(batch):
                if (file, block) != place:
                    if place is not None:
                        yield summary()
                    place, size, count, states, numbers = (file, block), 0, 0, [False, True], [0, 0]
                text = part["_text"]
                lengths = pc.utf8_length(text).to_numpy(zero_copy_only=False)
                count += len(lengths)
                size += int(lengths.sum()) + len(lengths)
                filled = np.append(0, np.cumsum(lengths > 0))
                quoted = np.flatnonzero(pc.match_substring(text, quote).to_numpy(zero_copy_only=False))
                at = 0
                for i in [*quoted.tolist(), len(lengths)]:
                    # Lines without quotes leave the state as it is.
                    for s in (0, 1):
                        numbers[s] += 0 if states[s] else int(filled[i] - filled[at])
                    if i < len(lengths):
                        line = text[i].as_py()
                        for s in (0, 1):
                            numbers[s] += 0 if states[s] else 1
                            states[s] = rule.after(line, states[s])
                    at = i + 1
        if place is not None:
            yield summary()

    return lines.mapInArrow(reduced, f"{FILE} string, {BLOCK} bigint, _size bigint, _lines bigint, _shut int, _opened int, _starts0 bigint, _starts1 bigint")


def _open_before(before: WindowSpec) -> Column:
    """The state before each block of a file, from what every block makes of either state.

    A block after which the state does not depend on that before resets it; since the last such
    block only those that turn the state around count.
    """
    turned = F.coalesce(F.sum((F.col("_shut") > F.col("_opened")).cast("int")).over(before), F.lit(0))
    reset = F.last(F.when(F.col("_shut") == F.col("_opened"), F.struct(F.col("_turned").alias("turned"), F.col("_shut").alias("state"))), ignorenulls=True).over(before)
    return (F.coalesce(reset["state"], F.lit(0)) + turned - F.coalesce(reset["turned"], F.lit(0))) % 2


def _blocks(lines: DataFrame, spec: TableSpec) -> DataFrame:
    """For every block: whether it begins and ends inside a quoted field, how many records begin before it, and
    whether the record that it continues is too long already."""
    by_file = Window.partitionBy(FILE).orderBy(BLOCK)
    earlier, up_to = by_file.rowsBetween(Window.unboundedPreceding, -1), by_file.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = F.when(F.col("_carry") == 0, F.col("_starts0")).otherwise(F.col("_starts1"))
    total = F.sum("_size").over(up_to)
    return (
        _summaries(lines, spec)
        .withColumn("_turned", F.sum((F.col("_shut") > F.col("_opened")).cast("int")).over(up_to))
        .withColumn("_carry", _open_before(earlier))
        .withColumn("_base", F.coalesce(F.sum(starts).over(earlier), F.lit(0)))
        .withColumn("_before", F.last(F.when(starts > 0, total - F.col("_size")), ignorenulls=True).over(earlier))
        .select(FILE, BLOCK, (F.col("_carry") == 1).alias("_carry"), "_base", starts.alias("_begins"),
                (F.when(F.col("_carry") == 0, F.col("_shut")).otherwise(F.col("_opened")) == 1).alias("_ends_open"),
                F.coalesce(total - F.col("_size") - F.col("_before") > MOST_RECORD, F.lit(False)).alias("_too_long"))
    )


def _row_schema(spec: TableSpec) -> str:
    return ", ".join(f"`{c}` string" for c in (*spec.columns, CORRUPT, FILE)) + f", {BLOCK} bigint, {LINE} bigint"


class _Parser:
    """Records of one table as rows; a row that does not have all columns comes with its raw text."""

    def __init__(self, columns: list[str], delimiter: str, quote: str):
        self.columns, self.delimiter, self.quote = columns, delimiter, quote
        csv.field_size_limit(FIELD_LIMIT)

    def rows(self, texts: list[str], file: list[str], block: list[int], number: list[int], cut: list[bool] | None = None) -> pa.RecordBatch:
        width, fields, corrupt = len(self.columns), [], []
        whole = csv.reader(texts, delimiter=self.delimiter, quotechar=self.quote) if cut is None else \
            (next(csv.reader([t], delimiter=self.delimiter, quotechar=self.quote)) for t in texts)
        for i, (found, text) in enumerate(zip(whole, texts, strict=True)):
            corrupt.append(text if len(found) != width or (cut and cut[i]) else None)
            fields.append(found[:width] + [""] * (width - len(found)))
        listed = list(zip(*fields)) if fields else [[]] * width
        arrays = [pa.array(c, pa.string()) for c in (*listed, corrupt, file)] + [pa.array(c, pa.int64()) for c in (block, number)]
        return pa.RecordBatch.from_arrays(arrays, names=[*self.columns, CORRUPT, FILE, BLOCK, LINE])


class _Records:
    """Puts lines together to records, with the number of each in its file."""

    def __init__(self, rule: QuoteRule, quote: str, is_open: bool = False, number: int = 0, too_long: bool = False):
        self.rule, self.quote, self.is_open, self.number, self.held = rule, quote, is_open, number, []
        self.continues, self.too_long = is_open, too_long

    def add(self, text: pa.Array) -> Iterator[tuple[str, int, bool]]:
        """Records that end within ``text``, with their numbers and whether they began before the first line."""
        for line, quoted in zip(text.to_pylist(), pc.match_substring(text, self.quote).to_pylist()):
            if not self.is_open and not line:
                continue
            self.number += 0 if self.is_open else 1
            self.is_open = self.rule.after(line, self.is_open) if quoted else self.is_open
            self.held.append(line)
            if not self.is_open:
                yield from self.rest()
                self.held, self.continues = [], False

    def rest(self) -> Iterator[tuple[str, int, bool]]:
        """What is held now; not what belongs to a record that is too long already."""
        if self.held and not (self.continues and self.too_long):
            yield "\n".join(self.held), self.number, self.continues


def _without_mark(text: str, number: int) -> str:
    """A byte-order mark before the first record is not text."""
    return text.removeprefix("\ufeff") if number == 1 else text


def _all(spark: SparkSession, path: str, spec: TableSpec, header: bool) -> tuple[DataFrame, DataFrame]:
    lines = _in_few_tasks(_lines(spark, path, spec))
    # A few numbers per block, settled once and for all.
    blocks = cut_lineage(_blocks(lines, spec))
    count, spans = blocks.agg(F.count("*"), F.coalesce(F.max("_ends_open"), F.lit(False))).first()
    known = lines.join(F.broadcast(blocks) if count <= MOST_BLOCKS else blocks, [FILE, BLOCK]).select(
        FILE, BLOCK, "_text", "_carry", "_base", "_too_long")
    columns, delimiter, quote = list(spec.columns), spec.delimiter, spec.quote

    def records(batches: Iterator[pa.RecordBatch], spanning: bool) -> Iterator[tuple[str, int, list[tuple[str, int, bool]]]]:
        """Per stretch of a block: its records, or the pieces of those that reach over its ends."""
        rule, place, held = QuoteRule(delimiter, quote), None, None
        for batch in batches:
            for file, block, part in _parts(batch):
                if (file, block) != place:
                    if held is not None and spanning:
                        yield *place, list(held.rest())
                    place, held = (file, block), _Records(rule, quote, *(part[c][0].as_py() for c in ("_carry", "_base", "_too_long")))
                yield file, block, [r for r in held.add(part["_text"]) if r[2] == spanning]
        if held is not None and spanning:
            yield *place, list(held.rest())

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _Parser(columns, delimiter, quote)
        for file, block, found in records(batches, False):
            found = [(_without_mark(t, n), n) for t, n, _ in found if not (header and n == 1)]
            if found:
                yield parser.rows([t for t, _ in found], [file] * len(found), [block] * len(found), [n for _, n in found])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, block, found in records(batches, True):
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file] * len(found), pa.string()), pa.array([block] * len(found), pa.int64()),
                     pa.array([n for _, n, _ in found], pa.int64()), pa.array([t for t, *_ in found], pa.string())], names=[FILE, BLOCK, LINE, "_text"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _Parser(columns, delimiter, quote)
        for batch in batches:
            numbers = batch[LINE].to_pylist()
            texts = [_without_mark(t, n) for t, n in zip(batch["_text"].to_pylist(), numbers)]
            yield parser.rows(texts, batch[FILE].to_pylist(), batch[BLOCK].to_pylist(), numbers, batch["_cut"].to_pylist())

    rows = known.mapInArrow(parsed, _row_schema(spec))
    if not spans:
        return rows, blocks
    # A file's last record counts as one that reaches over an end if its quote is never closed.
    reaching = known.mapInArrow(pieces, f"{FILE} string, {BLOCK} bigint, {LINE} bigint, _text string")
    together = reaching.groupBy(FILE, LINE).agg(F.sort_array(F.collect_list(F.struct(BLOCK, "_text"))).alias("_parts"))
    long = blocks.where("_too_long and _carry").select(FILE, F.col("_base").alias(LINE)).distinct().withColumn("_cut", F.lit(True))
    together = together.join(long, [FILE, LINE], "left").select(
        FILE, F.col("_parts")[0][BLOCK].alias(BLOCK), LINE, F.array_join("_parts._text", "\n").alias("_text"), F.coalesce("_cut", F.lit(False)).alias("_cut"))
    together = together.where(F.col(LINE) > 1) if header else together
    return rows.unionByName(together.mapInArrow(joined, _row_schema(spec))), blocks


def _first(spark: SparkSession, path: str, spec: TableSpec, header: bool, limit: int) -> DataFrame:
    """The first ``limit`` rows of each file.

    Of every file so many first lines are taken as there are rows wanted, then more where these hold too few records. Spark
    stops reading a file at the last line that is taken. Files are looked at some at a time, each by a task of its own.
    """
    listing = _matching(spark.read.format("binaryFile"), path, spec).load(path)
    sizes = {r[FILE]: (r.path, r.length) for r in listing.select(F.col("_metadata.file_path").alias(FILE), "path", "length").collect()}
    wanted, columns, delimiter, quote = limit + int(header), list(spec.columns), spec.delimiter, spec.quote

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser, place, held, left = _Parser(columns, delimiter, quote), None, None, limit

        def rows(found: list[tuple[str, int, bool]], cut: list[bool] | None = None) -> pa.RecordBatch:
            nonlocal left
            found = [(_without_mark(t, n), n) for t, n, _ in found if not (header and n == 1)][:left]
            left -= len(found)
            return parser.rows([t for t, _ in found], [place] * len(found), [0] * len(found), [n for _, n in found], cut)

        for batch in batches:
            for file, block, part in _parts(batch):
                if file != place:
                    if held is not None:
                        yield rows(list(held.rest()), [])
                    place, held, left = file, _Records(QuoteRule(delimiter, quote), quote), limit
                if block:
                    raise ValueError(f"{file} was divided")
                if left > 0:
                    yield rows(list(held.add(part["_text"])))
        if held is not None:
            yield rows(list(held.rest()), [])

    def beginnings(lines: dict[str, int]) -> DataFrame:
        numbered = [_lines(spark, sizes[file][0], spec).withColumn("_at", F.monotonically_increasing_id()).limit(n) for file, n in lines.items()]
        return reduce(DataFrame.unionByName, [part.sortWithinPartitions("_at").drop("_at") for part in numbered])

    names, found = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"), []
    before = {name: spark.conf.get(name) for name in names}
    try:
        # No file is divided.
        for name in names:
            spark.conf.set(name, str(max((size for _, size in sizes.values()), default=0) + 1))
        files = sorted(sizes)
        for i in range(0, len(files), FILES_AT_ONCE):
            lines = dict.fromkeys(files[i:i + FILES_AT_ONCE], wanted)
            short = lines
            while short:
                # Files that end before their last line asked for are read whole.
                whole = {r[FILE]: r["_starts0"] - r["_shut"] for r in _summaries(beginnings(short), spec).collect() if r["_lines"] == lines[r[FILE]]}
                short = {file: 2 * lines[file] * wanted // max(1, n) for file, n in whole.items() if n < wanted}
                lines |= short
            found.append(cut_lineage(beginnings(lines).mapInArrow(parsed, _row_schema(spec))))
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], _row_schema(spec))


def read_plain(spark: SparkSession, path: str, columns: list[str], delimiter: str = "|", quote: str = '"',
               encoding: str = "UTF-8") -> DataFrame:
    """Every line of a delimited file without a header."""
    spec = TableSpec("plain", tuple(columns), tuple(0 for _ in columns), encoding=encoding,
                     delimiter=delimiter, quote=quote, id=columns[0])
    return read_table(spark, path, spec, header=False)


def ingest_report(rows: DataFrame, spec: TableSpec, id_length: int = ID_LENGTH) -> DataFrame:
    """Per file: rows, malformed rows and rows whose id has the wrong length. Needs ``report=True``."""
    return rows.groupBy(FILE).agg(
        F.count("*").alias("num_rows"),
        F.count(CORRUPT).alias("malformed_rows"),
        F.count_if(F.length(spec.id) != id_length).alias("bad_ids"),
    )


def watched(rows: DataFrame, spec: TableSpec, id_length: int = ID_LENGTH) -> tuple[DataFrame, Observation]:
    """``rows`` with an observation, made while they are written, of the files that have faulty rows. The set is the same however
    often a lost task is repeated, and no longer than the list of files."""
    seen = Observation()
    faulty = F.col(CORRUPT).isNotNull() | (F.length(spec.id) != id_length)
    return rows.observe(seen, F.collect_set(F.when(faulty, F.col(FILE))).alias("faulty")), seen


def watched_report(rows: DataFrame, counts: DataFrame, seen: Observation, spec: TableSpec, id_length: int = ID_LENGTH) -> DataFrame:
    """The report once the watched rows are written: counts from the first pass, and only faulty files are looked into again."""
    faulty = sorted(seen.get["faulty"])
    clean = counts.where(~F.col(FILE).isin(faulty)).select(FILE, "num_rows", F.lit(0).cast("bigint").alias("malformed_rows"), F.lit(0).cast("bigint").alias("bad_ids"))
    if not faulty:
        return clean
    # A filter on the file's path leaves other files unread.
    return clean.unionByName(ingest_report(rows.where(F.col(FILE).isin(faulty)), spec, id_length))


def repaired(names: Sequence[str], id_name: str) -> list[str]:
    """The names of a header, the first one replaced by the id's where it merely contains it (a byte-order mark, junk)."""
    first = [id_name if re.search(re.escape(id_name), n, re.IGNORECASE) else n for n in names[:1]]
    return [*first, *names[1:]]


def read_by_header(spark: SparkSession, path: str, spec: TableSpec, limit: int | None = None) -> DataFrame:
    """The declared columns found by the name that each file's own header gives them, in whatever order; one that a file lacks is empty there.

    Headers are read from the beginnings of the files and repaired, files of one header are read together. A name that stands twice
    means its last column.
    """
    raw = replace(spec, columns=("header",), widths=(0,), text=(), sort=None, id="header")
    beginnings = _first(spark, path, raw, False, 1).select(FILE, F.coalesce(CORRUPT, "header").alias("text")).collect()
    layouts: dict[tuple[str, ...], list[str]] = {}
    for r in beginnings:
        names = repaired(next(csv.reader([r["text"]], delimiter=spec.delimiter, quotechar=spec.quote)), spec.id)
        layouts.setdefault(tuple(names), []).append(r[FILE])
    parts = []
    for names, files in sorted(layouts.items()):
        places = {name: f"c{i}" for i, name in enumerate(names)}
        wide = replace(raw, columns=tuple(f"c{i}" for i in range(len(names))), widths=(0,) * len(names), id="c0")
        rows, _ = scan(spark, path, wide, True, limit)
        found = rows if len(layouts) == 1 else rows.where(F.col(FILE).isin(sorted(files)))
        parts.append(found.select(*[(F.col(places[c]) if c in places else F.lit("")).alias(c) for c in spec.columns]))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], ", ".join(f"`{c}` string" for c in spec.columns))


def write_delimited(df: DataFrame, path: str, delimiter: str = "|", quote: str = '"', encoding: str = "UTF-8",
                    header: bool = False, mode: str = "append") -> None:
    """Append rows as delimited text; quotes are doubled and empty fields stay empty."""
    df.write.mode(mode).options(
        sep=delimiter, quote=quote, escape=quote, encoding=encoding, header=header, emptyValue="", nullValue="",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    ).csv(path)


def read_flags(spark: SparkSession, path: str) -> DataFrame:
    """A comma-separated file of an id column and 0/1 columns, named by its header."""
    rows = spark.read.option("header", True).csv(path)
    return rows.select(rows.columns[0], *[F.col(f"`{c}`").cast("int").alias(c) for c in rows.columns[1:]])
