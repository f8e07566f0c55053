"""Delimited text files of any size: reading options per file, then exact rows with their line numbers.

Files are read as lines of bytes, cut at newline bytes alone, so line ends inside cells stay as they are and a large file is
split over many tasks. Whether a line starts inside quotes depends on all lines before it; so each block of a file first tells, for
either state at its start, in which state it ends and how many records begin in it, for every delimiter that may turn out to be the file's.
Put together in the order of the blocks, this gives every block its first state, line and record. The header is then the record with its
number, in whatever block, and the blocks are parsed on their own. A record that crosses blocks is put together from its parts.
"""

from __future__ import annotations

import codecs
import csv
import re
import sys
from collections.abc import Iterator
from functools import cache
from itertools import chain, groupby, islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..working import written
from .wide import splittable, wide_lines

#: Encodings in the order of trial, delimiters, characters looked at.
ENCODINGS = ("utf-8-sig", "utf-8", "cp1252", "latin-1")
DELIMITERS = ",;\t|"
SNIFFED = 8192
#: Files or blocks whose options are broadcast; more are joined by a shuffle, after which the lines are put in order again.
BROADCAST_ROWS = 100_000

#: Cells may be of any size.
csv.field_size_limit(sys.maxsize)


def decode(data: bytes, encoding: str | None, errors: str = "strict") -> tuple[str, str]:
    """(text with newlines as \\n, encoding used); LookupError and UnicodeDecodeError pass through."""
    for name in (encoding,) if encoding else ENCODINGS:
        try:
            text = data.decode(codecs.lookup(name).name, errors)
        except UnicodeDecodeError:
            if encoding:
                raise
            continue
        return text.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n"), name
    raise AssertionError("latin-1 decodes everything")


def sniff_delimiter(text: str) -> str:
    head = text[:SNIFFED]
    try:
        return csv.Sniffer().sniff(head, DELIMITERS).delimiter if head.strip() else ","
    except csv.Error:
        return ","


@cache
def _closed(delimiter: str) -> tuple[re.Pattern, re.Pattern]:
    """A line whose quotes are closed at its end, for lines that begin outside and inside quotes, as the csv reader sees them."""
    d = re.escape(delimiter)
    rest = rf'[^{d}]*+(?:{d}(?:"(?:[^"]|"")*+"|(?!"))[^{d}]*+)*+'
    return re.compile(rf'(?:"(?:[^"]|"")*+"|(?!")){rest}', re.S), re.compile(rf'(?:[^"]|"")*+"{rest}', re.S)


def ends_open(line: str, opened: bool, delimiter: str) -> bool:
    """Whether quotes are open behind ``line``; ``opened``: whether they are before it."""
    if '"' not in line:
        return opened
    return _closed(delimiter)[opened].fullmatch(line) is None


def _cells(found: list[str]) -> list[str | None]:
    return [c.strip() or None for c in found]


def _wide(encoding: str | None) -> bool:
    """Whether a newline is more than one byte, so that bytes can't be cut at it. An unknown encoding is reported later."""
    try:
        return encoding is not None and "\n".encode(encoding).removeprefix(codecs.BOM_UTF8) != b"\n"
    except LookupError:
        return False


#: A line with its end: newline, carriage return, or both.
_PHYSICAL = re.compile(rb"[^\r\n]*+(?:\r\n|\r|\n)|[^\r\n]++")


def physical_lines(data: bytes) -> list[bytes]:
    """The lines of ``data`` with their ends, as a file opened with newline="" gives them."""
    return _PHYSICAL.findall(data)


def raw_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, block, size, line): the bytes between newline bytes, the lines of a block of a file in order; size is the file's.

    A file without newline bytes, such as one that ends its lines with carriage returns only, is one line and read by one task.
    """
    lines = spark.read.option("lineSep", "\n").text(paths)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("line"))


def listed_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file) for all files, as _metadata.file_path has them: scans leave empty files out, the listing that the reader has made does not."""
    return spark.createDataFrame([(re.sub(r"^(\w+):///", r"\1:/", f),) for f in spark.read.text(paths).inputFiles()], "file string")


def _lines(spark: SparkSession, paths: str | list[str], encoding: str | None, only: DataFrame | None = None) -> DataFrame:
    """(file, block, i, line): the bytes of every physical line with its end, numbered from 0 in its block of the file.

    Files in encodings with wide newlines are cut by ``wide_lines``, or, where characters have no fixed places, come as one block each, always all of them.
    ``only(file, block)``, which must be small, names the blocks that are wanted of other files.
    """
    names = ["file", "block", "i", "line"]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("file").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    lines = physical_lines(content.decode(codecs.lookup(encoding).name).removeprefix("\ufeff").encode())
                except UnicodeDecodeError:
                    lines = [b"\xff"]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(lines), pa.string()), pa.array([0] * len(lines), pa.int64()), pa.array(range(len(lines)), pa.int64()), pa.array(lines, pa.binary())], names=names)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, count = None, 0
        for batch in batches:
            files, blocks = batch.column("file").to_pylist(), batch.column("block").to_pylist()
            lines = [line + b"\n" for line in batch.column("line").to_pylist()]
            # A carriage return that no newline follows ends a line too.
            if any(b"\r" in line[:-2] for line in lines):
                cut = [physical_lines(line) for line in lines]
                files, blocks = ([x for x, many in zip(column, cut, strict=True) for _ in many] for column in (files, blocks))
                lines = [line for many in cut for line in many]
            numbers = []
            for key in zip(files, blocks, strict=True):
                now, count = (now, count + 1) if key == now else (key, 0)
                numbers.append(count)
            yield pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(blocks, pa.int64()), pa.array(numbers, pa.int64()), pa.array(lines, pa.binary())], names=names)

    schema = "file string, block long, i long, line binary"
    if _wide(encoding) and splittable(encoding):
        return wide_lines(raw_lines(spark, paths), encoding, _in_order, physical_lines)
    if _wide(encoding):
        return spark.read.format("binaryFile").load(paths).select(F.col("_metadata.file_path").alias("file"), "content").mapInArrow(whole, schema)
    lines = raw_lines(spark, paths).drop("size")
    # A broadcast keeps the lines in order.
    return (lines if only is None else lines.join(F.broadcast(only), ["file", "block"], "left_semi")).mapInArrow(numbered, schema)


def _in_order(lines: DataFrame, table: DataFrame) -> DataFrame:
    """``lines`` with the columns of ``table(file, block, ...)``, the lines of a block still in order and in one task."""
    if table.count() <= BROADCAST_ROWS:
        return lines.join(F.broadcast(table), ["file", "block"])
    return lines.join(table, ["file", "block"]).repartition("file", "block").sortWithinPartitions("file", "block", "i")


def _decodes(data: bytes, encoding: str) -> bool:
    try:
        data.decode(encoding)
    except UnicodeDecodeError:
        return False
    return True


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[str, int, int, list[bytes]]]:
    """(file, block, first line's number, lines) of each block in a batch; a new block starts with i = 0."""
    files, blocks, numbers, lines = (batch.column(c).to_pylist() for c in ("file", "block", "i", "line"))
    starts = [k for k, i in enumerate(numbers) if k == 0 or i == 0]
    for lo, hi in zip(starts, [*starts[1:], len(lines)]):
        yield files[lo], blocks[lo], numbers[lo], lines[lo:hi]


def _through(lines: list[bytes], quoted: list[tuple[int, str]], delimiter: str) -> tuple[list[bool], list[int]]:
    """For either state before ``lines``: the state behind them, and the records that begin in them. ``quoted`` are the lines with quotes."""
    ends, begun = [], []
    for state in (False, True):
        n, at = 0, 0
        for k, text in quoted:
            n += 0 if state else k - at
            n += not state
            state, at = ends_open(text, state, delimiter), k + 1
        ends.append(state)
        begun.append(n + (0 if state else len(lines) - at))
    return ends, begun


def _looked_at(explicit: str | None, delimiter: str | None):
    """One row for each piece of a block: which encodings fit, the head of the file, and the states by delimiter."""
    cuts = [delimiter] if delimiter else list(DELIMITERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, block, i, lines in _pieces(batch):
                data = b"".join(lines)
                fits = [_decodes(data, e) for e in ("utf-8", "cp1252", explicit or "latin-1")]
                readable = explicit if explicit and fits[2] else "utf-8" if fits[0] else "cp1252" if fits[1] else "latin-1"
                quoted = [(k, line.decode(readable).removeprefix("\ufeff")) for k, line in enumerate(lines) if b'"' in line]
                states = [_through(lines, quoted, cut) for cut in cuts]
                columns = [[file], [block], [i], [data[: 4 * SNIFFED] if block == 0 and i < SNIFFED else None], *([x] for x in fits), [len(lines)], [[x for ends, _ in states for x in ends]], [[x for _, begun in states for x in begun]]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PIECE, strict=True)], schema=_PIECE)

    return run


_PIECE = pa.schema([("file", pa.string()), ("block", pa.int64()), ("i", pa.int64()), ("head", pa.binary()), ("utf8", pa.bool_()), ("cp1252", pa.bool_()), ("named", pa.bool_()), ("lines", pa.int64()), ("ends", pa.list_(pa.bool_())), ("begun", pa.list_(pa.int64()))])
_PIECE_DDL = "file string, block long, i long, head binary, utf8 boolean, cp1252 boolean, named boolean, lines long, ends array<boolean>, begun array<long>"
_STATES = "file string, block long, encoding string, delimiter string, problem string, opened boolean, lines_before long, records_before long, begun long, ends_open boolean"


def _folded(encoding: str | None, explicit: str | None, delimiter: str | None):
    """S2, S3 and the state at the start of each block of a file, from its pieces."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["block", "i"])
        used = encoding or (ENCODINGS[0] if group["utf8"].all() else "cp1252" if group["cp1252"].all() else "latin-1")
        problem = None if group["named"].all() else f"UnicodeDecodeError: not all bytes are {encoding}"
        head = b"".join(x for x in group["head"] if x is not None)[: 4 * SNIFFED]
        cut = delimiter or sniff_delimiter(decode(head, "utf-8" if _wide(encoding) else explicit or used, "ignore")[0])
        k = 0 if delimiter else DELIMITERS.index(cut)
        opened, n_lines, n_records, out = False, 0, 0, []
        for row in group.itertuples():
            if row.i == 0:
                out.append([row.file, row.block, used, cut, problem, opened, n_lines, n_records, 0, opened])
            begun = int(row.begun[2 * k + opened])
            opened, n_lines, n_records = bool(row.ends[2 * k + opened]), n_lines + row.lines, n_records + begun
            out[-1][-2:] = [out[-1][-2] + begun, opened]
        return pd.DataFrame(out, columns=["file", "block", "encoding", "delimiter", "problem", "opened", "lines_before", "records_before", "begun", "ends_open"])

    return run


_RECORDS = pa.schema([("file", pa.string()), ("record", pa.int64()), ("line", pa.int64()), ("cells", pa.list_(pa.string())), ("block", pa.int64()), ("part", pa.string()), ("delimiter", pa.string())])


def _block_records(rows: Iterator[tuple], first: dict) -> Iterator[tuple]:
    """The records of one block, whose lines come one by one; a record that began before it or ends behind it comes as ``part``."""
    file, block, cut = first["file"], first["block"], first["delimiter"]
    encoding = "utf-8" if _wide(first["encoding"]) or first["encoding"] == ENCODINGS[0] else first["encoding"]
    taken, held = 0, []

    def texts() -> Iterator[str]:
        nonlocal taken
        for line in rows:
            text = line.decode(encoding)
            if block == 0 and not taken:
                text = text.removeprefix("\ufeff")
            taken += 1
            held.append(text)
            yield text

    lines, record = texts(), first["records_before"]
    if first["opened"]:
        for text in lines:
            if not ends_open(text, True, cut):
                break
        yield file, record, first["lines_before"] + taken, None, block, "".join(held), cut
        held.clear()
    waiting = None
    for cells in csv.reader(lines, delimiter=cut):
        if waiting:
            yield (*waiting, None, cut)
        record += 1
        waiting, raw = (file, record, first["lines_before"] + taken, _cells(cells), block), held.copy()
        held.clear()
    if waiting and first["ends_open"]:
        yield (*waiting[:3], None, block, "".join(raw), cut)
    elif waiting:
        yield (*waiting, None, cut)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys = ("encoding", "delimiter", "opened", "lines_before", "records_before", "ends_open")

    def lines() -> Iterator[tuple[int, dict, bytes]]:
        number = -1
        for batch in batches:
            at = 0
            for file, block, i, piece in _pieces(batch):
                if i == 0 or number < 0:
                    number += 1
                first = {"file": file, "block": block, **{k: batch.column(k)[at].as_py() for k in keys}}
                at += len(piece)
                for line in piece:
                    yield number, first, line

    def records() -> Iterator[tuple]:
        for _, rows in groupby(lines(), key=lambda x: x[0]):
            _, first, line = next(rows)
            yield from _block_records(chain([line], (x[2] for x in rows)), first)

    found = records()
    while some := list(islice(found, 8192)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), _RECORDS, strict=True)], schema=_RECORDS)


def _records(lines: DataFrame) -> DataFrame:
    """(file, record, line, cells): every record with its number and last physical line, both from 1."""

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cells = [_cells(next(csv.reader([x.decode() for x in physical_lines("".join(parts).encode())], delimiter=cut), [])) for parts, cut in zip(batch["parts"], batch["delimiter"], strict=True)]
            yield pd.DataFrame({"file": batch["file"], "record": batch["record"], "line": batch["line"], "cells": cells})

    found = lines.mapInArrow(_parsed, "file string, record long, line long, cells array<string>, block long, part string, delimiter string")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("block", "part"))), lambda x: x["part"])
    across = found.where("cells is null").groupBy("file", "record").agg(F.max("line").alias("line"), parts.alias("parts"), F.first("delimiter").alias("delimiter"))
    return found.where("cells is not null").select("file", "record", "line", "cells").unionByName(across.mapInPandas(joined, "file string, record long, line long, cells array<string>"))


def _known(spark: SparkSession, paths: str | list[str], header_row: int, encoding: str | None, delimiter: str | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(options, lines, start of each block of readable files); the last is written once."""
    try:
        explicit, unknown = encoding and codecs.lookup(encoding).name, None
    except LookupError as error:
        explicit, unknown = None, f"LookupError: {error}"
    explicit = "utf-8" if _wide(encoding) else explicit
    lines = _lines(spark, paths, encoding)
    pieces = lines.mapInArrow(_looked_at(explicit, delimiter), _PIECE_DDL)
    states, _ = written(pieces.groupBy("file").applyInPandas(_folded(None if unknown else encoding, explicit, delimiter), _STATES), "states")
    every = listed_files(spark, paths)
    read_as = states.where("block = 0").select("file", "encoding", "delimiter", "problem")
    options = every.join(read_as, "file", "left")
    if unknown:
        options = options.select("file", F.lit(None).cast("string").alias("encoding"), F.lit(None).cast("string").alias("delimiter"), F.lit(unknown).alias("problem"))
        states = states.where("false")
    else:
        options = options.select("file", F.when(F.col("problem").isNull(), F.coalesce("encoding", F.lit(encoding or ENCODINGS[0]))).alias("encoding"), F.when(F.col("problem").isNull(), F.coalesce("delimiter", F.lit(delimiter or ","))).alias("delimiter"), "problem")
    starts = states.where("problem is null").drop("problem")
    # The record with the header's number, wherever it is: the block in which it begins and those it goes on in.
    before, until = F.col("records_before"), F.col("records_before") + F.col("begun")
    holding = starts.where(((before < header_row) & (until >= header_row)) | ((before == header_row) & F.col("opened")))
    few = holding.select("file", "block") if holding.count() <= BROADCAST_ROWS else None
    near = lines if few is None or _wide(encoding) else _lines(spark, paths, encoding, few)
    header, _ = written(_records(_in_order(near, holding)).where(F.col("record") == header_row).select("file", F.col("cells").alias("header")), "headers")
    missing = F.lit("ValueError: the header row counts from 1") if header_row < 1 else F.when(F.coalesce(F.size("header"), F.lit(0)) < 1, F.lit(f"ValueError: no header in row {header_row}"))
    options = options.join(header, "file", "left").withColumn("problem", F.coalesce("problem", missing))
    warning = F.when(F.col("problem").isNull() & (F.col("encoding") != ENCODINGS[0]), F.concat(F.lit("read as "), "encoding")) if encoding is None else F.lit(None).cast("string")
    return options.select("file", "encoding", "delimiter", F.when(F.col("problem").isNull(), F.col("header")).alias("header"), warning.alias("warning"), "problem"), lines, starts


def infer_read_options(spark: SparkSession, paths: str | list[str], header_row: int = 1, encoding: str | None = None, delimiter: str | None = None) -> DataFrame:
    """(file, encoding, delimiter, header, warning, problem), one row per file.

    A problem (unknown encoding, undecodable bytes anywhere in the file, header row below 1, missing or without cells) concerns the file,
    not the job. A warning says that the first encoding did not fit.
    """
    return _known(spark, paths, header_row, encoding, delimiter)[0]


def normalize_headers(file_columns: DataFrame) -> DataFrame:
    """``(file, idx, name)`` with column_name and warning, for all files at once.

    Inner white space collapses; a blank name becomes coluna_{i}; the k-th repeat of a name becomes "name (k)".
    """
    bare = F.trim(F.regexp_replace(F.coalesce("name", F.lit("")), r"(?U)[\s\x1c-\x1f]+", " "))
    named = file_columns.withColumn("base", F.when(bare == "", F.concat(F.lit("coluna_"), F.col("idx").cast("string"))).otherwise(bare)).withColumn("blank", bare == "")
    k = F.row_number().over(W.partitionBy("file", "base").orderBy("idx"))
    named = named.withColumn("k", k)
    final = F.when(F.col("k") > 1, F.concat(F.col("base"), F.lit(" ("), F.col("k").cast("string"), F.lit(")"))).otherwise(F.col("base"))
    warning = F.when(F.col("blank"), F.concat(F.lit("blank header in column "), F.col("idx").cast("string"))).when(F.col("k") > 1, F.concat(F.lit("repeated header "), F.col("base")))
    return named.select("file", "idx", "name", final.alias("column_name"), warning.alias("warning"))


def read_delimited(spark: SparkSession, paths: str | list[str], header_row: int = 1, encoding: str | None = None, delimiter: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, file report). Rows have one column per distinct header name, _src_file, _sheet and _row.

    Line ends inside cells stay as they are in the file. Rows of only nulls are dropped and numbering goes on; short rows are padded, extra cells left out; blank cells are
    null; of columns whose names are equal after renaming, the last one counts. Cells may be of any size. The report is (file, encoding,
    delimiter, warning, problem), one row per warning or problem and one per file; a file with a problem has no rows.
    """
    options, lines, states = _known(spark, paths, header_row, encoding, delimiter)
    headers = normalize_headers(options.where("header is not null").select("file", F.posexplode("header").alias("at", "name")).select("file", (F.col("at") + 1).alias("idx"), "name"))
    # Distinct column names over all files: the width of the result, not its rows.
    names = [r[0] for r in headers.groupBy("column_name").agg(F.min("idx").alias("i")).orderBy("i", "column_name").select("column_name").collect()]
    last = headers.groupBy("file", "column_name").agg(F.max("idx").alias("idx"))
    places = last.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("column_name", "idx"))).alias("places")).withColumnRenamed("file", "p_file")
    records = _records(_in_order(lines, states.drop("begun"))).where(F.col("record") > header_row)
    joined = records.join(places, F.col("file") == F.col("p_file"))
    rows = joined.select(F.col("file").alias("_src_file"), F.lit(None).cast("string").alias("_sheet"), F.col("line").alias("_row"), *(F.get("cells", F.try_element_at("places", F.lit(n)) - 1).alias(n) for n in names))
    none = F.lit(None).cast("string")
    warnings = headers.where("warning is not null").select("file", none.alias("encoding"), none.alias("delimiter"), "warning", none.alias("problem"))
    report = options.select("file", "encoding", "delimiter", "warning", "problem").unionByName(warnings)
    return drop_blank_rows(rows), report


def drop_blank_rows(rows: DataFrame) -> DataFrame:
    """Rows whose data columns are all null go; numbering stays."""
    data = [c for c in rows.columns if c not in ("_src_file", "_sheet", "_row")]
    return rows.dropna(how="all", subset=data) if data else rows
