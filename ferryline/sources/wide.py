"""Lines of text files whose newline is not the byte 0x0A alone (UTF-16, UTF-32, some code pages), split over many tasks.

The files are cut at 0x0A bytes like any other, which says nothing about characters: such a byte may be part of one. So the bytes of each
block of a file are counted first, which gives every block its place in the file, and with it where characters begin. A block is then
cut at the newlines that lie in it whole; what stands before the first and behind the last of them goes to the blocks beside it.
"""

from __future__ import annotations

import codecs
from collections.abc import Iterable, Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..working import written

_MARK = codecs.BOM_UTF8
#: Bytes that are looked at together; longer lines are held whole.
PIECE = 1 << 20
#: Encodings whose byte order the first bytes of a file tell: codecs by mark; without a mark, the machine's.
_ORDERED = {
    "utf-16": {codecs.BOM_UTF16_LE: "utf-16-le", codecs.BOM_UTF16_BE: "utf-16-be"},
    "utf-32": {codecs.BOM_UTF32_LE: "utf-32-le", codecs.BOM_UTF32_BE: "utf-32-be"},
}
_SCHEMA = pa.schema([("file", pa.string()), ("block", pa.int64()), ("i", pa.int64()), ("line", pa.binary()), ("part", pa.int32()), ("closed", pa.bool_()), ("mark", pa.binary())])
_DDL = "file string, block long, i long, line binary, part int, closed boolean, mark binary"


def splittable(encoding: str) -> bool:
    """Whether every character starts at a multiple of the newline's bytes: UTF-16, UTF-32 and code pages of single bytes."""
    name = codecs.lookup(encoding).name
    if name.startswith(("utf-16", "utf-32")):
        return True
    try:
        return len("\n".encode(name)) == 1 and all(len(bytes([b]).decode(name, "replace")) == 1 for b in range(256))
    except (LookupError, ValueError):
        return False


def codec_of(encoding: str, mark: bytes) -> tuple[str, bool]:
    """(codec with its byte order, whether the file begins with a mark that belongs to the encoding)."""
    name = codecs.lookup(encoding).name
    for found, codec in _ORDERED.get(name, {}).items():
        if mark.startswith(found):
            return codec, True
    return {"utf-16": "utf-16-le" if codecs.BOM_UTF16 == codecs.BOM_UTF16_LE else "utf-16-be", "utf-32": "utf-32-le" if codecs.BOM_UTF32 == codecs.BOM_UTF32_LE else "utf-32-be"}.get(name, name), False


def _find(data: bytearray, newline: bytes, at: int, start: int) -> int:
    """End of the first newline from ``start`` that begins where a character does, or -1; ``at``: the place of ``data`` in the file."""
    k = data.find(newline, start)
    while k >= 0 and (at + k) % len(newline):
        k = data.find(newline, k + 1)
    return k + len(newline) if k >= 0 else -1


def _find_last(data: bytearray, newline: bytes, at: int, start: int) -> int:
    k = data.rfind(newline, start)
    while k >= 0 and (at + k) % len(newline):
        k = data.rfind(newline, start, k + len(newline) - 1)
    return k + len(newline) if k >= 0 else -1


def cut_block(chunks: Iterable[bytes], at: int, newline: bytes) -> Iterator[tuple[int | None, bytes, bool]]:
    """(part, bytes, closed) of one block, whose first byte is byte ``at`` of the file.

    Part 0 is what stands up to the first newline that lies in the block whole, closed unless there is none; None whole
    lines; part 1 what stands behind the last newline. The first block of a file has no part 0, and a block without a newline no part 1.
    """
    data, seen, looked = bytearray(), at == 0, 0
    for chunk in chunks:
        data += chunk
        end = _find_last(data, newline, at, max(0, looked - len(newline)))
        looked = len(data)
        if end < 0:
            continue
        start = 0
        if not seen:
            start, seen = _find(data, newline, at, 0), True
            yield 0, bytes(data[:start]), True
        if end > start:
            yield None, bytes(data[start:end]), True
        del data[:end]
        at, looked = at + end, len(data)
    yield (1 if seen else 0), bytes(data), False


def _chunks(rows: Iterator[tuple], lost: bool, extra: bool) -> Iterator[bytes]:
    """The bytes of a block in pieces: its lines with the newline byte between them, with a mark that the scan left out, without a last byte that isn't there."""
    held, size = [_MARK] if lost else [], 0
    for *_, line in rows:
        if size >= PIECE:
            yield b"".join(held)
            held, size = [], 0
        held += [line, b"\n"]
        size += len(line) + 1
    yield b"".join(held[:-1] if extra else held)


def _read(data: bytes, codec: str, marked: bool, physical_lines) -> list[bytes]:
    try:
        text = data.decode(codec)
    except UnicodeDecodeError:
        return [b"\xff"]
    return physical_lines((text.removeprefix("\ufeff") if marked else text).encode())


def wide_lines(raw: DataFrame, encoding: str, in_order, physical_lines) -> DataFrame:
    """(file, block, i, line): the physical lines of ``raw(file, block, size, line)``, in UTF-8, of a ``splittable`` encoding.

    Lines in order within a block; blocks are numbered anew, in their order, so that what crosses blocks is a block of its own. A stretch of bytes that the
    encoding does not have comes as the line 0xFF, which no reader decodes.
    """
    newline = "\n".encode(codec_of(encoding, b"")[0])
    raw = raw.withColumn("i", F.monotonically_increasing_id())
    blocks = raw.groupBy("file", "block").agg(F.sum(F.octet_length("line") + 1).alias("n"), F.max("size").alias("size"), F.min_by(F.substring("line", 1, 4), "i").alias("head"))
    over, before = W.partitionBy("file"), W.partitionBy("file").orderBy("block")
    placed = blocks.withColumns({"all": F.sum("n").over(over), "mark": F.first("head").over(before), "first": F.row_number().over(before) == 1, "last": F.lead("block").over(before).isNull()})
    lost = F.when(F.col("all") < F.col("size"), F.lit(len(_MARK))).otherwise(F.lit(0))
    at = F.coalesce(F.sum("n").over(before.rowsBetween(W.unboundedPreceding, -1)) + lost, F.lit(0))
    mark = F.when(lost > 0, F.lit(b"")).otherwise(F.col("mark")).alias("mark")
    placed = placed.select("file", "block", mark, at.alias("at"), ((lost > 0) & F.col("first")).alias("lost"), (F.col("last") & (F.col("all") + lost == F.col("size") + 1)).alias("extra"))
    placed, _ = written(placed, "places")

    def cut(batches: Iterator[pa.RecordBatch], edges: bool) -> Iterator[pa.RecordBatch]:
        def lines() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("file", "block", "mark", "at", "lost", "extra", "line")), strict=True)

        def batch_of(file: str, block: int, i: int, some: list[bytes], part: int | None, closed: bool, mark: bytes) -> pa.RecordBatch:
            n = len(some)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(([file] * n, [block] * n, range(i, i + n), some, [part] * n, [closed] * n, [mark] * n), _SCHEMA, strict=True)], schema=_SCHEMA)

        for (file, block, mark, at, lost, extra), rows in groupby(lines(), key=lambda r: r[:6]):
            codec, marked = codec_of(encoding, mark)
            i = 0
            for part, data, closed in cut_block(_chunks(rows, lost, extra), at, newline if codec == codec_of(encoding, b"")[0] else "\n".encode(codec)):
                if part is None:
                    if not edges:
                        found = _read(data, codec, marked and at == 0 and i == 0, physical_lines)
                        yield batch_of(file, 2 * block, i, found, None, True, b"")
                        i += len(found)
                    else:
                        i += 1
                elif edges:
                    # ``i`` tells whether the first block of a file has whole lines.
                    yield batch_of(file, block, i, [data], part, closed, mark)

    ordered = in_order(raw, placed).select("file", "block", "mark", "at", "lost", "extra", "line")
    inside = ordered.mapInArrow(lambda batches: cut(batches, False), _DDL).select("file", "block", "i", "line")
    edges = ordered.mapInArrow(lambda batches: cut(batches, True), _DDL)
    # What stands behind the last newline of a block goes on until a block that has a newline.
    since = F.last(F.when(F.col("part") == 1, F.struct("block", (F.col("i") == 0).alias("bare"))), ignorenulls=True)
    chains = edges.withColumn("since", since.over(W.partitionBy("file").orderBy("block", "part")))
    whole = chains.groupBy("file", "since").agg(F.array_sort(F.collect_list(F.struct("block", "part", "line"))).alias("parts"), F.first("mark").alias("mark"))

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, since, parts, mark in zip(batch["file"], batch["since"], batch["parts"], batch["mark"], strict=True):
                codec, marked = codec_of(encoding, mark)
                first = since["block"] == 0 and since["bare"]
                found = _read(b"".join(p["line"] for p in parts), codec, marked and first, physical_lines)
                yield pd.DataFrame({"file": file, "block": 0 if first else 2 * since["block"] + 1, "i": range(len(found)), "line": found})

    across, _ = written(whole.mapInPandas(joined, "file string, block long, i long, line binary"), "across")
    return inside.unionByName(across.repartition("file", "block").sortWithinPartitions("file", "block", "i"))
