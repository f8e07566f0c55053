"""Typed tables, cell tables of workbooks, routing and fingerprints of files, previews."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.text import strip
from .delimited import drop_blank_rows, listed_files, normalize_headers, raw_lines

#: Formats by extension, and those that hold tables.
FORMATS = {".csv": "csv", ".txt": "txt", ".xlsx": "xlsx", ".xlsm": "xlsx", ".docx": "docx", ".pdf": "pdf", ".png": "image", ".jpg": "image", ".jpeg": "image", ".tif": "image", ".tiff": "image"}
TABULAR = ("csv", "xlsx")
_MARK = b"\xef\xbb\xbf"


def _text_of(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        return strip(c)
    if isinstance(kind, T.BooleanType):
        return F.when(c, "true").when(~c, "false")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        ntz = c.cast("timestamp_ntz")
        whole = F.date_trunc("DAY", ntz).cast("timestamp_ntz") == ntz
        seconds = F.date_trunc("SECOND", ntz).cast("timestamp_ntz") == ntz
        return F.when(whole, F.date_format(ntz, "yyyy-MM-dd")).when(seconds, F.date_format(ntz, "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format(ntz, "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        integral = (c == F.floor(c)) & (F.abs(c) < 1e18)
        return F.when(integral, c.try_cast("decimal(38,0)").cast("string")).otherwise(c.cast("string"))
    return c.cast("string")


def coerce_to_text(df: DataFrame) -> DataFrame:
    """Every column as stable text: trimmed or null, true/false, ISO dates and times, integral doubles as integers."""
    return df.select(*(_text_of(df[f"`{f.name}`"], f.dataType).alias(f.name) for f in df.schema.fields))


def records_from_cells(cells: DataFrame, sheet: str | None = None, header_row: int = 1) -> DataFrame:
    """Records of one sheet of each workbook from a cell table (file, sheet, sheet_pos, row, col, value).

    The first sheet of a workbook is the default; a sheet that no workbook has is an error that lists the options. The header
    is in sheet row ``header_row`` of each workbook; rows below it become records with _src_file, _sheet and _row and one column
    per distinct header name. A cell without a name has none; of several cells in one place, the last text counts.
    """
    if header_row < 1:
        raise ValueError("the header row counts from 1")
    if sheet is None:
        first = cells.groupBy("file").agg(F.min_by("sheet", "sheet_pos").alias("own")).select(F.col("file").alias("own_file"), "own")
        own = cells.join(first, (F.col("file") == F.col("own_file")) & (F.col("sheet") == F.col("own"))).drop("own_file", "own")
    else:
        own = cells.where(F.col("sheet") == sheet)
        if own.isEmpty():
            raise ValueError(f"no sheet {sheet!r}; there are {sorted(r[0] for r in cells.select('sheet').distinct().collect())}")
    head = normalize_headers(own.where(F.col("row") == header_row).select("file", F.col("col").alias("idx"), F.col("value").alias("name")))
    # Distinct column names over all workbooks: the width of the result, not its rows.
    names = [r[0] for r in head.groupBy("column_name").agg(F.min("idx").alias("i")).orderBy("i", "column_name").select("column_name").collect()]
    if not names:
        raise ValueError(f"no header in row {header_row}")
    named = own.where(F.col("row") > header_row).join(head.select(F.col("file").alias("h_file"), "idx", "column_name"), (F.col("file") == F.col("h_file")) & (F.col("col") == F.col("idx")))
    wide = named.groupBy("file", "sheet", "row").pivot("column_name", names).agg(F.max(strip(F.col("value"))))
    return drop_blank_rows(wide.select(F.col("file").alias("_src_file"), F.col("sheet").alias("_sheet"), F.col("row").cast("long").alias("_row"), *(F.col(f"`{n}`") for n in names)))


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt by ``key`` to four tasks for each core, or as many as it is read in if these are more.

    A join on ``key`` takes this as its own exchange. A stated number of partitions is not merged at run time: the rows that come out of
    the join are few bytes but long work, and merged by bytes they would be left to few tasks.
    """
    return df.repartition(max(4 * df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()), key)


def route_sources(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, format, tabular); format is null for unsupported extensions. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select(F.col("path").alias("file"))
    extension = F.lower(F.regexp_extract("file", r"(\.[^./]*)$", 1))
    kind = F.coalesce(*(F.when(extension == x, f) for x, f in FORMATS.items()))
    return files.select("file", kind.alias("format"), kind.isin(*TABULAR).alias("tabular"))


def fingerprint(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, sha256) of the files' bytes, which no row holds whole.

    A digest needs a file's bytes in order: its blocks are read by many tasks as lines, which meet in one task per file, sorted on
    disk where they don't fit, and go through the digest one batch after the other. The reader leaves out a byte order mark, and whether
    the last line ends in a newline can't be seen from the lines; the size of the file tells both.
    """

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, size, n, mark = None, 0, 0, b""
        #: The bytes so far, without and with a newline behind the last line.
        digest = newline = None

        def done() -> pa.RecordBatch:
            ended = digest if n + len(mark) == size + 1 else newline
            return pa.RecordBatch.from_arrays([pa.array([now]), pa.array([ended.hexdigest()])], names=["file", "sha256"])

        for batch in batches:
            for file, total, lost, line in zip(*(batch.column(c).to_pylist() for c in ("file", "size", "lost", "line")), strict=True):
                if file != now:
                    if now is not None:
                        yield done()
                    now, size, digest, n, newline = file, total, hashlib.sha256(_MARK if lost else b""), 0, None
                    mark = _MARK if lost else b""
                if newline is not None:
                    digest = newline
                digest.update(line)
                newline = digest.copy()
                newline.update(b"\n")
                n += len(line) + 1
        if now is not None:
            yield done()

    lines = raw_lines(spark, paths)
    numbered = lines.withColumn("i", F.monotonically_increasing_id())
    # A mark of three bytes is missing where the lines and their newlines are fewer than the file has bytes.
    lost = numbered.groupBy("file").agg(F.sum(F.octet_length("line") + 1).alias("n"), F.max("size").alias("total")).select(F.col("file").alias("of"), (F.col("n") < F.col("total")).alias("lost"))
    ordered = numbered.join(lost, F.col("file") == F.col("of")).select("file", "size", "lost", "block", "i", "line").repartition("file").sortWithinPartitions("file", "block", "i")
    found = ordered.select("file", "size", "lost", "line").mapInArrow(digested, "file string, sha256 string")
    # Files without lines are empty, or hold a byte order mark alone; scans leave empty ones out. Contents are not read here.
    some = spark.read.format("binaryFile").load(paths).select(F.col("_metadata.file_path").alias("file"), F.lit(hashlib.sha256(_MARK).hexdigest()).alias("mark_alone"))
    every = listed_files(spark, paths).join(found, "file", "left").join(some, "file", "left")
    return every.select("file", F.coalesce("sha256", "mark_alone", F.lit(hashlib.sha256(b"").hexdigest())).alias("sha256"))


def inspect_table(df: DataFrame, ord: str = "_row", limit: int = 10) -> tuple[list[str], DataFrame]:
    """Column names and the first records."""
    return [c for c in df.columns if not c.startswith("_")], df.orderBy(ord).limit(limit)


def inspect_pages(pages: DataFrame, limit: int = 2000) -> DataFrame:
    """(_src_file, n_pages, preview): the first characters of each document.

    The pages of a document go by in order with the length of those before them; pages whose separator starts behind the limit are dropped, and others
    cut, before any are put together.
    """
    counted = pages.groupBy("_src_file").agg(F.count("*").alias("n_pages"))
    kept = pages.where(strip(F.col("text")).isNotNull())
    before = F.coalesce(F.sum(F.length("text") + 2).over(W.partitionBy("_src_file").orderBy("page", "text").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    near = kept.withColumn("before", before).where(F.col("before") - 2 < limit).select("_src_file", "before", F.substring("text", 1, limit).alias("text"))
    joined = near.groupBy("_src_file").agg(F.array_sort(F.collect_list(F.struct("before", "text"))).alias("p")).select(F.col("_src_file").alias("of"), F.substring(F.array_join(F.transform("p", lambda x: x["text"]), "\n\n"), 1, limit).alias("preview"))
    return counted.join(joined, F.col("_src_file") == F.col("of"), "left").select("_src_file", "n_pages", F.coalesce("preview", F.lit("")).alias("preview"))


def document_text(pages: DataFrame) -> DataFrame:
    """(_src_file, n_pages, text): non-empty pages in order, joined by a blank line."""
    ordered = F.array_sort(F.collect_list(F.struct("page", "text")))
    grouped = pages.groupBy("_src_file").agg(F.count("*").alias("n_pages"), ordered.alias("p"))
    kept = F.filter("p", lambda x: strip(x["text"]).isNotNull())
    return grouped.select("_src_file", "n_pages", F.array_join(F.transform(kept, lambda x: x["text"]), "\n\n").alias("text"))
