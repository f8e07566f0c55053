"""Free text as pages, blocks and labelled records."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.patterns import assess_text
from ..functions.text import strip
from .delimited import decode
from .tables import document_text

LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
MAX_LABEL = 60


def read_text_documents(spark: SparkSession, paths: str | list[str], encoding: str | None = None) -> DataFrame:
    """(_src_file, page, text, origin, warning): each file is one page; blank text is only a warning."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    text, _ = decode(content, encoding)
                    rows.append((path, 1, text, "native", None if text.strip() else "no text"))
                except (LookupError, ValueError) as error:
                    rows.append((path, 1, None, "native", f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(rows, columns=["_src_file", "page", "text", "origin", "warning"])

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(run, "_src_file string, page int, text string, origin string, warning string")


def page_blocks(pages: DataFrame, mode: str = "page", separator: str | None = None) -> DataFrame:
    """(_src_file, origin, block). ``page``: each page; ``separator``: the whole text split by a
    regular expression without capture groups, lines matching one by one; origin is the position from 1."""
    if mode == "page":
        return pages.select("_src_file", F.col("page").cast("int").alias("origin"), F.col("text").alias("block"))
    if mode != "separator" or not separator:
        raise ValueError("mode is page, or separator with a regular expression")
    parts = F.split("text", f"(?md){separator}")
    return document_text(pages).select("_src_file", F.posexplode(parts).alias("at", "block")).select("_src_file", (F.col("at") + 1).alias("origin"), "block")


def labelled_records(blocks: DataFrame, labels: list[str] | None = None, sep: str = ":") -> DataFrame:
    """(_src_file, _row, labels map), or one column per requested label: the first value of each label.

    A label is what stands before the first separator of a line, trimmed, 1 to 60 characters; its value what follows, trimmed or
    null. Blocks without a label are dropped; ``without_records`` lists documents that have none at all.
    """
    lines = blocks.select("_src_file", "origin", F.posexplode(F.split("block", LINE_BREAK)).alias("line_no", "line"))
    at = F.instr("line", sep)
    pairs = lines.where(at > 0).select("_src_file", "origin", "line_no", strip(F.substr("line", F.lit(1), at - 1)).alias("label"), strip(F.substr("line", at + len(sep))).alias("value"))
    pairs = pairs.where(F.length("label").between(1, MAX_LABEL))
    # A struct keeps a null value of the first line from being skipped.
    first = pairs.groupBy("_src_file", "origin", "label").agg(F.min_by(F.struct("value"), "line_no").alias("v"))
    rows = first.groupBy("_src_file", "origin").agg(F.map_from_entries(F.collect_list(F.struct("label", F.col("v.value")))).alias("labels")).select("_src_file", F.col("origin").cast("long").alias("_row"), "labels")
    if labels is None:
        return rows
    return rows.select("_src_file", F.lit(None).cast("string").alias("_sheet"), "_row", *(F.try_element_at("labels", F.lit(x)).alias(x) for x in labels))


def without_records(blocks: DataFrame, records: DataFrame) -> DataFrame:
    """(_src_file, problem) for documents in which no labelled record was found."""
    found = records.select(F.col("_src_file").alias("found")).distinct()
    return blocks.select("_src_file").distinct().join(found, F.col("_src_file") == F.col("found"), "left_anti").withColumn("problem", F.lit("no labelled record was found"))


def recover_pages(native: DataFrame, recognised: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages, report): insufficient pages take the recognised text of (_src_file, page), unless it is blank.

    Report: (_src_file, recovered, failed, ocr_used), page numbers in order.
    """
    other = recognised.select(F.col("_src_file").alias("o_file"), F.col("page").alias("o_page"), F.col("text").alias("o_text"))
    joined = native.withColumn("poor", ~assess_text(F.col("text"))["is_sufficient"]).join(other, (F.col("_src_file") == F.col("o_file")) & (F.col("page") == F.col("o_page")), "left")
    joined = joined.withColumn("taken", F.col("poor") & strip(F.col("o_text")).isNotNull())
    pages = joined.select("_src_file", "page", F.when(F.col("taken"), F.col("o_text")).otherwise(F.col("text")).alias("text"), F.when(F.col("taken"), "ocr").otherwise("native").alias("origin"), "poor", "taken")
    report = pages.groupBy("_src_file").agg(
        F.array_sort(F.collect_list(F.when(F.col("taken"), F.col("page")))).alias("recovered"),
        F.array_sort(F.collect_list(F.when(F.col("poor") & ~F.col("taken"), F.col("page")))).alias("failed"),
        F.bool_or("taken").alias("ocr_used"),
    )
    return pages.drop("poor", "taken"), report
