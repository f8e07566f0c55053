"""Counts and reports over a run's annotated rows."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .mapping import transform_counts
from .validation import issues_for_display

DETAIL_LIMIT = 500
#: The columns of a run's totals.
TOTALS = ("total_records", "valid_records", "rejected_records", "duplicate_records", "possible_duplicates", "loaded_records")


def run_totals(validated: DataFrame, found: DataFrame, loaded: int = 0) -> DataFrame:
    """A1: one row of totals; exact and possible duplicates apart."""
    rows = validated.agg(F.count("*").alias("total_records"), F.count_if("is_valid").alias("valid_records"), F.count_if(~F.col("is_valid")).alias("rejected_records"))
    dups = found.agg(F.count_if(F.col("kind") == "exact").alias("duplicate_records"), F.count_if(F.col("kind") == "possible").alias("possible_duplicates"))
    # Two rows of one aggregate each.
    return rows.select("*", F.lit(1).alias("_one")).join(dups.select("*", F.lit(1).alias("_one")), "_one").drop("_one").withColumn("loaded_records", F.lit(loaded).cast("long"))


def issues_by_code(annotated: DataFrame) -> DataFrame:
    """A2"""
    return annotated.select(F.explode("issues.code").alias("code")).groupBy("code").agg(F.count("*").alias("issues")).orderBy("code")


def first_issues(annotated: DataFrame, ord: str = "_row", limit: int = DETAIL_LIMIT) -> DataFrame:
    """A4: (severity, row, pos, code, field, message, ...): the first ``limit`` issues of every severity in row order, masked, in one scan.

    The limit on the row number is taken in every task before the shuffle, so at most ``limit`` rows of a severity leave a task.
    """
    rows = annotated.select(F.col(ord).alias("row"), F.posexplode("issues").alias("pos", "i")).select("row", "pos", F.array("i").alias("one"), F.col("i.severity").alias("severity"))
    picked = rows.withColumn("at", F.row_number().over(W.partitionBy("severity").orderBy("row", "pos"))).where(F.col("at") <= limit)
    return picked.select("severity", "row", "pos", F.explode(issues_for_display(F.col("one"))).alias("i")).select("severity", "row", "pos", "i.code", "i.field", "i.message", "i.original_value", "i.normalized_value")


def issue_details(annotated: DataFrame, severity: str, ord: str = "_row", limit: int = DETAIL_LIMIT) -> DataFrame:
    """A4 for one severity."""
    return first_issues(annotated, ord, limit).where(F.col("severity") == severity).drop("severity")


def run_record(totals: DataFrame, run_id: str, entity: str, source: str, source_hash: str, started: datetime, finished: datetime, dry_run: bool = True) -> DataFrame:
    """A5: one row for ``migration_runs``."""
    duration = max(0, int((finished - started).total_seconds() * 1000))
    fixed = {"run_id": run_id, "entity": entity, "source_filename": source, "source_hash": source_hash, "status": "dry_run" if dry_run else "completed", "dry_run": dry_run}
    return totals.select(*(F.lit(v).alias(k) for k, v in fixed.items()), "*", F.lit(started).cast("timestamp").alias("started_at"), F.lit(finished).cast("timestamp").alias("finished_at"), F.lit(duration).cast("long").alias("duration_ms"))


def run_warnings(*warnings: DataFrame) -> DataFrame:
    """Warnings of the readers and of the mapping, one table."""
    out = warnings[0]
    for more in warnings[1:]:
        out = out.unionByName(more)
    return out


def audit_report(annotated: DataFrame, found: DataFrame, record: DataFrame, ord: str = "_row", warnings: DataFrame | None = None) -> DataFrame:
    """K4: one row with the whole report as JSON text.

    One row can't hold the duplicates of any input: the report lists the first DETAIL_LIMIT of them, as it does issues, and names the
    table of the run that has all. ``warnings`` are those of the run (A6), at most a few for each file.
    """
    if warnings is None:
        warnings = annotated.sparkSession.createDataFrame([], "file string, problem string, columns string")

    def listed(df: DataFrame, order: list[str], name: str) -> DataFrame:
        return df.agg(F.array_sort(F.collect_list(F.struct(*order, *(c for c in df.columns if c not in order)))).alias(name), F.lit(1).alias("_one"))

    # One scan for both severities; at most twice DETAIL_LIMIT rows come out.
    details = first_issues(annotated, ord)
    order = ["row", "pos"]
    entry = F.struct(*order, *(c for c in details.columns if c not in (*order, "severity")))
    both = details.agg(*(F.array_sort(F.collect_list(F.when(F.col("severity") == one, entry))).alias(name) for one, name in (("error", "errors"), ("warning", "warnings"))), F.lit(1).alias("_one"))
    parts = [
        listed(transform_counts(annotated), ["transform"], "transforms_applied"),
        listed(issues_by_code(annotated), ["code"], "issues_by_code"),
        both,
        # Rows and keys only: values of duplicates are not part of the report. The first ones, as for issues.
        listed(found.select("ord", "matched", "kind", "key", "similarity").orderBy("ord").limit(DETAIL_LIMIT), ["ord", "matched"], "duplicates"),
        listed(warnings, ["file", "problem", "columns"], "run_warnings"),
    ]
    out = record.select(F.struct("*").alias("run"), F.lit(1).alias("_one"))
    for part in parts:
        out = out.join(part, "_one")
    return out.select(F.to_json(F.struct("run", "transforms_applied", "issues_by_code", "errors", "warnings", "duplicates", F.lit("duplicates").alias("duplicates_table"), "run_warnings")).alias("report"))


def report_lines(annotated: DataFrame, found: DataFrame, record: DataFrame, ord: str = "_row", warnings: DataFrame | None = None) -> DataFrame:
    """K4 in parts: (part, entry), one JSON text for each entry of the report, and for every duplicate, however many there are.

    ``audit_report`` is one row and lists the first duplicates only; these lines list all, and are written by many tasks.
    """
    def lines(part: str, df: DataFrame) -> DataFrame:
        return df.select(F.lit(part).alias("part"), F.to_json(F.struct("*")).alias("entry"))

    details = first_issues(annotated, ord)
    parts = [
        lines("run", record),
        lines("transforms_applied", transform_counts(annotated)),
        lines("issues_by_code", issues_by_code(annotated)),
        *(lines(name, details.where(F.col("severity") == severity).drop("severity")) for severity, name in (("error", "errors"), ("warning", "warnings"))),
        lines("duplicates", found.select("ord", "matched", "kind", "key", "similarity")),
    ]
    if warnings is not None:
        parts.append(lines("run_warnings", warnings))
    return reduce(DataFrame.unionByName, parts)
