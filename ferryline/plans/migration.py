"""The whole job: read, map, validate, flag duplicates, report, and load where asked."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, timezone
from uuid import uuid4

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..operators import audit, dedup
from ..operators.mapping import PROVENANCE, Template, apply_mapping, reconcile_columns
from ..operators.validation import validate
from ..sinks import outputs
from ..working import drop_folder, written


@dataclass(frozen=True)
class Migration:
    """Tables of one finished run: ``annotated``, ``duplicates`` and what is made from them are read from working tables."""

    run_id: str
    entity: str
    annotated: DataFrame
    duplicates: DataFrame
    totals: DataFrame
    record: DataFrame
    report: DataFrame
    warnings: DataFrame
    folders: tuple[str, ...]

    def release(self) -> None:
        """Delete the working tables when all outputs have been taken; they go at the end of the application anyway."""
        for folder in self.folders:
            drop_folder(self.annotated.sparkSession, folder)


def checked_rows(source: DataFrame, template: Template, reference: date) -> tuple[DataFrame, str, dict[str, int]]:
    """(rows mapped and validated, written once; their folder; A1: their totals, observed while they were written)."""
    seen = Observation()
    validated = validate(apply_mapping(source, template), template.entity, reference)
    rows, folder = written(validated, "validated", seen, F.count(F.lit(1)).alias("total_records"), F.count_if("is_valid").alias("valid_records"), F.count_if(~F.col("is_valid")).alias("rejected_records"))
    return rows, folder, seen.get


def both_searches(rows: DataFrame, ord: str = "_row", fuzzy: bool = True) -> tuple[DataFrame, str, dict[str, int]]:
    """(J5: duplicates among the valid ``rows``, written once; their folder; their numbers by kind)."""
    valid = rows.where("is_valid")
    exact, exact_folder = written(dedup.find_exact(valid, ord), "exact")
    names = {"full_name", "name"} & set(rows.columns)
    possible = dedup.find_possible(valid, exact, ord) if fuzzy and names else exact.selectExpr("*", "cast(null as double) similarity").where("false")
    seen = Observation()
    found, folder = written(dedup.duplicates(exact, possible), "duplicates", seen, F.count_if(F.col("kind") == "exact").alias("duplicate_records"), F.count_if(F.col("kind") == "possible").alias("possible_duplicates"))
    drop_folder(rows.sparkSession, exact_folder)
    return found, folder, seen.get


def check_source(source: DataFrame, template: Template, source_name: str, source_format: str | None, read_warnings: DataFrame | None) -> DataFrame:
    """The run's warnings (file, problem, columns); raises where the template does not suit the source.

    A required column that is absent, or another format than the template declares, is a mistake of configuration and must not
    become a run in which every row is rejected. Absent optional columns and unknown columns are warnings.
    """
    spark = source.sparkSession
    names = [c for c in source.columns if c not in PROVENANCE]
    headers = spark.createDataFrame([(source_name, c) for c in names], "file string, column_name string")
    formats = spark.createDataFrame([(source_name, source_format)], "file string, format string") if source_format else None
    problems = reconcile_columns(headers, template, formats)
    blocking = problems.where("blocking").collect()  # at most one row per field of the template
    if blocking:
        listed = ", ".join(sorted(f"{r['problem']}: {r['columns']}" for r in blocking))
        raise ValueError(f"the template for {template.entity} does not suit {source_name or 'the source'} ({listed}); its columns are {names}")
    found = problems.select("file", "problem", "columns")
    return audit.run_warnings(found, read_warnings) if read_warnings is not None else found


def run_migration(
    source: DataFrame,
    template: Template,
    reference: date,
    ord: str = "_row",
    source_name: str = "",
    source_hash: str = "",
    fuzzy: bool = True,
    dry_run: bool = True,
    load_folder: str | None = None,
    load_url: str | None = None,
    load_properties: dict[str, str] | None = None,
    out_folder: str | None = None,
    source_format: str | None = None,
    read_warnings: DataFrame | None = None,
) -> Migration:
    """R1. Configuration problems raise; problems of the data become issues. A dry run, the default, loads nothing.

    The job runs when it is called. Mapping and validation are one narrow stage, written once with its totals observed on the way; both
    searches read their few columns from that table, and so do outputs and reports. The load comes before the exports, and the record is
    made when the load has ended: its duration is that of the work. ``read_warnings(file, problem, columns)`` are those of the
    reader; ``source_format`` is compared with what the template declares.
    """
    if not dry_run and not (load_folder or load_url):
        raise ValueError("a load needs a folder or a database")
    warnings = check_source(source, template, source_name, source_format, read_warnings)
    spark, entity = source.sparkSession, template.entity
    run_id, started = str(uuid4()), datetime.now(timezone.utc)
    rows, rows_folder, totals = checked_rows(source, template, reference)
    found, found_folder, kinds = both_searches(rows, ord, fuzzy)
    annotated = dedup.annotate_duplicates(rows, found, ord)
    counts = totals | kinds | {"loaded_records": 0 if dry_run else totals["valid_records"]}
    counted = spark.createDataFrame([tuple(counts[c] for c in audit.TOTALS)], ", ".join(f"{c} long" for c in audit.TOTALS))

    def recorded() -> DataFrame:
        return audit.run_record(counted, run_id, entity, source_name, source_hash, started, datetime.now(timezone.utc), dry_run)

    if not dry_run and load_folder:
        outputs.load_lake(annotated, run_id, recorded, entity, load_folder, datetime.now(timezone.utc), dry_run=False)
    if not dry_run and load_url:
        outputs.load_jdbc(annotated, run_id, recorded, entity, load_url, load_properties or {}, datetime.now(timezone.utc), dry_run=False)
    record = recorded()
    result = Migration(run_id, entity, annotated, found, counted, record, audit.audit_report(annotated, found, record, ord, warnings), warnings, (rows_folder, found_folder))
    if out_folder:
        folder = f"{out_folder}/run_id={run_id}"
        outputs.write_table(outputs.accepted_rows(rows, entity), folder, "accepted")
        outputs.write_table(outputs.rejected_rows(rows, entity), folder, "rejected")
        outputs.write_table(outputs.duplicate_rows(found), folder, "duplicates")
        outputs.write_table(warnings, folder, "run_warnings")
        result.report.write.mode("overwrite").text(f"{folder}/audit")
        audit.report_lines(annotated, found, record, ord, warnings).write.mode("overwrite").partitionBy("part").text(f"{folder}/audit_lines")
    return result
