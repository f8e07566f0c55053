"""Outputs of a run: accepted, rejected and duplicate rows as text tables, and the load."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime
from uuid import uuid4

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.mapping import SCHEMAS
from ..operators.validation import issues_for_display

KINDS = {"exact": "exata", "possible": "possivel"}


def accepted_rows(validated: DataFrame, entity: str) -> DataFrame:
    """K1: valid rows in canonical order as text: ISO dates, plain amounts with the source's scale."""
    valid = validated.where("is_valid")
    special = {"created_at": F.date_format("entity.created_at", "yyyy-MM-dd HH:mm:ss")} if entity == "customers" else {}
    if entity == "invoices":
        special = {"issued_at": F.date_format("entity.issued_at", "yyyy-MM-dd"), "due_at": F.date_format("entity.due_at", "yyyy-MM-dd"), "amount": F.col("entity.amount_text")}
    return valid.select(*(special.get(c, F.col(f"entity.{c}").cast("string")).alias(c) for c in SCHEMAS[entity]))


def rejected_rows(validated: DataFrame, entity: str) -> DataFrame:
    """K2: one row per error, with the mapped values."""
    own = list(SCHEMAS[entity])
    rows = validated.select("_row", F.col("_sheet").alias("aba") if "_sheet" in validated.columns else F.lit(None).cast("string").alias("aba"), *own, F.posexplode(F.filter("issues", lambda i: i["severity"] == "error")).alias("pos", "i"))
    return rows.select(F.col("_row").alias("linha"), "aba", F.col("i.field").alias("campo"), F.col("i.code").alias("codigo"), F.col("i.severity").alias("severidade"), F.col("i.message").alias("mensagem"), *own)


def duplicate_rows(found: DataFrame) -> DataFrame:
    """K3: exact ones and possible ones; similarity with 3 decimals for the latter."""
    kind = F.coalesce(*(F.when(F.col("kind") == k, v) for k, v in KINDS.items()))
    similarity = F.when(F.col("kind") == "possible", F.format_string("%.3f", F.col("similarity")))
    return found.select(F.col("ord").alias("linha"), F.col("matched").alias("linha_correspondente"), kind.alias("tipo"), F.col("key").alias("chave"), F.col("value").alias("valor"), similarity.alias("similaridade"))


def write_table(rows: DataFrame, folder: str, name: str, fmt: str = "csv") -> None:
    """One table of a run below ``folder``; csv has a header and empty text for null."""
    writer = rows.write.mode("overwrite").format(fmt)
    (writer.option("header", True).option("emptyValue", "").option("nullValue", "") if fmt == "csv" else writer).save(f"{folder}/{name}")


def target_rows(validated: DataFrame, entity: str, run_id: str, imported_at: datetime) -> DataFrame:
    """K6: rows for the target table; amounts become decimal(18,2) here and nowhere earlier."""
    fields = [f.name for f in validated.schema["entity"].dataType.fields if f.name != "amount_text"]
    if not set(SCHEMAS[entity]) <= set(fields):
        raise ValueError(f"these rows hold no {entity}: {fields}")
    cols = [F.col(f"entity.{c}").try_cast("decimal(18,2)").alias(c) if c == "amount" else F.col(f"entity.{c}").alias(c) for c in fields]
    return validated.where("is_valid").select(F.lit(run_id).alias("run_id"), *cols, F.lit(imported_at).cast("timestamp").alias("imported_at"))


def issue_rows(annotated: DataFrame, run_id: str) -> DataFrame:
    """Masked issues of all rows."""
    rows = annotated.select("_row", F.posexplode(issues_for_display(F.col("issues"))).alias("pos", "i"))
    return rows.select(F.lit(run_id).alias("run_id"), F.col("_row").alias("row_number"), "pos", "i.*")


def load_lake(annotated: DataFrame, run_id: str, record: Callable[[], DataFrame], entity: str, folder: str, imported_at: datetime, dry_run: bool = True) -> None:
    """K5: the lake form of the load. A dry run is refused first.

    Data goes to its own ``run_id=`` folders; the row in ``migration_runs``, made by ``record`` when the data is written, comes last and is
    the commit mark: readers join on it, so a run that failed half-way, or was written again by a repeated task, does not show.
    """
    if dry_run:
        raise ValueError("a dry run loads nothing")
    target_rows(annotated, entity, run_id, imported_at).drop("run_id").write.mode("overwrite").parquet(f"{folder}/{entity}/run_id={run_id}")
    issue_rows(annotated, run_id).drop("run_id").write.mode("overwrite").parquet(f"{folder}/migration_issues/run_id={run_id}")
    record().drop("run_id").write.mode("overwrite").parquet(f"{folder}/migration_runs/run_id={run_id}")


def _with_attempt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row with its partition and the attempt that wrote it, which is the task's message to the commit."""
    context = TaskContext.get()
    for batch in batches:
        n = batch.num_rows
        marks = [pa.array([context.partitionId()] * n, pa.int32()), pa.array([context.taskAttemptId()] * n, pa.int64())]
        yield pa.RecordBatch.from_arrays([*batch.columns, *marks], names=[*batch.schema.names, PART, ATTEMPT])


#: Names of the two columns that staging tables have besides their own.
PART, ATTEMPT = "stage_part", "stage_attempt"


class StagedLoad:
    """Two-phase load over JDBC.

    ``stage``: tasks write a table's rows, each partition in a transaction of its own, to a staging table. A partition that was
    written and then repeated, because its executor was lost before it could report, is there twice. ``commit``: one transaction
    on the driver's connection takes the first attempt of every partition of every staging table, checks that the rows are as many as were
    to be staged, and makes all tables visible at once. Whatever fails before its end, nothing is loaded. ``close`` drops the staging tables.
    """

    def __init__(self, spark: SparkSession, url: str, properties: dict[str, str]):
        self.spark, self.url, self.properties = spark, url, properties
        self.suffix = uuid4().hex[:12]
        self.staged: dict[str, tuple[str, list[str], int]] = {}

    def stage(self, table: str, rows: DataFrame) -> None:
        name = f"stage_{table}_{self.suffix}"
        self.staged[table] = name, rows.columns, rows.count()
        kinds = T.StructType([*rows.schema.fields, T.StructField(PART, T.IntegerType()), T.StructField(ATTEMPT, T.LongType())])
        rows.mapInArrow(_with_attempt, kinds).write.jdbc(self.url, name, properties=self.properties)

    def _connection(self):
        jvm = self.spark._jvm
        settings = jvm.java.util.Properties()
        for k, v in self.properties.items():
            settings.setProperty(k, v)
        connection = jvm.java.sql.DriverManager.getConnection(self.url, settings)
        connection.setAutoCommit(False)
        return connection

    def commit(self) -> None:
        connection = self._connection()
        try:
            for table, (name, columns, expected) in self.staged.items():
                names = ", ".join(f'"{c}"' for c in columns)
                first = f'SELECT MIN("{ATTEMPT}") FROM {name} GROUP BY "{PART}"'
                loaded = connection.createStatement().executeUpdate(f'INSERT INTO {table} ({names}) SELECT {names} FROM {name} WHERE "{ATTEMPT}" IN ({first})')
                if loaded != expected:
                    raise RuntimeError(f"{table}: {loaded} rows are staged where {expected} were to be")
            connection.commit()
        except Exception:
            connection.rollback()
            raise
        finally:
            connection.close()

    def close(self) -> None:
        connection = self._connection()
        try:
            for name, _, _ in self.staged.values():
                try:
                    connection.createStatement().executeUpdate(f"DROP TABLE {name}")
                    connection.commit()
                except Exception:  # a staging table that was never made
                    connection.rollback()
        finally:
            connection.close()


def load_jdbc(annotated: DataFrame, run_id: str, record: Callable[[], DataFrame], entity: str, url: str, properties: dict[str, str], imported_at: datetime, dry_run: bool = True) -> None:
    """K5 over JDBC: the entity's rows, the masked issues and the run's record, all or nothing (see ``StagedLoad``).

    ``annotated`` must give the same rows whenever it is read, as a written table does. The target tables exist, with the columns' names as they are here.
    """
    if dry_run:
        raise ValueError("a dry run loads nothing")
    load = StagedLoad(annotated.sparkSession, url, properties)
    try:
        load.stage(entity, target_rows(annotated, entity, run_id, imported_at))
        load.stage("migration_issues", issue_rows(annotated, run_id))
        load.stage("migration_runs", record())
        load.commit()
    finally:
        load.close()
