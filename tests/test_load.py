"""The job's totals, duration and load; the database is the Derby that ships with Spark, in memory."""

import time
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from ferryline.operators import audit
from ferryline.operators.mapping import CUSTOMERS_CSV
from ferryline.plans import legacy
from ferryline.plans.migration import run_migration
from ferryline.sinks import outputs

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def run(spark):
    began = time.time()
    found = run_migration(legacy.customers(spark, DATA), CUSTOMERS_CSV, date(2025, 1, 1))
    return found, time.time() - began


@pytest.fixture
def database(spark, run):
    """Empty target tables with the columns of this run."""
    url = f"jdbc:derby:memory:d{time.time_ns()};create=true"
    found = run[0]
    targets = {"customers": outputs.target_rows(found.annotated, "customers", found.run_id, datetime(2025, 1, 1)), "migration_issues": outputs.issue_rows(found.annotated, found.run_id), "migration_runs": found.record}
    for name, rows in targets.items():
        rows.where("false").write.jdbc(url, name)
    return url


def sizes(spark, url):
    return [spark.read.jdbc(url, t).count() for t in ("customers", "migration_issues", "migration_runs")]


def staged(spark, url):
    return [r[0] for r in spark.read.jdbc(url, "SYS.SYSTABLES").select("TABLENAME").collect() if r[0].startswith("STAGE_")]


def execute(spark, url, *statements):
    connection = spark._jvm.java.sql.DriverManager.getConnection(url)
    for statement in statements:
        connection.createStatement().executeUpdate(statement)
    connection.close()


def test_totals_are_observed(run):
    found, seconds = run
    assert found.totals.first() == audit.run_totals(found.annotated, found.duplicates).first()
    record = found.record.first()
    assert 0.5 * seconds * 1000 < record["duration_ms"] <= seconds * 1000 + 1
    assert record["status"] == "dry_run" and record["loaded_records"] == 0


def test_plans_of_a_run_are_short(run):
    found, _ = run
    plan = found.annotated._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 20_000


def test_load_takes_part_in_the_duration(spark, tmp_path, monkeypatch):
    whole = outputs.issue_rows

    def slow(*args):
        time.sleep(3)
        return whole(*args)

    monkeypatch.setattr(outputs, "issue_rows", slow)
    source = legacy.customers(spark, DATA).where("_row < 30")
    found = run_migration(source, CUSTOMERS_CSV, date(2025, 1, 1), dry_run=False, load_folder=str(tmp_path))
    stored = spark.read.parquet(f"{tmp_path}/migration_runs").first()
    assert stored["duration_ms"] >= 3000 and stored["status"] == "completed" and stored["loaded_records"] == found.totals.first()["valid_records"]


def test_commit(spark, run, database):
    found, _ = run
    outputs.load_jdbc(found.annotated, found.run_id, lambda: found.record, "customers", database, {}, datetime(2025, 1, 1), dry_run=False)
    issues = found.annotated.select(F.sum(F.size("issues"))).first()[0]
    assert sizes(spark, database) == [found.totals.first()["valid_records"], issues, 1] and not staged(spark, database)


def test_failing_task_loads_nothing(spark, run, database):
    found, _ = run

    @F.udf("string")
    def fails(x):
        raise RuntimeError("lost")

    broken = found.annotated.withColumn("issues", F.transform("issues", lambda i: i.withField("message", F.lit("x")))).withColumn("issues", F.when(F.col("_row") % 50 == 7, F.array(F.struct(*(fails(F.lit("a")).alias(c) if c == "message" else F.lit("a").alias(c) for c in found.annotated.schema["issues"].dataType.elementType.names)))).otherwise(F.col("issues")))
    with pytest.raises(Exception, match="lost"):
        outputs.load_jdbc(broken, found.run_id, lambda: found.record, "customers", database, {}, datetime(2025, 1, 1), dry_run=False)
    assert sizes(spark, database) == [0, 0, 0] and not staged(spark, database)


def test_failing_insert_loads_nothing(spark, run, database):
    found, _ = run
    execute(spark, database, 'ALTER TABLE migration_runs ADD CONSTRAINT refuses CHECK ("total_records" < 0)')
    with pytest.raises(Exception, match="(?i)constraint"):
        outputs.load_jdbc(found.annotated, found.run_id, lambda: found.record, "customers", database, {}, datetime(2025, 1, 1), dry_run=False)
    assert sizes(spark, database) == [0, 0, 0] and not staged(spark, database)


def test_a_partition_written_twice_is_loaded_once(spark, run, database):
    found, _ = run
    load = outputs.StagedLoad(spark, database, {})
    rows = outputs.target_rows(found.annotated, "customers", found.run_id, datetime(2025, 1, 1)).repartition(3)
    rows = spark.createDataFrame(rows.collect(), rows.schema).repartition(3)
    load.stage("customers", rows)
    name, columns, expected = load.staged["customers"]
    names = ", ".join(f'"{c}"' for c in columns)
    execute(spark, database, f'INSERT INTO {name} ({names}, "{outputs.PART}", "{outputs.ATTEMPT}") SELECT {names}, "{outputs.PART}", "{outputs.ATTEMPT}" + 1000 FROM {name} WHERE "{outputs.PART}" = 1')
    assert spark.read.jdbc(database, name).count() > expected
    load.commit()
    assert sizes(spark, database)[0] == expected
    execute(spark, database, f'DELETE FROM {name} WHERE "{outputs.PART}" = 2')
    with pytest.raises(RuntimeError, match="were to be"):
        load.commit()
    assert sizes(spark, database)[0] == expected
    load.close()
    assert not staged(spark, database)


def test_job_loads_into_a_database(spark, database):
    found = run_migration(legacy.customers(spark, DATA), CUSTOMERS_CSV, date(2025, 1, 1), dry_run=False, load_url=database)
    assert sizes(spark, database)[0] == found.totals.first()["valid_records"] and sizes(spark, database)[2] == 1
    found.release()
