"""Working tables of a job, in the folder that driver and executors share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import DataFrame, Observation, SparkSession


#: Bytes above which HotSpot never compiles a method, but interprets it row by row.
COMPILED_BYTES = 8000


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; without one, only a session on the driver's own machine (as in tests) gets a folder, below its warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_jobs"


def _file_system(spark: SparkSession, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()), jvm_path


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A path nobody else uses, deleted when the application ends."""
    folder = f"{shared_folder(spark)}/{name}-{uuid4().hex}"
    system, path = _file_system(spark, folder)
    system.deleteOnExit(path)
    return folder


def drop_folder(spark: SparkSession, folder: str) -> None:
    system, path = _file_system(spark, folder)
    system.delete(path, True)


@contextmanager
def _compiled(spark: SparkSession) -> Iterator[None]:
    """What runs here joins operators into one method only where the JVM compiles that; others run one by one, each compiled. Same results."""
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), COMPILED_BYTES)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written(df: DataFrame, name: str, observation: Observation | None = None, *metrics) -> tuple[DataFrame, str]:
    """(``df`` written once and read back, its folder): cuts the lineage, so what reads it has a short plan and a lost executor
    costs a read. ``metrics`` are aggregates taken from the rows while they are written."""
    spark, folder = df.sparkSession, fresh_folder(df.sparkSession, name)
    with _compiled(spark):
        (df.observe(observation, *metrics) if observation else df).write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder), folder
