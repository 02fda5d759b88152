"""Intermediate tables in the folder that the driver and all executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Set where the session's configuration does not: tables count as what they are unpacked, so that the planner does not send a large one to every
#: task because its file is small; texts pass to Python in small Arrow batches; a step's shuffle files go with it, not when the driver collects garbage.
SETTINGS = {
    "spark.sql.sources.fileCompressionFactor": "10",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


def settle(spark: SparkSession) -> None:
    """What the user set, when the session was made or since, stays."""
    given = spark.conf.getAll
    for key, value in SETTINGS.items():
        if key not in given:
            spark.conf.set(key, value)


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir or, where that is unset in local mode, a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.gettempdir()}/attesta-work"
    return root.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def hold(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes a table and reads it again. It stays until the caller removes it, as a lazy result may read it at any time."""
    spark = df.sparkSession
    settle(spark)
    path = f"{folder or shared_folder(spark)}/held-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Work:
    """Held tables of one job, removed together at its end."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{shared_folder(spark)}/work-{uuid.uuid4().hex[:12]}"

    def __enter__(self) -> Work:
        return self

    def hold(self, df: DataFrame) -> DataFrame:
        return hold(df, self.folder)

    def __exit__(self, *_) -> None:
        remove(self.spark, self.folder)
