"""Work folders that the driver and all executors see, and tables written there to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session has it; only where it is unset (tests) a folder of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = f"file://{tempfile.gettempdir()}/attesta-work"
    spark.conf.set("spark.checkpoint.dir", root)
    return root


#: Set where the session's configuration does not: whole texts pass in small Arrow batches, and the shuffle files of
#: a step go when its table is written, not when the driver happens to collect garbage.
SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


class Scratch:
    """One operator call's tables under the shared folder. A table lives until drop() or close()."""

    def __init__(self, spark: SparkSession, name: str):
        # what the user set, when the session was made or since, stays
        given = spark.conf.getAll
        for key, value in SETTINGS.items():
            if key not in given:
                spark.conf.set(key, value)
        self.spark, self.path = spark, f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.at(name))
        return self.spark.read.schema(df.schema).parquet(self.at(name))

    def drop(self, *names: str) -> None:
        for name in names or ("",):
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.at(name) if name else self.path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


#: What a part of a packed exchange should hold of the input at most, and a size at which the planner knows nothing.
PART_BYTES, UNKNOWN_BYTES = 256 << 20, 1 << 60


def parts_of(spark: SparkSession, rows: DataFrame | None = None) -> int:
    """The session's shuffle partitions; more if the rows, by the planner's statistics, would give parts of more than PART_BYTES."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if rows is None:
        return n
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return n if size >= UNKNOWN_BYTES else max(n, -(-size // PART_BYTES))


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else f"file://{os.path.abspath(path)}" if not path.startswith("file:") else "file://" + path[5:])


def put(path: str, pieces: list[bytes]) -> None:
    """Writes a file under another name and moves it, so that a repeated or late task leaves a whole file."""
    fs, at = filesystem(path)
    fs.create_dir(os.path.dirname(at), recursive=True)
    draft = f"{at}.{uuid.uuid4().hex}.draft"
    with fs.open_output_stream(draft) as out:
        for piece in pieces:
            out.write(piece)
    fs.move(draft, at)
