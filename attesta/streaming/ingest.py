"""Ingestion as a stream: a file source of version rows, one micro-batch at a time, into tables that the graph is computed from.

Staleness must hold for ever, so state is the persisted version log and not a watermark, which would forget old documents. Each
batch is appended under its id, so a batch that is run again replaces itself and the outcome is that of one batch of all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.operators.incremental import latest_versions, pending_index

VERSION = "document_id string, version_id string, updated_at string, seq long, deleted boolean"


def version_log(spark: SparkSession, table: str) -> DataFrame:
    return spark.read.schema(f"{VERSION}, batch long").parquet(table).drop("batch")


def append_batch(table: str):
    """foreachBatch sink: writes the rows of a batch to its own partition."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select("document_id", "version_id", "updated_at", "seq", F.coalesce("deleted", F.lit(False)).alias("deleted")).dropDuplicates(["document_id", "version_id", "seq"])
        rows.write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    return write


def ingest(spark: SparkSession, source: str, table: str, checkpoint: str, fmt: str = "json", files_a_batch: int = 100, available_now: bool = True):
    """Starts the stream; with available_now it ends when the present files are read."""
    stream = spark.readStream.schema(VERSION).option("maxFilesPerTrigger", files_a_batch).format(fmt).load(source)
    out = stream.writeStream.foreachBatch(append_batch(table)).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if available_now else out).start()


def current(spark: SparkSession, table: str) -> DataFrame:
    """The current version of each document."""
    return latest_versions(version_log(spark, table))


def index_actions(spark: SparkSession, table: str) -> DataFrame:
    """What an index has to do: the latest action of each document."""
    log = version_log(spark, table)
    return pending_index(log.select("document_id", F.when(F.col("deleted"), "delete").otherwise("upsert").alias("action"), F.col("seq").alias("enqueued_at")))
