"""Sinks: messages and documents as JSON, answers as JSON lines, tables partitioned by a column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    rows.write.mode(mode).json(path)


def write_answers(answers: DataFrame, path: str) -> None:
    """question_id, answer, citations as JSON lines in order of question; resumable: what is there is not written again."""
    spark = answers.sparkSession
    try:
        done = spark.read.json(path).select(F.col("question_id").cast(dict(answers.dtypes)["question_id"]))
    except Exception:  # noqa: BLE001  nothing there yet
        done = None
    todo = answers if done is None else answers.join(done, "question_id", "left_anti")
    todo.sortWithinPartitions("question_id").write.mode("append").json(path)


def write_table(rows: DataFrame, path: str, by: str | None = None) -> None:
    w = rows.write.mode("errorifexists")
    (w.partitionBy(by) if by else w).parquet(path)
