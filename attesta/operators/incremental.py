"""Incremental maintenance as plans over append-only logs.

The graph is a function of the latest version of each document, so replacing, deleting and garbage are filters: what to process
is an anti-join with the ledger, what is current a maximum for each document, and what is deleted a tombstone in the log.
Tables are replaced by writing a new directory and moving a pointer.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_PRUNE = 0.05
BATCH = 64


def latest_versions(log: DataFrame) -> DataFrame:
    """The current version of each document of log(document_id, version_id, updated_at, seq, deleted).

    A version that says it is older than one already stored is late and never becomes current; equal or unknown times go by arrival.
    A tombstone removes the document until a later version comes.
    """
    best = F.max_by(F.struct("version_id", "updated_at", "seq", "deleted"), F.struct(F.coalesce(F.col("updated_at").cast("string"), F.lit("")), "seq"))
    # without a time a version can't be late: it takes the greatest time before it
    from pyspark.sql import Window

    w = Window.partitionBy("document_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    timed = log.withColumn("updated_at", F.coalesce("updated_at", F.max("updated_at").over(w)))
    return timed.groupBy("document_id").agg(best.alias("v")).where("not v.deleted").select("document_id", "v.version_id", "v.updated_at")


def stale(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Incoming documents that are older than what is stored."""
    return incoming.join(stored.select("document_id", F.col("updated_at").alias("stored_at")), "document_id").where("updated_at < stored_at").drop("stored_at")


def to_process(incoming: DataFrame, ledger: DataFrame, keys: tuple[str, ...] = ("version_id", "pipeline_version", "ontology_checksum")) -> DataFrame:
    """What the ledger does not have: a version is processed once for each pipeline and ontology."""
    return incoming.join(ledger.select(*keys).distinct(), list(keys), "left_anti")


def prune(stored: DataFrame, seen: DataFrame, most: float = MAX_PRUNE, force: bool = False) -> DataFrame:
    """Stored documents of listed systems that the listing no longer has; refused for a system that would lose more than ``most``."""
    gone = stored.join(seen.select("system").distinct(), "system", "left_semi").join(seen.select("system", "document_id"), ["system", "document_id"], "left_anti")
    share = stored.groupBy("system").agg(F.count("*").alias("n")).join(gone.groupBy("system").agg(F.count("*").alias("g")), "system")
    allowed = share if force else share.where(F.col("g") <= most * F.col("n"))
    return gone.join(allowed.select("system"), "system", "left_semi")


def garbage(versions: DataFrame, current: DataFrame) -> DataFrame:
    """Stored versions that are not current."""
    return versions.join(current.select("document_id", "version_id"), ["document_id", "version_id"], "left_anti")


def unreferenced(entities: DataFrame, references: DataFrame, edges: DataFrame, decided: DataFrame) -> DataFrame:
    """Entities that no candidate, edge or human decision holds."""
    ends = edges.select(F.col("source_id").alias("entity_id")).union(edges.select("target_id"))
    return entities.join(references.select("entity_id"), "entity_id", "left_anti").join(ends, "entity_id", "left_anti").join(decided.select("entity_id"), "entity_id", "left_anti")


def pending_index(queue: DataFrame) -> DataFrame:
    """The latest action of each document in an append-only queue(document_id, action, enqueued_at)."""
    return queue.groupBy("document_id").agg(F.max(F.struct("enqueued_at", "action")).alias("q")).select("document_id", "q.action", "q.enqueued_at")


def confirm_index(pending: DataFrame, confirmed: DataFrame) -> DataFrame:
    """What stays queued: not confirmed, or queued again after the confirmed action was read."""
    return pending.join(confirmed.select("document_id", F.col("enqueued_at").alias("done_at")), "document_id", "left").where("done_at is null or enqueued_at > done_at").drop("done_at")


def drain_partitions(pending: DataFrame, sink, batch: int = BATCH) -> DataFrame:
    """document_id, version_id that the sink confirmed; the executors call sink(action, rows), each in batches of its own partition.

    rows and what the sink returns are lists of dicts. A task that is run again sends its rows again, so a sink must take a document twice.
    """

    def send(frames):
        for f in frames:
            for action, rows in f.groupby("action", sort=True):
                for a in range(0, len(rows), batch):
                    done = sink(action, rows.iloc[a : a + batch].to_dict("records"))
                    yield pd.DataFrame([(r["document_id"], r["version_id"]) for r in done], columns=["document_id", "version_id"])

    return pending.mapInPandas(send, "document_id string, version_id string")


def drain(pending: DataFrame, sink) -> list:
    """Sends deletes and then upserts to sink(action, rows) in batches; returns what the sink confirmed."""
    done = []
    for action in ("delete", "upsert"):
        batch = []
        for row in pending.where(F.col("action") == action).orderBy("document_id").toLocalIterator():
            batch.append(row)
            if len(batch) == BATCH:
                done += sink(action, batch)
                batch = []
        if batch:
            done += sink(action, batch)
    return done
