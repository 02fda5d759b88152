"""Projects the order tables into the relationship model, so that every graph operator can run on them.

Customers and suppliers are people of their nation's organization; orders are mail, written by the customer or, for
every third order, by its lead supplier; hours of the event stream are meetings.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from attesta.sources.work import settle, shared_folder

STAMP = "yyyy-MM-dd HH:mm:ss"
#: Source files that a part of the dealt tables stands for, at most.
PIECE_BYTES = 8 << 20


@dataclass
class Model:
    """people: person_id, name, org_id. orgs: org_id, name, is_internal. events: event_id, kind, title, event_at. parts: event_id, person_id, role.

    From a graph also works (person_id, org_id) of every employment, identifiers, aliases and documents.
    """

    people: DataFrame
    orgs: DataFrame
    events: DataFrame
    parts: DataFrame
    works: DataFrame | None = None
    identifiers: DataFrame | None = None
    aliases: DataFrame | None = None
    documents: DataFrame | None = None


def key(prefix: str, c: Column | str) -> Column:
    return F.concat(F.lit(prefix), (F.col(c) if isinstance(c, str) else c).cast("string"))


def _files(spark: SparkSession, sf_dir: str, table: str) -> list:
    """The files of a table, or the one file that it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{table}.parquet")
    return list(path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path))


def pieces(spark: SparkSession, sf_dir: str) -> int:
    """Parts in which the order tables are dealt: the session's shuffle partitions, or more where a part would have more than PIECE_BYTES of their files.

    A number that is given is not coalesced, so the memory of a task does not grow with the tables.
    """
    size = sum(f.getLen() for t in SOURCES for f in _files(spark, sf_dir, t))
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PIECE_BYTES))


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each order and supplier, with the order's columns.

    The lines are dealt by order once; the aggregate by supplier, the lead supplier and the join with orders all keep that partitioning.
    """
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_suppkey", "l_linenumber").repartition(pieces(spark, sf_dir), "l_orderkey")
    by_supplier = lines.groupBy("l_orderkey", "l_suppkey").agg(F.min("l_linenumber").alias("line"))
    by_supplier = by_supplier.withColumn("lead", F.min("l_suppkey").over(Window.partitionBy("l_orderkey")))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", F.col("o_orderdate").alias("event_at"), (F.col("o_orderkey") % 3 == 0).alias("flipped"))
    # lines are packed so well in files that the planner would send those of a large table to every task
    return orders.join(by_supplier.hint("merge"), F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("l_orderkey")


def mail_parts(lines: DataFrame) -> DataFrame:
    """event_id, person_id, role of mail."""
    mail = key("o:", "o_orderkey").alias("event_id")
    role = F.when(F.col("flipped"), F.when(F.col("l_suppkey") == F.col("lead"), "sender").otherwise("cc")).otherwise(F.when(F.col("line") == 1, "to").otherwise("cc"))
    supplier = F.struct(key("s:", "l_suppkey").alias("person_id"), role.alias("role"))
    customer = F.struct(key("c:", "o_custkey").alias("person_id"), F.when(F.col("flipped"), "to").otherwise("sender").alias("role"))
    # the customer comes with the row of the lead supplier, or alone where an order has no lines
    both = F.when(F.col("l_suppkey").isNull(), F.array(customer)).when(F.col("l_suppkey") == F.col("lead"), F.array(supplier, customer)).otherwise(F.array(supplier))
    return lines.select(mail, F.explode(both).alias("p")).select("event_id", "p.person_id", "p.role")


def hour_id() -> Column:
    return F.concat(F.lit("m:"), F.date_format(F.date_trunc("hour", "ts"), "yyyyMMddHH"))


def meeting_parts(events: DataFrame) -> DataFrame:
    role = F.when(F.col("event_type").isin("click", "purchase"), "speaker").otherwise("invitee")
    return events.select(hour_id().alias("event_id"), key("c:", "user_id").alias("person_id"), role.alias("role")).distinct()


SOURCES = ("customer", "supplier", "nation", "orders", "lineitem", "events")


def project(spark: SparkSession, sf_dir: str) -> Model:
    """The model as plans over the tables."""
    settle(spark)
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    people = read("customer").select(key("c:", "c_custkey").alias("person_id"), F.col("c_name").alias("name"), key("n:", "c_nationkey").alias("org_id"))
    people = people.union(read("supplier").select(key("s:", "s_suppkey"), "s_name", key("n:", "s_nationkey")))
    orgs = read("nation").select(key("n:", "n_nationkey").alias("org_id"), F.col("n_name").alias("name"), (F.col("n_regionkey") == 0).alias("is_internal"))
    stream = read("events")
    mail = read("orders").select(key("o:", "o_orderkey").alias("event_id"), F.lit("email").alias("kind"), key("order ", "o_orderkey").alias("title"), F.date_format("o_orderdate", STAMP).alias("event_at"))
    hour = F.date_trunc("hour", "ts")
    hours = stream.select(hour_id().alias("event_id"), F.lit("meeting").alias("kind"), F.concat(F.lit("hour "), F.date_format(hour, "yyyyMMddHH")).alias("title"), F.date_format(hour, STAMP).alias("event_at")).distinct()
    return Model(people, orgs, mail.union(hours), mail_parts(order_lines(spark, sf_dir)).union(meeting_parts(stream)))


def _stamp(spark: SparkSession, sf_dir: str) -> str:
    """What changes when a source table does: the names, lengths and times of its files."""
    out = [sf_dir]
    for t in SOURCES:
        out += [f"{s.getPath().getName()}:{s.getLen()}:{s.getModificationTime()}" for s in _files(spark, sf_dir, t)]
    return hashlib.md5("|".join(out).encode()).hexdigest()[:12]


class Loaded:
    """A Model whose events and parts are tables, as a graph has them: each written when it is first read, once in a session, and bucketed by event.

    All that groups or joins by event then needs no exchange. A changed source file gives another table.
    """

    works = identifiers = aliases = documents = None

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir, self._plans = spark, sf_dir, project(spark, sf_dir)
        self.people, self.orgs = self._plans.people, self._plans.orgs

    @property
    def events(self) -> DataFrame:
        return self._table("events")

    @property
    def parts(self) -> DataFrame:
        return self._table("parts")

    def _table(self, part: str) -> DataFrame:
        spark = self._spark
        name, n = f"attesta_{_stamp(spark, self._dir)}", pieces(spark, self._dir)
        if not spark.catalog.tableExists(f"{name}_{part}"):
            path = f"{shared_folder(spark)}/{name}-{spark.sparkContext.applicationId}/{part}"
            rows = getattr(self._plans, part).repartition(n, "event_id")
            rows.write.mode("overwrite").bucketBy(n, "event_id").sortBy("event_id").option("path", path).saveAsTable(f"{name}_{part}")
        return spark.table(f"{name}_{part}")


def load(spark: SparkSession, sf_dir: str) -> Loaded:
    """The model of the order tables for the registered queries."""
    return Loaded(spark, sf_dir)


#: The same model as DuckDB common table expressions.
MODEL_SQL = """
people AS (SELECT 'c:' || c_custkey AS person_id, c_name AS name, 'n:' || c_nationkey AS org_id FROM customer
  UNION ALL SELECT 's:' || s_suppkey, s_name, 'n:' || s_nationkey FROM supplier),
orgs AS (SELECT 'n:' || n_nationkey AS org_id, n_name AS name, n_regionkey = 0 AS is_internal FROM nation),
sup AS (SELECT l_orderkey, l_suppkey, min(l_linenumber) AS line FROM lineitem GROUP BY ALL),
lead_of AS (SELECT l_orderkey, min(l_suppkey) AS lead FROM lineitem GROUP BY ALL),
mail_parts AS (
  SELECT 'o:' || o_orderkey AS event_id, 's:' || l_suppkey AS person_id,
    CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN l_suppkey = lead THEN 'sender' ELSE 'cc' END WHEN line = 1 THEN 'to' ELSE 'cc' END AS role
  FROM orders JOIN sup ON o_orderkey = sup.l_orderkey JOIN lead_of ON o_orderkey = lead_of.l_orderkey
  UNION ALL SELECT 'o:' || o_orderkey, 'c:' || o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN 'to' ELSE 'sender' END FROM orders),
parts AS (SELECT * FROM mail_parts UNION ALL
  SELECT DISTINCT 'm:' || strftime(date_trunc('hour', ts), '%Y%m%d%H'), 'c:' || user_id,
    CASE WHEN event_type IN ('click', 'purchase') THEN 'speaker' ELSE 'invitee' END FROM events),
happenings AS (SELECT 'o:' || o_orderkey AS event_id, 'email' AS kind, 'order ' || o_orderkey AS title, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS event_at FROM orders
  UNION ALL SELECT DISTINCT 'm:' || strftime(date_trunc('hour', ts), '%Y%m%d%H'), 'meeting', 'hour ' || strftime(date_trunc('hour', ts), '%Y%m%d%H'), strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') FROM events)
"""
