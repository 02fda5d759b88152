"""Table versions in folders and one pointer, and the engine's verbs: one function for each."""

from __future__ import annotations

import json
import uuid
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.functions import identity as E
from attesta.operators import compiler, graph, incremental, interactions, render, review
from attesta.operators.extract import DOCUMENT
from attesta.operators.ontology import Ontology, register, relation_table, type_table
from attesta.plans.projection import Model
from attesta.sources.adapters import read_files
from attesta.sources.work import Work

AUDIT = "audit_id string, at timestamp, action string, object_type string, object_id string, detail string"
DECISION = "dedupe_key string, status string, reviewer string, note string, decided_at timestamp"
LEDGER = "version_id string, pipeline_version string, ontology_checksum string"
LOG = f"{DOCUMENT}, seq long, deleted boolean"
TABLES = ("entities", "identifiers", "aliases", "evidence", "edges", "entity_decisions", "decisions", "reviews")
#: Raised when extraction or compilation changes what a document gives: all documents then are processed again.
PIPELINE = "2"


@dataclass
class Engine:
    """The graph in a folder. Documents are an append-only log, and tables are written whole beside the old ones and then pointed to.

    A pointer is a numbered file that is put under its name in one move; the highest number holds, so a crash leaves the old or the new
    graph and never none. Verbs that write take the folder's lock.
    """

    spark: SparkSession
    root: str
    internal_domains: list[str] = field(default_factory=list)
    ontology: Ontology = field(default_factory=Ontology)

    def _fs(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _write_text(self, name: str, text: str) -> None:
        fs, draft = self._fs(f"{name}.{uuid.uuid4().hex}.draft")
        out = fs.create(draft)
        out.write(bytearray(text.encode()))
        out.close()
        fs.rename(draft, self._fs(name)[1])

    @contextmanager
    def _writing(self):
        """One writer at a time: the lock is a file that only one can create."""
        fs, path = self._fs("LOCK")
        try:
            fs.create(path, False).close()
        except Exception as e:  # noqa: BLE001  the file system's own kind of "it exists"
            raise RuntimeError(f"another writer holds {self.root}/LOCK; if it died, unlock()") from e
        try:
            yield
        finally:
            fs.delete(path, False)

    def unlock(self) -> None:
        fs, path = self._fs("LOCK")
        fs.delete(path, False)

    def _pointers(self) -> list[str]:
        fs, path = self._fs("pointers")
        return sorted(s.getPath().getName() for s in (fs.listStatus(path) if fs.exists(path) else []) if s.getPath().getName().endswith(".json"))

    def _pointer(self) -> dict:
        names = self._pointers()
        return json.loads("".join(r[0] for r in self.spark.read.text(f"{self.root}/pointers/{names[-1]}").collect())) if names else {}

    def _point(self, tables: dict) -> None:
        names = self._pointers()
        self._write_text(f"pointers/{int(names[-1].split('.')[0]) + 1 if names else 1:012d}.json", json.dumps(tables))

    def table(self, name: str) -> DataFrame:
        at = self._pointer().get(name)
        if not at:
            raise LookupError(f"no table {name}: nothing has been ingested")
        return self.spark.read.parquet(f"{self.root}/{at}")

    def _read(self, name: str, schema: str) -> DataFrame:
        fs, path = self._fs(name)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}") if fs.exists(path) else self.spark.createDataFrame([], schema)

    def _log(self) -> DataFrame:
        return self._read(self._pointer().get("documents", "documents/1"), LOG)

    def _audit(self, rows: DataFrame) -> None:
        """rows: action, object_type, object_id, detail. Append only: there is no verb that rewrites the log."""
        rows.select(F.expr("uuid()").alias("audit_id"), F.current_timestamp().alias("at"), "action", "object_type", "object_id", "detail").write.mode("append").parquet(f"{self.root}/audit")

    def _note(self, action: str, object_type: str, object_id: str, detail: str) -> None:
        self._audit(self.spark.range(1).select(*[F.lit(v).alias(k) for k, v in (("action", action), ("object_type", object_type), ("object_id", object_id), ("detail", detail))]))

    def documents(self) -> DataFrame:
        """The current version of each document, numbered in order of processing."""
        log = self._log()
        now = incremental.latest_versions(log.select("document_id", "version_id", "updated_at", "seq", "deleted"))
        kept = log.where("not deleted").join(now.select("document_id", "version_id"), ["document_id", "version_id"], "left_semi")
        return kept.groupBy("document_id").agg(F.max_by(F.struct(*[c for c in kept.columns if c != "document_id"]), "doc_seq").alias("d")).select("document_id", "d.*").drop("seq", "deleted")

    def _changes(self, new: compiler.Graph) -> DataFrame:
        """What the new graph makes, removes and renames, as rows for the audit log."""
        old = self._pointer()
        read = lambda name: self.spark.read.parquet(f"{self.root}/{old[name]}") if name in old else getattr(new, name).limit(0)
        say = lambda df, action, kind, key, detail: df.select(F.lit(action).alias("action"), F.lit(kind).alias("object_type"), F.col(key).alias("object_id"), detail.cast("string").alias("detail"))
        was, now = read("entities").select("entity_id", "canonical_name"), new.entities.select("entity_id", "canonical_name")
        renamed = was.withColumnRenamed("canonical_name", "before").join(now, "entity_id").where("not (before <=> canonical_name)")
        out = say(now.join(was, "entity_id", "left_anti"), "create_entity", "entity", "entity_id", F.col("canonical_name"))
        out = out.union(say(was.join(now, "entity_id", "left_anti"), "delete_entity", "entity", "entity_id", F.col("canonical_name")))
        out = out.union(say(renamed, "rename", "entity", "entity_id", F.concat_ws(" -> ", "before", "canonical_name")))
        linked = lambda df: df.where("method = 'address_pattern'").select("entity_id", "local_id").distinct()
        fresh = linked(new.entity_decisions).join(linked(read("entity_decisions")), ["entity_id", "local_id"], "left_anti")
        out = out.union(say(fresh, "identity_linked", "entity", "entity_id", F.col("local_id")))
        edges = lambda df: df.select("edge_id", "relation")
        mine, past = edges(new.edges), edges(read("edges"))
        out = out.union(say(mine.join(past, "edge_id", "left_anti"), "create_edge", "edge", "edge_id", F.col("relation")))
        return out.union(say(past.join(mine, "edge_id", "left_anti"), "delete_edge", "edge", "edge_id", F.col("relation")))

    def _reviews(self, raised: DataFrame) -> DataFrame:
        """The queue after a run: what is raised is open; an item that no document raises any more is closed, or resolved if the ontology now knows its suggestion."""
        if "reviews" not in self._pointer():
            return raised
        past = self.table("reviews").join(raised.select("dedupe_key"), "dedupe_key", "left_anti").select(raised.columns)
        words = type_table(self.spark, self.ontology).select(F.concat(F.lit("entity:"), "suggestion").alias("suggestion"))
        words = words.union(relation_table(self.spark, self.ontology).select(F.concat(F.lit("relation:"), "suggestion"))).distinct()
        past = review.close_removed(review.reconcile(past, words), raised.select("dedupe_key")).select(raised.columns)
        return raised.unionByName(past)

    def _kept(self, new: compiler.Graph) -> DataFrame:
        """The entities, and those that nothing supports any more but a person has decided about."""
        if "entities" not in self._pointer():
            return new.entities
        decided = self._read("review_decisions", DECISION).select("dedupe_key").distinct().join(self.table("reviews"), "dedupe_key").select(F.explode("related").alias("entity_id")).distinct()
        gone = self.table("entities").join(new.entities.select("entity_id"), "entity_id", "left_anti")
        refs = new.entity_decisions.where("entity_id is not null").select("entity_id")
        drop = incremental.unreferenced(gone, refs, new.edges, decided)
        return new.entities.unionByName(gone.join(drop.select("entity_id"), "entity_id", "left_anti").select(new.entities.columns))

    def compile(self) -> dict[str, int]:
        with Work(self.spark) as work:
            g = compiler.compile_graph(self.documents(), self.internal_domains, self.ontology, work.hold)
            g.entities, g.reviews = work.hold(self._kept(g)), work.hold(self._reviews(g.reviews))
            run, pointer, counts = uuid.uuid4().hex[:12], self._pointer(), {}
            for name in TABLES:
                getattr(g, name).write.parquet(f"{self.root}/{name}/{run}")
                counts[name] = self.spark.read.parquet(f"{self.root}/{name}/{run}").count()
            self._audit(self._changes(g))
            self._point(pointer | {name: f"{name}/{run}" for name in TABLES})
        return counts

    def _append(self, rows: DataFrame, deleted: bool) -> int:
        """Numbers the rows in their order after all there are: each partition's rows follow those of the partitions before."""
        with Work(self.spark) as work:
            rows = work.hold(rows.withColumn("place", F.monotonically_increasing_id() if deleted else F.col("doc_seq")))
            part = F.shiftright("place", 33)
            sizes = rows.groupBy(part.alias("p")).agg((F.max(F.col("place").bitwiseAND(F.lit((1 << 33) - 1))) + 1).alias("n"), F.count("*").alias("rows")).orderBy("p").collect()
            if not sizes:
                return 0
            last = self._log().agg(F.coalesce(F.max("seq"), F.lit(0)).alias("seq"), F.coalesce(F.max("doc_seq"), F.lit(-1)).alias("doc_seq")).first()
            starts, at = [], last["doc_seq"] + 1
            for s in sizes:
                starts.append((s["p"], at))
                at += s["n"]
            starts = self.spark.createDataFrame(starts, "p long, start long")
            numbered = rows.withColumn("p", part).join(F.broadcast(starts), "p").withColumn("doc_seq", F.col("start") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)))
            numbered = numbered.withColumn("seq", F.lit(last["seq"] + 1)).withColumn("deleted", F.lit(deleted))
            numbered.select(*self._log().columns).write.mode("append").parquet(f"{self.root}/{self._pointer().get('documents', 'documents/1')}")
            return sum(s["rows"] for s in sizes)

    def ingest(self, path: str, prune: bool = False, force: bool = False) -> dict:
        """Reads a folder; versions already processed by this pipeline under this ontology are skipped; with prune, documents of its systems that are gone are deleted."""
        with self._writing(), Work(self.spark) as work:
            known = self._read("ontologies", "version string, checksum string")
            register(self.spark, known if known.count() else None, self.ontology)
            if not known.where(F.col("version") == self.ontology.version).count():
                register(self.spark, None, self.ontology).write.mode("append").parquet(f"{self.root}/ontologies")
            good, bad = read_files(self.spark, path, work.hold)
            good = work.hold(good)
            now = self.documents()
            new = good.join(now.select("document_id", "version_id"), ["document_id", "version_id"], "left_anti")
            new = new.join(incremental.stale(new.select("document_id", "version_id", "updated_at"), now).select("document_id", "version_id"), ["document_id", "version_id"], "left_anti").select(good.columns)
            failed = bad.count()
            out = {"read": good.count(), "failed": failed, "new": self._append(new, False), "pruned": 0}
            if prune and not failed:
                gone = incremental.prune(now.select(F.col("source_system").alias("system"), "document_id"), good.select(F.col("source_system").alias("system"), "document_id"), force=force)
                out["pruned"] = self._append(now.join(gone.select("document_id"), "document_id", "left_semi").select(good.columns), True)
            ledger = self._read("processed", LEDGER)
            stamps = self.documents().select("version_id", F.lit(PIPELINE).alias("pipeline_version"), F.lit(self.ontology.checksum()).alias("ontology_checksum"))
            todo = incremental.to_process(stamps, ledger)
            if out["pruned"] or todo.limit(1).count() or not self._pointer().get("edges"):
                out["tables"] = self.compile()
                todo.write.mode("append").parquet(f"{self.root}/processed")
            self._note("ingest", "run", path, json.dumps(out))
        return out

    def forget(self, system: str, external_id: str) -> bool:
        """Deletes a document with all that only it supports; False if it is not known."""
        with self._writing():
            n = self._append(self.documents().where((F.col("source_system") == system) & (F.col("external_id") == external_id)), True)
            if n:
                self.compile()
                self._note("forget", "document", f"{system}:{external_id}", "")
        return bool(n)

    def gc(self) -> int:
        """Drops versions of documents that a later one replaced, and table versions and pointers that do not hold; returns how many of these there were."""
        with self._writing():
            pointer, log, n = self._pointer(), self._log(), 0
            last = log.groupBy("document_id").agg(F.max("doc_seq").alias("doc_seq"))
            current = self.documents().select("document_id", "doc_seq")
            # the last row of a document says that it is deleted, or how late a version may be
            kept = log.join(last.union(current).distinct(), ["document_id", "doc_seq"], "left_semi")
            n += (dropped := log.count() - kept.count())
            if dropped:
                folder = f"documents/{int(pointer.get('documents', 'documents/1').split('/')[1]) + 1}"
                kept.write.mode("overwrite").parquet(f"{self.root}/{folder}")
                pointer["documents"] = folder
                self._point(pointer)
            held = {*pointer.values(), pointer.get("documents", "documents/1")}
            for name in (*TABLES, "documents"):
                fs, path = self._fs(name)
                for s in fs.listStatus(path) if fs.exists(path) else []:
                    if f"{name}/{s.getPath().getName()}" not in held:
                        fs.delete(s.getPath(), True)
                        n += 1
            for old in self._pointers()[:-1]:
                fs, path = self._fs(f"pointers/{old}")
                fs.delete(path, False)
        return n

    def entities(self, entity_type: str | None = None) -> DataFrame:
        view = graph.entity_view(self.table("entities"), self.table("identifiers"), self.table("aliases"))
        return view.where(F.col("entity_type") == entity_type) if entity_type else view

    def entity(self, name: str) -> DataFrame:
        return graph.find_entity(self.table("entities"), self.table("identifiers"), self.table("aliases"), identifier=name if "@" in name else None, name=None if "@" in name else name)

    def edges(self, relation: str | None = None, source_type: str | None = None, target_type: str | None = None) -> DataFrame:
        return graph.get_edges(graph.edge_view(self.table("edges"), self.table("entities")), source_type, relation, target_type)

    def why(self, source_id: str, relation: str, target_id: str) -> dict[str, DataFrame]:
        """The edge, its evidence, the decisions behind it, and what the audit log has of it and of its ends."""
        edge = self.spark.range(1).select(E.uuid5(F.lit(f"{source_id}|{relation}|{target_id}"))).first()[0]
        audit = self._read("audit", AUDIT).where(F.col("object_id").isin(edge, source_id, target_id)).orderBy("at", "audit_id")
        return graph.explain_edge(self.table("edges"), self.table("evidence"), self.documents().select("document_id", "title"), self.table("decisions"), source_id, relation, target_id) | {"audit": audit}

    def audit(self, object_id: str | None = None) -> DataFrame:
        log = self._read("audit", AUDIT)
        return (log.where(F.col("object_id") == object_id) if object_id else log).orderBy("at", "audit_id")

    def model(self) -> Model:
        """People, organizations, events and who took part, from the graph: what every relationship operator runs on."""
        entities, edges = self.table("entities").where("status = 'active'"), self.table("edges")
        orgs = entities.where("entity_type = 'Organization'").select(F.col("entity_id").alias("org_id"), F.col("canonical_name").alias("name"), F.coalesce(F.col("properties")["is_internal"] == "true", F.lit(False)).alias("is_internal"))
        works = edges.where("relation = 'WORKS_AT' and status = 'active'").select(F.col("source_id").alias("person_id"), F.col("target_id").alias("org_id"))
        first = works.join(orgs, "org_id").groupBy("person_id").agg(F.min(F.struct("name", "org_id"))["org_id"].alias("org_id"))
        people = entities.where("entity_type = 'Person'").select(F.col("entity_id").alias("person_id"), F.col("canonical_name").alias("name")).join(first, "person_id", "left")
        return Model(people, orgs, interactions.events_from_entities(entities), interactions.parts_from_edges(edges), works, self.table("identifiers"), self.table("aliases"), self.documents())

    def tools(self, asker_email: str | None = None):
        """The described tools over this graph, as of a person if an address is given."""
        from attesta.operators.tools import Tools

        model = self.model()
        passages = model.documents.select(F.col("document_id").alias("doc_id"), render.own_text(F.col("sections")).alias("text"))
        asker = interactions.person_of_email(model.identifiers, asker_email) if asker_email else None
        return Tools(model, passages, model.documents, asker)

    def view(self, name: str, depth: int = 2, fanout: int = 25) -> str:
        """The neighbourhood of the entity of that name as a page."""
        center = self.entity(name).first()
        if center is None:
            raise LookupError(f"nothing is called {name}")
        with Work(self.spark) as work:
            near = work.hold(interactions.neighborhood(self.table("edges"), center["entity_id"], depth, fanout, keep=work.hold))
            nodes = self.table("entities").join(near.select(F.col("node_id").alias("entity_id")).distinct(), "entity_id", "left_semi")
            ends = near.select("node_id").distinct()
            edges = self.table("edges").join(ends, F.col("source_id") == F.col("node_id"), "left_semi").join(ends, F.col("target_id") == F.col("node_id"), "left_semi")
            return render.graph_html([{"id": r.entity_id, "name": r.canonical_name or "", "type": r.entity_type} for r in nodes.collect()], [{"source": r.source_id, "target": r.target_id, "relation": r.relation} for r in edges.collect()], name)

    def network(self, top: int = 60) -> str:
        """The people who write most among each other, as a page."""
        with Work(self.spark) as work:
            m = self.model()
            edges = work.hold(interactions.people_network(m.parts, top, keep=work.hold))
            ends = edges.select(F.explode(F.array("sender_id", "receiver_id")).alias("person_id")).distinct()
            nodes = ends.join(m.people, "person_id", "left")
            return render.graph_html([{"id": r.person_id, "name": r.name or "", "type": "Person"} for r in nodes.collect()], [{"source": r.sender_id, "target": r.receiver_id, "relation": str(r.emails)} for r in edges.collect()], "people")

    def reviews(self, status: str | None = None, review_type: str | None = None) -> DataFrame:
        items = review.resolve(self.table("reviews"), self._read("review_decisions", DECISION))
        return review.list_items(items, status, review_type)

    def resolve(self, dedupe_key: str, status: str, reviewer: str, note: str = "") -> None:
        if status not in ("APPROVED", "REJECTED", "DEFERRED"):
            raise ValueError("a review is APPROVED, REJECTED or DEFERRED")
        row = self.spark.range(1).select(F.lit(dedupe_key).alias("dedupe_key"), F.lit(status).alias("status"), F.lit(reviewer).alias("reviewer"), F.lit(note).alias("note"), F.current_timestamp().alias("decided_at"))
        row.write.mode("append").parquet(f"{self.root}/review_decisions")
        self._note("resolve", "review", dedupe_key, status)

    def stats(self) -> DataFrame:
        return graph.stats(self.table("entities"), self.table("edges"), self.table("evidence"), self.documents(), self.reviews())

    def index(self, sink, everything: bool = False, distributed: bool = False) -> int:
        """Sends documents to sink(action, rows), all or those whose version was not sent; returns how many were confirmed.

        distributed: the executors call the sink, each for its own partition, and confirmations are rows of a table; otherwise the driver does.
        """
        done = self._read("indexed", "document_id string, version_id string, at timestamp")
        last = done.groupBy("document_id").agg(F.max_by("version_id", "at").alias("version_id"))
        docs = self.documents()
        todo = docs if everything else docs.join(last, ["document_id", "version_id"], "left_anti")
        gone = last.where("version_id is not null").join(docs.select("document_id"), "document_id", "left_anti").select("document_id", F.lit(None).cast("string").alias("version_id"), F.lit(None).cast("string").alias("text"), F.lit("delete").alias("action"))
        emails = self.table("identifiers").where("identifier_type = 'email'").join(self.table("entities").select("entity_id", "canonical_name"), "entity_id").select("value", "canonical_name")
        up = render.index_documents(todo, emails).withColumn("action", F.lit("upsert"))
        queue = up.select("document_id", "version_id", "text", "action").union(gone.select("document_id", "version_id", "text", "action"))
        if distributed:
            sent = 0
            for action in ("delete", "upsert"):
                path = f"{self.root}/indexed"
                before = self._read("indexed", done.schema).count()
                incremental.drain_partitions(queue.where(F.col("action") == action), sink).withColumn("at", F.current_timestamp()).write.mode("append").parquet(path)
                sent += self._read("indexed", done.schema).count() - before
            return sent
        rows = incremental.drain(queue, sink)
        if rows:
            table = self.spark.createDataFrame([(r["document_id"], r["version_id"]) for r in rows], "document_id string, version_id string")
            table.withColumn("at", F.current_timestamp()).write.mode("append").parquet(f"{self.root}/indexed")
        return len(rows)

    def reset(self, yes: bool = False) -> None:
        """Deletes everything; only when asked for twice."""
        if not yes:
            raise ValueError("reset deletes the graph: say yes=True")
        fs, path = self._fs("")
        fs.delete(path, True)
