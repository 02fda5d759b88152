"""The engine's verbs on the command line: python -m attesta ROOT VERB ..."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from attesta.operators.context import graph_context
from attesta.operators.ontology import load_ontology
from attesta.plans.store import Engine

SHOWN = 1000


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="attesta", description=__doc__)
    p.add_argument("root", help="the graph's folder")
    p.add_argument("--internal", action="append", default=[], metavar="DOMAIN", help="a domain of our own; may be given again")
    p.add_argument("--ontology", metavar="FOLDER", help="JSON or YAML files instead of the default ontology")
    verbs = p.add_subparsers(dest="verb", required=True)

    def verb(name, help, *options):
        v = verbs.add_parser(name, help=help)
        for flags, more in options:
            v.add_argument(*flags, **more)

    switch = {"action": "store_true"}
    number = lambda n: {"type": int, "default": n}
    verb("ingest", "read a folder", (("path",), {}), (("--prune",), switch), (("--yes",), switch | {"help": "prune even many"}))
    verb("ontology", "the types and relations", (("--details",), switch))
    verb("entities", "list entities", (("--type",), {}))
    verb("edges", "list edges", (("--relation",), {}), (("--from",), {"dest": "source"}), (("--to",), {"dest": "target"}))
    verb("why", "what an edge rests on", (("source",), {}), (("relation",), {}), (("target",), {}))
    verb("entity", "an entity by name or address", (("name",), {}))
    verb("view", "a page of what is near an entity; of the people who write most without a name", (("name",), {"nargs": "?"}), (("--out",), {"default": "graph.html"}), (("--depth",), number(2)), (("--fanout",), number(25)), (("--top",), number(60)))
    verb("forget", "delete a document", (("system",), {}), (("id",), {}))
    verb("gc", "drop what does not hold any more")
    verb("facts", "what the graph knows about a question", (("question",), {}), (("--as",), {"dest": "asker"}), (("--json",), switch))
    verb("find", "everything that a name, address or title may mean", (("name",), {}), (("--type",), {}), (("--as",), {"dest": "asker"}))
    verb("reviews", "the review queue", (("--status",), {}), (("--type",), {}))
    verb("resolve", "decide an item of the review queue", (("key",), {}), (("status",), {"choices": ["APPROVED", "REJECTED", "DEFERRED"]}), (("--reviewer",), {"default": "cli"}), (("--note",), {"default": ""}))
    verb("audit", "the audit log", (("object",), {"nargs": "?"}))
    verb("stats", "counts")
    verb("reset", "delete the graph", (("--yes",), switch))
    return p


def lines(rows: DataFrame):
    for r in rows.limit(SHOWN).toLocalIterator():
        yield json.dumps(r.asDict(recursive=True), default=str, ensure_ascii=False)


def run(e: Engine, a: argparse.Namespace):
    """The lines that a verb says."""
    if a.verb == "ingest":
        yield json.dumps(e.ingest(a.path, a.prune, a.yes))
    elif a.verb == "ontology":
        for name, t in e.ontology.types.items():
            yield name + (f" < {t['parent']}" if t["parent"] else "") + (f": {', '.join(e.ontology.inherited(name, 'identity'))}; {', '.join(e.ontology.inherited(name, 'properties'))}" if a.details else "")
        for name, r in e.ontology.relations.items():
            yield f"{name}: {', '.join(r['source'])} -> {', '.join(r['target'])}" if a.details else name
    elif a.verb == "entities":
        yield from lines(e.entities(a.type).orderBy("entity_type", "canonical_name"))
    elif a.verb == "edges":
        yield from lines(e.edges(a.relation, a.source, a.target))
    elif a.verb == "entity":
        yield from lines(e.entity(a.name))
    elif a.verb == "why":
        for part, rows in e.why(a.source, a.relation, a.target).items():
            yield f"# {part}"
            yield from lines(rows)
    elif a.verb == "view":
        Path(a.out).write_text(e.view(a.name, a.depth, a.fanout) if a.name else e.network(a.top))
        yield a.out
    elif a.verb == "forget":
        yield "forgotten" if e.forget(a.system, a.id) else "not known"
    elif a.verb == "gc":
        yield str(e.gc())
    elif a.verb == "facts":
        c = graph_context(e.model(), a.question, a.asker)
        yield json.dumps({"facts": c.facts, "sources": c.sources, "notes": c.notes, "unknown": c.unknown, "ambiguous": c.ambiguous}, ensure_ascii=False) if a.json else c.facts or "nothing in the question is known"
    elif a.verb == "find":
        yield json.dumps(e.tools(a.asker).call("find", {"name": a.name, "type": a.type}), default=str, ensure_ascii=False)
    elif a.verb == "reviews":
        yield from lines(e.reviews(a.status, a.type))
    elif a.verb == "resolve":
        e.resolve(a.key, a.status, a.reviewer, a.note)
        yield f"{a.key}: {a.status}"
    elif a.verb == "audit":
        yield from lines(e.audit(a.object))
    elif a.verb == "stats":
        yield from lines(e.stats())
    elif a.verb == "reset":
        e.reset(a.yes)
        yield "deleted"


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("attesta").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    e = Engine(spark, a.root, a.internal, load_ontology(a.ontology))
    try:
        for line in run(e, a):
            print(line)
    except (LookupError, RuntimeError, ValueError) as error:
        print(error, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
