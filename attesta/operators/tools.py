"""The graph's functions as described tools of one question: each result row is a citable record of the ledger."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from attesta.operators import interactions as I
from attesta.operators import linking, render, search
from attesta.operators.verify import Ledger

_TEXT, _MAYBE, _COUNT = {"type": "string"}, {"type": ["string", "null"]}, {"type": ["integer", "null"]}
_KIND = {"enum": ["any", "email", "meeting", None]}
_WINDOW = {"since": _MAYBE, "until": _MAYBE}
#: Names and arguments of the tools are their interface. Tool: (arguments, those that must be given).
SCHEMAS = {
    "find": ({"name": _TEXT, "type": {"enum": ["Person", "Organization", "Meeting", "Document", None]}}, ["name"]),
    "interactions": ({"entity": _TEXT, "other": _MAYBE, "kind": _KIND, **_WINDOW, "limit": _COUNT}, ["entity"]),
    "contacts": ({"entity": _TEXT, "kind": _KIND, **_WINDOW, "scope": {"enum": ["all", "internal", "external"]}, "limit": _COUNT}, ["entity"]),
    "participants": ({"event": _TEXT}, ["event"]),
    "search": ({"query": _TEXT, "limit": _COUNT}, ["query"]),
    "read": ({"document": _TEXT, "offset": _COUNT}, ["document"]),
}


@dataclass
class Tools:
    """model: plans.projection.Model, of tables or of a graph; passages (doc_id, text) and documents are optional; asker: who asks."""

    model: object
    passages: DataFrame | None = None
    documents: DataFrame | None = None
    asker: str | None = None
    ledger: Ledger = field(default_factory=Ledger)

    def describe(self) -> list[dict]:
        return [{"name": n, "parameters": {"type": "object", "properties": p, "required": r, "additionalProperties": False}} for n, (p, r) in SCHEMAS.items()]

    def call(self, name: str, args: dict) -> dict:
        """An unknown tool, argument or value is a result, not an exception."""
        if name not in SCHEMAS:
            return {"error": f"no tool {name}"}
        known, required = SCHEMAS[name]
        if unknown := set(args) - set(known):
            return {"error": f"{name} has no {', '.join(sorted(unknown))}"}
        if missing := [k for k in required if args.get(k) is None]:
            return {"error": f"{name} needs {', '.join(missing)}"}
        for k, v in args.items():
            if "enum" in known[k] and v not in known[k]["enum"]:
                return {"error": f"{k} is one of {', '.join(str(x) for x in known[k]['enum'] if x)}"}
        try:
            return getattr(self, name)(**{k: v for k, v in args.items() if v is not None and not (k == "kind" and v == "any")})
        except Exception as e:  # noqa: BLE001
            return {"error": f"{type(e).__name__}: {e}"[:500]}

    def _records(self, rows: list, key: str, kind: str = "graph", text: str | None = None) -> list[dict]:
        out = []
        for r in rows:
            d = r.asDict(recursive=True)
            about = {"document_id": d.get("document_id") or (str(d[key]) if kind == "text" else None), "title": d.get("title") or d.get("name"), "date": d.get("event_at") or d.get("last_at")}
            body = str(d[text]) if text else " ".join(f"{k} {v}" for k, v in d.items())
            # what was shown is what a citation is checked against, so another view of a thing is another record
            out.append({"ref": self.ledger.add(kind, body, body, **about), **d})
        return out

    def _who(self, entity: str) -> DataFrame:
        who = I.people_of(self.model.people, entity, self.model.works)
        if who.limit(1).count() == 0:
            raise ValueError(f"nobody in the graph has the id {entity}: use one that find returned")
        return who

    def find(self, name: str, type: str | None = None) -> dict:  # noqa: A002  the tool's argument
        found = linking.find_records(self.model, name, type, self.asker).persist()
        rows = found.collect()
        note = f'nothing called "{name}" in the graph' if not rows else "several close candidates: ask which one, unless the question says" if linking.close_candidates(found) else None
        found.unpersist()
        return {"candidates": self._records(rows, "id"), "note": note}

    def _cited(self, events: DataFrame) -> DataFrame:
        m = self.model
        return events.join(I.document_of(m.identifiers, m.documents), "event_id", "left") if m.identifiers is not None and m.documents is not None else events

    def interactions(self, entity: str, other: str | None = None, kind: str | None = None, since: str | None = None, until: str | None = None, limit: int = 20) -> dict:
        m = self.model
        mine, theirs = self._who(entity), self._who(other) if other else None
        shared = I.shared_events(m.parts, m.events, mine, theirs, kind, since, until).persist()
        rows = self._cited(I.interaction_list(shared, limit)).orderBy("event_at", "event_id", ascending=[False, True])
        out = {"totals": I.interaction_totals(shared).first().asDict(), "events": self._records(rows.collect(), "event_id")}
        if other and theirs.limit(2).count() > 1:
            each = I.interactions_by_person(m.parts, m.events, mine, theirs, kind, since, until).join(m.people.select("person_id", "name"), "person_id", "left")
            out["by_person"] = self._records(each.orderBy("person_id").limit(30).collect(), "person_id")
        shared.unpersist()
        return out

    def contacts(self, entity: str, kind: str | None = None, since: str | None = None, until: str | None = None, scope: str = "all", limit: int = 10) -> dict:
        m = self.model
        every = I.contacts(m.parts, m.events, m.people, m.orgs, self._who(entity), kind, since, until, scope).persist()
        out = {"count": every.count(), "contacts": self._records(every.orderBy("events", "person_id", ascending=[False, True]).limit(max(1, min(limit, 30))).collect(), "person_id")}
        every.unpersist()
        return out

    def participants(self, event: str) -> dict:
        rows = I.participants(self.model.parts, self.model.people, event).collect()
        return {"participants": self._records(rows, "person_id")} if rows else {"error": f"no email or meeting {event}"}

    def search(self, query: str, limit: int = 8) -> dict:
        best = search.bm25(self.passages, query, max(1, min(limit, 12)))
        return {"passages": self._records(best.join(self.passages.select("doc_id", "text"), "doc_id").orderBy("score", "doc_id", ascending=[False, True]).collect(), "doc_id", "text", "text")}

    def read(self, document: str, offset: int = 0) -> dict:
        r = render.read_page(self.documents, document, offset).first()
        return {"error": f"no document {document}"} if r is None else {"ref": self.ledger.add("text", f"{document}@{offset}", r["text"], document), **r.asDict()}
