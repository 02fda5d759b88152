"""The engine's verbs end to end, linking, rendering and the question loop."""

import json

import pytest
from pyspark.sql import functions as F

from attesta.functions import text
from attesta.operators import answer, linking, render, verify
from attesta.plans.store import Engine


def write(folder, k, **more):
    d = {"message_id": str(k), "from": "Ann Lee <ann.lee@acme.com>", "to": ["bo.ray@other.org"], "date": f"2023-09-{k:02d}T10:00:00Z", "subject": f"mail {k}", "body": f"text {k}"} | more
    (folder / f"{k}.json").write_text(json.dumps(d))


def test_engine(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for k in (1, 2):
        write(src, k)
    (src / "bad.json").write_text("{}")
    e = Engine(spark, str(tmp_path / "graph"), ["acme.com"])
    with pytest.raises(LookupError):
        e.table("edges")
    first = e.ingest(str(src))
    assert (first["read"], first["failed"], first["new"]) == (2, 1, 2)
    assert e.ingest(str(src))["new"] == 0  # nothing changed
    assert e.edges("WORKS_AT").count() == 2 and e.entities("Person").count() == 2
    assert e.entity("ann.lee@acme.com").first().canonical_name == "Ann Lee" and e.entity("ann lee").count() == 1
    s = e.stats().first()
    assert (s.documents, s.unsupported_edges) == (2, 0)
    works = e.edges("WORKS_AT").where("source_name = 'Ann Lee'").first()
    why = e.why(works.source_id, "WORKS_AT", works.target_id)
    assert why["edge"].count() == 1 and why["evidence"].count() == 2 and why["decisions"].count() == 2
    said = {(r.action, r.object_type) for r in why["audit"].collect()}
    assert said == {("create_edge", "edge"), ("create_entity", "entity")} and why["audit"].count() == 3
    assert e.audit().where("action = 'ingest'").count() == 2 and e.audit(works.source_id).count() == 1
    assert "Ann Lee" in e.view("Ann Lee", 1)
    sent = []
    assert e.index(lambda a, rows: sent.extend((a, r["text"]) for r in rows) or rows) == 2 and "sender: Ann Lee" in sent[0][1]
    assert e.index(lambda a, rows: rows) == 0
    write(src, 2, to=["cy.dow@other.org"])  # replaced
    (src / "bad.json").unlink()
    (src / "1.json").unlink()
    out = e.ingest(str(src), prune=True)
    assert out["new"] == 1 and out["pruned"] == 0  # half of the system would go
    assert e.ingest(str(src), prune=True, force=True)["pruned"] == 1
    assert {r.canonical_name for r in e.entities("Person").collect()} == {"Ann Lee", "Cy Dow"}
    assert e.gc() > 0 and e.gc() == 0 and len(e._pointers()) == 1
    assert {r.action for r in e.audit().where("object_type = 'entity'").collect()} == {"create_entity", "delete_entity"}
    assert e.forget("email", "2") and not e.forget("email", "2") and e.entities().count() == 0
    e.resolve("k", "APPROVED", "me")
    with pytest.raises(ValueError):
        e.resolve("k", "MAYBE", "me")
    with pytest.raises(ValueError):
        e.reset()
    e.reset(yes=True)
    assert e._pointer() == {}


def test_one_writer_and_whole_pointers(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    write(src, 1)
    e = Engine(spark, str(tmp_path / "graph"))
    with e._writing():
        with pytest.raises(RuntimeError):
            e.ingest(str(src))
    e.ingest(str(src))
    before = e._pointer()
    (tmp_path / "graph" / "pointers" / "000000000009.json.x.draft").write_text("half")  # a writer that died
    assert e._pointer() == before


def test_reviews_live_and_decisions_hold(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    write(src, 1)
    write(src, 2, **{"from": "Ann Lee"})  # the name is known, with an address
    e = Engine(spark, str(tmp_path / "graph"), ["acme.com"])
    e.ingest(str(src))
    asked = e.reviews("OPEN").collect()
    assert [r.review_type for r in asked] == ["AMBIGUOUS_ENTITY_MATCH"] and e.entities("Person").where("canonical_name = 'Ann Lee'").count() == 1
    ann = asked[0].related[0]
    assert e.edges("AUTHORED_BY").count() == 1 and e.table("decisions").where("decision = 'HELD'").count() >= 1
    e.resolve(asked[0].dedupe_key, "REJECTED", "me", "another Ann")
    assert e.reviews("REJECTED").count() == 1
    for k in (1, 2):
        assert e.forget("email", str(k))
    # nothing supports Ann any more, but a person has decided about her
    assert [r.entity_id for r in e.table("entities").collect()] == [ann]
    assert e.reviews("OPEN").count() == 0 and e.table("reviews").first().status == "SOURCE_REMOVED"


def test_questions_on_a_compiled_graph(spark, tmp_path):
    from attesta.__main__ import main
    from attesta.operators.context import graph_context

    src = tmp_path / "in"
    src.mkdir()
    write(src, 1)
    write(src, 2, **{"from": "Bo Ray <bo.ray@other.org>", "to": ["ann.lee@acme.com"], "subject": "gas price", "body": "gas rose to 7 dollars"})
    write(src, 3, to=["bo.ray@other.org", "Åsa Öberg <asa.oberg@other.org>"], cc=["cy.dow@acme.com"])
    e = Engine(spark, str(tmp_path / "graph"), ["acme.com"])
    e.ingest(str(src))
    m, t = e.model(), e.tools("cy.dow@acme.com")
    assert {r.name for r in m.people.collect()} == {"Ann Lee", "Bo Ray", "Cy Dow", "Åsa Öberg"} and t.asker
    assert [c["name"] for c in t.call("find", {"name": "ÅSA ÖBERG", "type": None})["candidates"]] == ["Åsa Öberg"]
    ann = t.call("find", {"name": "ann.lee@acme.com"})["candidates"][0]
    bo = t.call("find", {"name": "bo"})["candidates"][0]
    assert (bo["name"], bo["email"], bo["organization"], bo["score"]) == ("Bo Ray", "bo.ray@other.org", "other.org", 1)
    assert [c["type"] for c in t.call("find", {"name": "gas price", "type": "Document"})["candidates"]] == ["Document"]
    other = t.call("find", {"name": "Other", "type": "Organization"})["candidates"][0]
    got = t.call("interactions", {"entity": ann["id"], "other": other["id"], "kind": "any", "limit": 1})
    assert got["totals"]["emails"] == 3 and (got["totals"]["a_to_b"], got["totals"]["b_to_a"]) == (2, 1) and len(got["by_person"]) == 2
    ref = got["events"][0]["ref"]
    assert t.ledger.source(ref)["document_id"] and len(got["events"]) == 2  # the newest and the oldest
    assert "is one of" in t.call("interactions", {"entity": ann["id"], "kind": "fax"})["error"] and "nobody" in t.call("contacts", {"entity": "x"})["error"] and "needs" in t.call("find", {})["error"]
    c = graph_context(m, "How often did Ann Lee write to Bo Ray of Other?", "cy.dow@acme.com")
    assert {x["name"] for x in c.linked} == {"Cy Dow", "Ann Lee", "Bo Ray", "other.org"} and not c.ambiguous
    for part in ("Ann Lee wrote to Bo Ray 2 times, last 2023-09-03 [G", "Bo Ray wrote to Ann Lee 1 times", "Email addresses: ann.lee@acme.com. Employer by email domain: acme.com.", "Emails sent: 2, received: 1; active 2023-09-01 to 2023-09-03; contacts: 3.", "other.org (Organization, an external organization). 2 known people", "People at other.org who have dealt with Ann Lee (2 addresses", "The person asking is Cy Dow"):
        assert part in c.facts, (part, c.facts)
    assert set(c.sources) == {f"G{k}" for k in range(1, len(c.sources) + 1)} and all(s["document_id"] for s in c.sources.values())
    unclear = graph_context(m, "who?", None, [("nobody", None), ("bo", "other")], [("Nowhere", None)])
    assert unclear.unknown == ["Nowhere", "nobody"] and [x["name"] for x in unclear.linked] == ["Bo Ray"]
    from attesta.operators import interactions

    ways = interactions.document_of(m.identifiers, m.documents)
    assert ways.count() == 3
    near = {r.node_id: r.distance for r in interactions.neighborhood(e.table("edges"), ann["id"], 1, 1).collect()}
    assert len(near) == 3 and sorted(near.values()) == [0, 1, 1]  # the newest edge, and the employer
    assert "Ann Lee" in e.network()
    assert main([e.root, "stats"], spark) == 0 and main([e.root, "entity", "Ann Lee"], spark) == 0 and main([str(tmp_path / "none"), "edges"], spark) == 1


def test_distributed_index(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for k in (1, 2, 3):
        write(src, k)
    e = Engine(spark, str(tmp_path / "graph"))
    e.ingest(str(src))
    assert e.index(lambda action, rows: [r for r in rows if "text 3" not in r["text"]], distributed=True) == 2
    assert e.index(lambda action, rows: rows, distributed=True) == 1 and e.index(lambda action, rows: rows, distributed=True) == 0


def test_link_entities(spark):
    ents = spark.createDataFrame([("p1", "Person", "Ann Lee", "active"), ("p2", "Person", "Bo Ray", "active"), ("p3", "Person", "Bo Ray", "active"), ("o1", "Organization", "acme.com", "active"), ("o2", "Organization", "Big Gas Co", "active"), ("p4", "Person", "Cy Dow", "gone")], "entity_id string, entity_type string, canonical_name string, status string")
    ids = spark.createDataFrame([("p2", "email", "bo@acme.com"), ("o1", "domain", "acme.com")], "entity_id string, identifier_type string, value string")
    aliases = spark.createDataFrame([("p1", "A. B. Lee")], "entity_id string, alias string")
    q = spark.createDataFrame([(1, "Did Ann Lee meet Bo Ray of Acme?"), (2, "mail of bo@acme.com, a. b. lee and Big Gas Co."), (3, "acme and cy dow"), (4, "")], "question_id long, text string")
    got = {(r.question_id, r.gram, r.entity_id) for r in linking.link_entities(q, ents, ids, aliases).collect()}
    assert {(1, "ann lee", "p1"), (1, "acme", "o1"), (2, "bo@acme.com", "p2"), (2, "big gas co", "o2")} <= got
    assert not {x for x in got if x[0] in (3, 4) or x[2] in ("p3", "p4")} and (2, "p1") in {(a, c) for a, _, c in got}


def test_candidates(spark):
    people = spark.createDataFrame([("p1", "Ann Lee", "o1"), ("p2", "Anna Lee", "o2"), ("p3", "Bo Ann", "o1")], "person_id string, name string, org_id string")
    orgs = spark.createDataFrame([("o1", "Acme"), ("o2", "Acmeville")], "org_id string, name string")
    parts = spark.createDataFrame([("e1", "p1", "sender"), ("e1", "p3", "to"), ("e2", "p2", "to"), ("e2", "p3", "sender"), ("e3", "p2", "to"), ("e3", "p3", "sender")], "event_id string, person_id string, role string")
    ids = lambda df: {r[0] for r in df.collect()}
    assert ids(linking.person_candidates(people, "ann")) == {"p1"} and ids(linking.person_candidates(people, "ann lee")) == {"p1"} and ids(linking.person_candidates(people, "an lee")) == {"p1", "p2"} and ids(linking.person_candidates(people, " ")) == set()
    assert ids(linking.org_candidates(orgs, "acme")) == {"o1"} and ids(linking.org_candidates(orgs, "acmev")) == {"o2"} and ids(linking.org_candidates(orgs, "ac")) == set()
    assert [(r.id, r.score) for r in linking.find(people, orgs, parts, "an lee", "p3").collect()] == [("p2", 2), ("p1", 1)]
    got = linking.resolve_mentions(people, orgs, parts, [("an lee", None), ("an lee", "Acme"), ("nobody", None)])
    assert [(g["outcome"], g["candidates"]) for g in got] == [("ambiguous", ["p2", "p1"]), ("linked", ["p1"]), ("unknown", [])]


def test_reading(spark):
    kind = "document_id string, version_id string, title string, participants array<struct<name:string,email:string,role:string>>, sections array<struct<kind:string,text:string>>"
    docs = spark.createDataFrame([("d", "v", "T", [("x", "A@b", "sender"), ("Y", None, "to")], [("body", "z" * 13_000), ("quoted", "old")]), ("f", "v", None, [], [("quoted", "only")])], kind)
    a = render.read_page(docs, "d").first()
    assert (len(a.text), a.next_offset) == (12_000, 12_000)
    b = render.read_page(docs, "d", 12_000).first()
    assert (len(b.text), b.next_offset) == (1_000, None) and render.read_page(docs, "f").first().text == "only"
    names = spark.createDataFrame([("a@b", "Ann")], "email string, name string")
    got = {r.document_id: r.text for r in render.index_documents(docs, names).collect()}
    assert got["d"].startswith("T\nsender: Ann\nto: Y\n\nzzz") and got["f"].strip() == "only"


def test_question_loop(spark):
    script = iter([{"tool": "count", "args": {"who": "ann"}}, {"tool": "none"}, {"parts": [{"text": "9 mails.", "citations": [{"ref": "G1"}]}, {"text": "Fine."}]}, {"parts": [{"text": "3 mails.", "citations": [{"ref": "G1"}]}]}])
    seen = []

    def model(messages):
        seen.append(messages[-1]["content"])
        return next(script)

    out = answer.answer(spark, "how many?", {"count": lambda ledger, who: ledger.add("graph", who, "3 mails")}, model)
    assert out["accepted"] and out["parts"][0]["text"] == "3 mails." and seen[1] == "G1" and "KeyError" in seen[2] and "9" in seen[3]
    always = answer.answer(spark, "?", {}, lambda m: {"parts": [{"text": "7 mails."}, {"text": "Yes."}]})
    assert not always["accepted"] and [p["text"] for p in always["parts"]] == ["Yes."]
    assert answer.answer(spark, "?", {}, lambda m: {"clarify": "who?"}) == {"clarify": "who?"}


def test_routes_and_runs(tmp_path):
    say = lambda r: lambda q: {"route": r}
    facts = {"facts": ["f"], "answer": "3 mails [G1].", "sources": {"G1": {"title": "t"}, "G2": {"title": "u"}}}
    content = lambda q, f: {"text": "they met"}
    got = answer.route("q", say("mixed"), lambda q: facts, content)
    assert got["route"] == "mixed" and got["text"].endswith("they met") and got["citations"] == [{"marker": "G1", "title": "t"}]
    assert answer.route("q", say("relationship"), lambda q: facts, content)["citations"] == [{"marker": "G1", "title": "t"}]
    assert answer.route("q", say("relationship"), lambda q: 1 / 0, content)["route"] == "content"
    asked = [{"mention": "Sam", "type": "Person", "relative_to_asker": True, "candidates": [{"name": "Sam Lee", "email": "s@x", "organization": "X", "score": 3}, {"name": "Sam Ray", "score": 2}]}]
    back = answer.route("q", say("relationship"), lambda q: {"ambiguous": asked}, content)
    assert back["route"] == "clarify" and "1. Sam Lee <s@x>, X (3 emails with you)" in back["clarify"] and "2. Sam Ray (2 emails" in back["clarify"]
    assert answer.system_prompt("Be brief.", "- 3 mails [G1]").endswith("- 3 mails")
    out, calls = tmp_path / "a.jsonl", []
    ask = lambda q: calls.append(q["id"]) or ({"answer": q["text"]} if q["text"] else 1 / 0)
    assert answer.run_questions([{"id": 1, "text": "a"}, {"id": 2, "text": ""}], ask, str(out)) == 2
    assert answer.run_questions([{"id": 1, "text": "a"}, {"id": 3, "text": "c"}], ask, str(out)) == 1 and calls == [1, 2, 3]
    assert len(out.read_text().splitlines()) == 3 and "ZeroDivisionError" in out.read_text()


def test_route():
    say = lambda r: lambda q: {"route": r}
    graph, empty, content = lambda q: {"facts": ["f"]}, lambda q: {"facts": []}, lambda q, f: {"text": f"t{len(f or [])}"}
    assert answer.route("q", say("relationship"), graph, content)["route"] == "relationship"
    assert answer.route("q", say("relationship"), empty, content) == {"route": "content", "facts": [], "text": "t0"}
    assert answer.route("q", say("mixed"), graph, content)["route"] == "mixed"
    assert answer.route("q", say("clarify"), graph, content)["route"] == "clarify"
    assert answer.route("q", lambda q: 1 / 0, graph, content)["route"] == "content"


def test_tools(spark, sf_dir):
    from attesta.operators.tools import Tools
    from attesta.plans.projection import load

    t = Tools(load(spark, sf_dir), passages=spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), asker="s:5")
    assert {x["name"] for x in t.describe()} == {"find", "interactions", "contacts", "participants", "search", "read"}
    found = t.call("find", {"name": "Customer#000000005"})
    assert found["candidates"][0]["id"] == "c:5" and found["candidates"][0]["ref"] == "G1"
    got = t.call("interactions", {"entity": "n:3", "other": "n:7"})
    assert got["totals"]["emails"] > 0 and got["events"] and got["by_person"]
    assert t.call("contacts", {"entity": "n:3", "limit": 99})["count"] >= len(t.call("contacts", {"entity": "n:3", "limit": 5})["contacts"]) == 5
    assert t.call("participants", {"event": "o:3"})["participants"]
    assert t.call("search", {"query": "license version"})["passages"][0]["ref"].startswith("S")
    assert "no tool" in t.call("dance", {})["error"] and "has no" in t.call("find", {"x": 1})["error"] and "error" in t.call("read", {"document": "d"})


def test_long_numbers(spark):
    rows = [("a", "007 then 9223372036854775808, 12 and 1234567890123456789012, 0", None), ("b", "no number", None), ("c", None, None)]
    got = dict(spark.createDataFrame(rows, "k string, t string, n string").select("k", text.numbers(F.col("t"))).collect())
    assert got == {"a": ["0", "7", "12", "9223372036854775808", "1234567890123456789012"], "b": [], "c": None}
    ledger = spark.createDataFrame([("R", "text", "the total came to 0012 and 12345678901234567890 units")], "ref string, kind string, entry_text string")
    parts = [(k, t, [("R", "the total came to 0012 and 12345678901234567890 units")]) for k, t in [("good", "It was 12 and 12345678901234567890."), ("bad", "It was 12345678901234567891 and 3.")]]
    checked = verify.check_parts(spark.createDataFrame(parts, "part_id string, text string, citations array<struct<ref: string, quote: string>>"), ledger)
    assert {r.part_id: r.problems for r in checked.collect()} == {"good": [], "bad": ["numbers not in the evidence: 3, 12345678901234567891"]}


def test_many_names_are_not_sent_to_every_task(spark, tmp_path):
    from attesta.sources.work import hold

    n = 200_000
    ents = hold(spark.range(n).selectExpr("cast(id as string) entity_id", "'Person' entity_type", "concat('Ann Number', id) canonical_name", "'active' status"))
    ids = spark.createDataFrame([], "entity_id string, identifier_type string, value string")
    aliases = spark.createDataFrame([], "entity_id string, alias string")
    q = hold(spark.range(n).selectExpr("id question_id", "concat('did Ann Number', id, ' write, Ann Number', id, '?') text"))
    got = linking.link_entities(q, ents, ids, aliases)
    plan = got._jdf.queryExecution().executedPlan().toString()
    # small files, but names of several MB in memory; and each question is taken apart once
    assert plan.count("BroadcastExchange") == 0 and plan.count("Generate explode(sequence") <= 2
    assert got.count() == n


def test_name_of_two_or_of_nobody(spark):
    ents = spark.createDataFrame([("p1", "Person", "Ann Lee", "active"), ("p2", "Person", "Ann Lee", "active"), ("o1", "Organization", "annlee.com", "active"), ("o2", "Organization", "big-corp.com", "active")], "entity_id string, entity_type string, canonical_name string, status string")
    ids = spark.createDataFrame([("o1", "domain", "annlee.com"), ("o2", "domain", "bigcorp.com")], "entity_id string, identifier_type string, value string")
    q = spark.createDataFrame([(1, "Ann Lee?"), (2, "ask Big Corp"), (3, "ask big corp")], "question_id long, text string")
    got = {(r.question_id, r.gram, r.entity_id) for r in linking.link_entities(q, ents, ids, spark.createDataFrame([], "entity_id string, alias string")).collect()}
    # two people have the name, so it is no link, and not the label's either
    assert got == {(2, "big corp", "o2")}


def test_parts_follow_the_size_of_the_tables(spark, sf_dir, monkeypatch):
    from attesta.plans import projection

    monkeypatch.setattr(projection, "PIECE_BYTES", 10_000, raising=False)
    lines = projection.order_lines(spark, sf_dir)
    assert lines.rdd.getNumPartitions() > 8


def test_contacts_leave_out_people_after_counting(spark):
    from attesta.operators import interactions as I

    parts = spark.createDataFrame([("e1", "a", "sender"), ("e1", "b", "to"), ("e2", "b", "sender"), ("e2", "c", "to")], "event_id string, person_id string, role string")
    events = spark.createDataFrame([("e1", "email", "t", "2020-01-01"), ("e2", "email", "t", "2020-01-02")], "event_id string, kind string, title string, event_at string")
    people = spark.createDataFrame([(x, x, "o") for x in "abc"], "person_id string, name string, org_id string")
    orgs = spark.createDataFrame([("o", "O", False)], "org_id string, name string, is_internal boolean")
    got = I.contacts(parts, events, people, orgs, people.where("person_id = 'a'").select("person_id"))
    assert [(r.person_id, r.events) for r in got.collect()] == [("b", 1)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    # the anti-join stands above the count by person, not below it
    assert plan.index("LeftAnti") < plan.index("count(1)")


def test_texts_pass_in_small_batches(spark, sf_dir):
    from attesta.plans import graph_queries

    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    graph_queries.sections(spark, sf_dir)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 2000
