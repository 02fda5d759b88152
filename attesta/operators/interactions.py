"""Relationship analytics over who took part in what: parts(event_id, person_id, role) and events(event_id, kind, title, event_at).

Every operator is one declarative plan. Groups of people come in as DataFrames with a column person_id, so a company and a person
are asked about alike, and a breakdown by person is another group key and not a loop. Equal ranks are ordered by id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from attesta.sources.work import hold

SENDER, RECEIVERS = "sender", ("to", "cc", "bcc")


def parts_from_edges(edges: DataFrame) -> DataFrame:
    """Parts from the active edges of four relations (source_id, relation, target_id, recipient_type, status): one pass, no union."""
    r = F.col("relation")
    role = (
        F.when(r == "AUTHORED_BY", F.lit(SENDER)).when(r == "SENT_TO", F.coalesce("recipient_type", F.lit("to")))
        .when(r == "HAS_PARTICIPANT", F.lit("invitee")).when(r == "ATTENDED", F.lit("speaker"))
    )
    # people attend meetings: that relation alone points from the person to the event
    flip = r == "ATTENDED"
    return edges.where((F.col("status") == "active") & r.isin("AUTHORED_BY", "SENT_TO", "HAS_PARTICIPANT", "ATTENDED")).select(
        F.when(flip, F.col("target_id")).otherwise(F.col("source_id")).alias("event_id"), F.when(flip, F.col("source_id")).otherwise(F.col("target_id")).alias("person_id"), role.alias("role")
    )


def events_from_entities(entities: DataFrame) -> DataFrame:
    """Documents and meetings as events; the time is created_at or else start_time."""
    p = F.col("properties")
    return entities.where(F.col("entity_type").isin("Document", "Meeting")).select(
        F.col("entity_id").alias("event_id"), F.when(F.col("entity_type") == "Meeting", "meeting").otherwise("email").alias("kind"),
        F.col("canonical_name").alias("title"), F.coalesce(p["created_at"], p["start_time"]).alias("event_at"),
    )


def people_of(people: DataFrame, entity_id: str, works: DataFrame | None = None) -> DataFrame:
    """The people of an organization (of every employment, where works is given), or the one person of that id."""
    staff = (people if works is None else works).where(F.col("org_id") == entity_id).select("person_id")
    return staff.union(people.where(F.col("person_id") == entity_id).select("person_id")).distinct()


def person_of_email(identifiers: DataFrame, email: str) -> str | None:
    """Who has an address."""
    row = identifiers.where((F.col("identifier_type") == "email") & (F.col("value") == email.strip().lower())).select("entity_id").first()
    return row["entity_id"] if row else None


def document_of(identifiers: DataFrame, documents: DataFrame) -> DataFrame:
    """event_id, document_id: an event's identifier is "system:id" of the document that it was read from."""
    known = identifiers.where(F.col("identifier_type").isin("source_id", "meeting_external_id")).select(F.col("entity_id").alias("event_id"), "value")
    return known.join(documents.select("document_id", F.concat_ws(":", "source_system", "external_id").alias("value")), "value").select("event_id", "document_id")


def _roles_of(parts: DataFrame, who: DataFrame, name: str) -> DataFrame:
    return parts.join(who, "person_id", "left_semi").groupBy("event_id").agg(F.sort_array(F.collect_set("role")).alias(name))


def _within(events: DataFrame, kind: str | None, since: str | None, until: str | None) -> DataFrame:
    """Dated events of a kind in the half-open time window."""
    out = events.where(F.col("event_at").isNotNull())
    if kind:
        out = out.where(F.col("kind") == kind)
    if since:
        out = out.where(F.col("event_at") >= since)
    return out.where(F.col("event_at") < until) if until else out


def shared_events(parts: DataFrame, events: DataFrame, people: DataFrame, others: DataFrame | None = None, kind: str | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """Events that ``people`` took part in, and ``others`` too if given, with the roles of each."""
    out = _within(events, kind, since, until).join(_roles_of(parts, people, "roles_a"), "event_id")
    if others is None:
        return out.withColumn("roles_b", F.array().cast("array<string>"))
    return out.join(_roles_of(parts, others, "roles_b"), "event_id")


def wrote(a: str, b: str) -> Column:
    """Mail in which the holder of role column a is the sender and that of b receives."""
    return (F.col("kind") == "email") & F.array_contains(a, SENDER) & F.arrays_overlap(F.col(b), F.array(*map(F.lit, RECEIVERS)))


def _totals() -> list[Column]:
    mail = F.col("kind") == "email"
    return [
        F.count_if(mail).alias("emails"), F.count_if(~mail).alias("meetings"),
        F.count_if(wrote("roles_a", "roles_b")).alias("a_to_b"), F.count_if(wrote("roles_b", "roles_a")).alias("b_to_a"),
        F.min("event_at").alias("first_at"), F.max("event_at").alias("last_at"),
        F.max(F.when(wrote("roles_a", "roles_b"), F.col("event_at"))).alias("last_a_to_b"), F.max(F.when(wrote("roles_b", "roles_a"), F.col("event_at"))).alias("last_b_to_a"),
    ]


def interaction_totals(shared: DataFrame) -> DataFrame:
    """Totals by kind and direction, first and last."""
    return shared.agg(*_totals())


def interaction_list(shared: DataFrame, limit: int = 20) -> DataFrame:
    """The newest ``limit`` (1 to 50) events and the oldest one."""
    limit = max(1, min(limit, 50))
    newest = shared.orderBy(F.desc("event_at"), "event_id").limit(limit)
    oldest = shared.orderBy("event_at", "event_id").limit(1)
    return newest.union(oldest).distinct()


def interactions_by_person(parts: DataFrame, events: DataFrame, people: DataFrame, others: DataFrame, kind: str | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """The totals for each person of ``others`` who is not one of ``people``, with the last title."""
    mine = _within(events, kind, since, until).join(_roles_of(parts, people, "roles_a"), "event_id")
    theirs = parts.join(others.join(people, "person_id", "left_anti"), "person_id", "left_semi")
    theirs = theirs.groupBy("event_id", "person_id").agg(F.sort_array(F.collect_set("role")).alias("roles_b"))
    return mine.join(theirs, "event_id").groupBy("person_id").agg(*_totals(), F.max(F.struct("event_at", "event_id", "title"))["title"].alias("last_title"))


def receivers(parts: DataFrame) -> DataFrame:
    """People who ever are something but the sender: others only broadcast."""
    return parts.where(F.col("role") != SENDER).select("person_id").distinct()


def contacts(parts: DataFrame, events: DataFrame, people: DataFrame, orgs: DataFrame, of: DataFrame, kind: str | None = None, since: str | None = None, until: str | None = None, scope: str = "all", limit: int | None = None) -> DataFrame:
    """Who shared events with ``of``: number of events, last event, organization; scope all, internal or external.

    Left out: ``of`` itself and people who only send. A person without an organization counts as external.
    """
    mine = parts.join(of, "person_id", "left_semi").select("event_id").distinct()
    mine = _within(events, kind, since, until).select("event_id", "event_at").join(mine, "event_id", "left_semi")
    # only the parts of these events are looked at, by event; ``of`` is left out of the people that they give, who are few beside the parts
    seen = parts.select("event_id", "person_id").join(mine, "event_id").distinct()
    last = F.max(F.struct("event_at", "event_id"))
    out = seen.groupBy("person_id").agg(F.count("*").alias("events"), last["event_at"].alias("last_at"), last["event_id"].alias("last_event"))
    out = out.join(of, "person_id", "left_anti").join(receivers(parts), "person_id", "left_semi").join(people, "person_id", "left")
    out = out.join(orgs.select("org_id", F.col("name").alias("org_name"), "is_internal"), "org_id", "left").withColumn("is_internal", F.coalesce("is_internal", F.lit(False)))
    if scope != "all":
        out = out.where(F.col("is_internal") == (scope == "internal"))
    out = out.select("person_id", "name", "org_name", "is_internal", "events", "last_at", "last_event")
    return out.orderBy(F.desc("events"), "person_id").limit(limit) if limit else out


def participants(parts: DataFrame, people: DataFrame, event_id: str) -> DataFrame:
    """The people of one event with their roles, by id: two people of one name stay two."""
    return parts.where(F.col("event_id") == event_id).groupBy("person_id").agg(F.array_join(F.sort_array(F.collect_set("role")), ",").alias("roles")).join(people, "person_id", "left").select("person_id", "name", "roles")


def title_search(events: DataFrame, words: list[str], limit: int = 10) -> DataFrame:
    """Events whose title holds every word, newest first, undated last."""
    if not words:
        return events.limit(0)
    out = events
    for w in words:
        out = out.where(F.lower("title").contains(w.lower()))
    return out.orderBy(F.desc_nulls_last("event_at"), "event_id").limit(limit)


def _with(parts: DataFrame, asker: str | None) -> DataFrame:
    """The parts of others in events of the asker; without one all parts."""
    if not asker:
        return parts
    mine = parts.where(F.col("person_id") == asker).select("event_id").distinct()
    return parts.where(F.col("person_id") != asker).join(mine, "event_id", "left_semi")


def affinity(parts: DataFrame, candidates: DataFrame, asker: str | None = None) -> DataFrame:
    """person_id, score: distinct events shared with the asker, or of any kind without one; 0 included."""
    who = candidates.select("person_id").distinct()
    n = _with(parts.join(who, "person_id", "left_semi") if not asker else parts, asker).join(who, "person_id", "left_semi").groupBy("person_id").agg(F.countDistinct("event_id").alias("score"))
    return who.join(n, "person_id", "left").select("person_id", F.coalesce("score", F.lit(0)).alias("score"))


def org_affinity(parts: DataFrame, people: DataFrame, orgs: DataFrame, asker: str | None = None) -> DataFrame:
    """org_id, score: the same through an organization's people."""
    staff = people.select("person_id", "org_id").join(orgs.select("org_id"), "org_id", "left_semi")
    n = _with(parts, asker).join(staff, "person_id").groupBy("org_id").agg(F.countDistinct("event_id").alias("score"))
    return orgs.select("org_id").join(n, "org_id", "left").select("org_id", F.coalesce("score", F.lit(0)).alias("score"))


def choose(scored: DataFrame, lead: int = 3) -> DataFrame:
    """The best candidate with outcome linked, ambiguous (second within the lead, or score 0) or, of none, no row."""
    top = scored.orderBy(F.desc("score"), scored.columns[0]).limit(2)
    w = Window.orderBy(F.desc("score"), scored.columns[0])
    out = top.withColumn("next_score", F.lead("score").over(w)).withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
    clear = F.col("next_score").isNull() | ((F.col("score") > 0) & (F.col("score") >= lead * F.col("next_score")))
    return out.withColumn("outcome", F.when(clear, "linked").otherwise("ambiguous"))


def contact_set(parts: DataFrame, person_id: str) -> DataFrame:
    """(whom the person wrote to, and who wrote to the person and ever receives) without the person."""
    mail = parts.where(F.col("role").isin(SENDER, *RECEIVERS))
    sent, got = mail.where(F.col("role") == SENDER), mail.where(F.col("role").isin(*RECEIVERS))
    wrote_to = got.join(sent.where(F.col("person_id") == person_id).select("event_id"), "event_id", "left_semi").select("person_id")
    wrote_me = sent.join(got.where(F.col("person_id") == person_id).select("event_id"), "event_id", "left_semi").select("person_id").distinct()
    return wrote_to.union(wrote_me.join(receivers(got), "person_id", "left_semi")).distinct().where(F.col("person_id") != person_id)


def conversations(parts: DataFrame, events: DataFrame, person_id: str) -> DataFrame:
    """The dated mail of a person with contacts: what the person sent, or a contact sent."""
    mail = parts.where(F.col("role").isin(SENDER, *RECEIVERS))
    mine = mail.where(F.col("person_id") == person_id).select("event_id").distinct()
    near = contact_set(parts, person_id).select("person_id").union(parts.sparkSession.createDataFrame([(person_id,)], "person_id string"))
    by = mail.where(F.col("role") == SENDER).join(mine, "event_id", "left_semi").join(near, "person_id", "left_semi").select("event_id").distinct()
    return events.where("event_at is not null").join(by, "event_id", "left_semi")


def person_facts(parts: DataFrame, events: DataFrame, people: DataFrame) -> DataFrame:
    """For every person of ``people``: mail sent and received, meetings, first and last time."""
    seen = parts.join(people.select("person_id"), "person_id", "left_semi").join(events.select("event_id", "kind", "event_at"), "event_id")
    got = F.col("role").isin(*RECEIVERS)
    return seen.groupBy("person_id").agg(
        F.countDistinct(F.when(F.col("role") == SENDER, F.col("event_id"))).alias("sent"), F.countDistinct(F.when(got, F.col("event_id"))).alias("received"),
        F.countDistinct(F.when(F.col("kind") == "meeting", F.col("event_id"))).alias("meetings"), F.min("event_at").alias("first_at"), F.max("event_at").alias("last_at"),
    )


def top_peers(parts: DataFrame, people: DataFrame, orgs: DataFrame, person_id: str, external: bool = False, limit: int = 8) -> DataFrame:
    """Mail exchanged with each peer in either direction, most first; external leaves out people of our own organizations."""
    mail = parts.where(F.col("role").isin(SENDER, *RECEIVERS))
    mine = mail.where(F.col("person_id") == person_id).select("event_id", (F.col("role") == SENDER).alias("mine"))
    pairs = mail.where(F.col("person_id") != person_id).join(mine, "event_id").where(F.col("mine") != (F.col("role") == SENDER))
    if external:
        inside = people.join(orgs.where("is_internal"), "org_id", "left_semi").select("person_id")
        pairs = pairs.join(inside, "person_id", "left_anti")
    return pairs.groupBy("person_id").agg(F.countDistinct("event_id").alias("emails")).orderBy(F.desc("emails"), "person_id").limit(limit)


def correspondents(parts: DataFrame, events: DataFrame, people: DataFrame, orgs: DataFrame, person_id: str, external: bool = False, limit: int = 8, works: DataFrame | None = None) -> DataFrame:
    """person_id, name, emails, last_at, last_event: contacts by mail on which both are in any part, most first; external: of no organization of ours."""
    mail = parts.where(F.col("role").isin(SENDER, *RECEIVERS))
    mine = mail.where(F.col("person_id") == person_id).select("event_id").distinct()
    with_me = mail.join(contact_set(parts, person_id), "person_id", "left_semi").join(mine, "event_id", "left_semi").select("event_id", "person_id").distinct()
    if external:
        inside = (people if works is None else works).join(orgs.where("is_internal").select("org_id"), "org_id", "left_semi").select("person_id")
        with_me = with_me.join(inside, "person_id", "left_anti")
    last = F.max(F.when(F.col("event_at").isNotNull(), F.struct("event_at", "event_id")))
    n = with_me.join(events.select("event_id", "event_at"), "event_id").groupBy("person_id").agg(F.count("*").alias("emails"), last.alias("last"))
    top = n.orderBy(F.desc("emails"), "person_id").limit(limit)
    return top.join(people.select("person_id", "name"), "person_id", "left").select("person_id", "name", "emails", F.col("last.event_at").alias("last_at"), F.col("last.event_id").alias("last_event"))


def org_facts(parts: DataFrame, people: DataFrame, org_id: str, limit: int = 10) -> DataFrame:
    """An organization's people by number of events, with the number of all."""
    staff = people.where(F.col("org_id") == org_id)
    n = parts.join(staff.select("person_id"), "person_id", "left_semi").groupBy("person_id").agg(F.countDistinct("event_id").alias("events"))
    out = staff.join(n, "person_id", "left").select("person_id", "name", F.coalesce("events", F.lit(0)).alias("events"), F.count("*").over(Window.partitionBy("org_id")).alias("people"))
    return out.orderBy(F.desc("events"), "person_id").limit(limit)


def _between(parts: DataFrame, events: DataFrame, a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """Events of both sides with the roles of each; by: columns of b that stay apart."""
    left = parts.join(a, "person_id", "left_semi").groupBy("event_id").agg(F.sort_array(F.collect_set("role")).alias("roles_a"))
    right = parts.join(b, "person_id", "left_semi").groupBy("event_id", *by).agg(F.sort_array(F.collect_set("role")).alias("roles_b"))
    return events.join(left, "event_id").join(right, "event_id")


def _exchanged() -> list[Column]:
    dated, edge = F.col("event_at").isNotNull(), F.struct("event_at", "event_id")
    return [
        F.count("*").alias("total"), F.count_if(dated).alias("dated_total"), *_totals()[2:],
        F.min(F.when(dated, edge))["event_id"].alias("first_event"), F.max(F.when(dated, edge))["event_id"].alias("last_event"),
    ]


def pair_facts(parts: DataFrame, events: DataFrame, a: str, b: str) -> DataFrame:
    """One row of two people: all events, the dated ones, mail each way, first and last with their event, last each way with its event."""
    mine = lambda who: F.sort_array(F.collect_set(F.when(F.col("person_id") == who, F.col("role"))))
    both = parts.where(F.col("person_id").isin(a, b)).groupBy("event_id").agg(mine(a).alias("roles_a"), mine(b).alias("roles_b"))
    shared = events.join(both.where("size(roles_a) > 0 and size(roles_b) > 0"), "event_id")
    edge = F.struct("event_at", "event_id")
    ways = [F.max(F.when(F.col("event_at").isNotNull() & wrote(x, y), edge))["event_id"].alias(f"last_{n}_event") for n, x, y in (("a_to_b", "roles_a", "roles_b"), ("b_to_a", "roles_b", "roles_a"))]
    return shared.agg(*_exchanged(), *ways)


def org_person_facts(parts: DataFrame, events: DataFrame, people: DataFrame, org_id: str, person_id: str, works: DataFrame | None = None, limit: int = 15) -> DataFrame:
    """For each person of an organization who shares events with a person: as pair_facts (a is the person), most first; people is the number of all."""
    staff = people_of(people, org_id, works).where(F.col("person_id") != person_id)
    one = parts.where(F.col("person_id") == person_id).select("person_id").distinct()
    each = _between(parts, events, one, staff, ["person_id"]).groupBy("person_id").agg(*_exchanged())
    each = each.withColumn("people", F.count("*").over(Window.partitionBy(F.lit(1))))
    return each.orderBy(F.desc("total"), "person_id").limit(limit)


def people_network(parts: DataFrame, top: int = 60, least: int = 2, keep: Callable[[DataFrame], DataFrame] = hold) -> DataFrame:
    """sender_id, receiver_id, emails among the ``top`` people by mail sent and received, pairs of ``least`` or more. The pairs are counted once and kept."""
    mail = parts.where(F.col("role").isin(SENDER, *RECEIVERS))
    sent = mail.where(F.col("role") == SENDER).select("event_id", F.col("person_id").alias("sender_id")).distinct()
    got = mail.where(F.col("role").isin(*RECEIVERS)).select("event_id", F.col("person_id").alias("receiver_id")).distinct()
    pairs = keep(sent.join(got, "event_id").where("sender_id <> receiver_id").groupBy("sender_id", "receiver_id").agg(F.count("*").alias("emails")))
    volume = pairs.select(F.explode(F.array("sender_id", "receiver_id")).alias("person_id"), "emails").groupBy("person_id").agg(F.sum("emails").alias("n"))
    # top rows: a handful
    best = F.broadcast(volume.orderBy(F.desc("n"), "person_id").limit(top).select("person_id"))
    return pairs.where(F.col("emails") >= least).join(best, F.col("sender_id") == F.col("person_id"), "left_semi").join(best, F.col("receiver_id") == F.col("person_id"), "left_semi")


def neighborhood(edges: DataFrame, center: str, depth: int = 2, fanout: int = 25, employers: int = 5, keep: Callable[[DataFrame], DataFrame] = hold) -> DataFrame:
    """node_id, distance within ``depth`` of the center, along each node's ``fanout`` most recently seen edges (undated last).

    edges: source_id, target_id, last_seen and, optionally, relation: then each person reached brings ``employers`` of its organizations along.
    Each step reads the edges of its own front alone and is kept, so no step repeats another; a node keeps its first distance.
    """
    spark = edges.sparkSession
    found = spark.createDataFrame([(center, 0)], "node_id string, distance int")
    front = found
    w = Window.partitionBy("a").orderBy(F.desc_nulls_last("last_seen"), "b")
    reached = [found]
    for k in range(1, depth + 1):
        sides = []
        for near, far in (("source_id", "target_id"), ("target_id", "source_id")):
            side = edges.select(F.col(near).alias("a"), F.col(far).alias("b"), "last_seen")
            sides.append(side.where(F.col("a") == center) if k == 1 else side.join(front.select(F.col("node_id").alias("a")), "a", "left_semi"))
        out = sides[0].union(sides[1]).where("a <> b").groupBy("a", "b").agg(F.max("last_seen").alias("last_seen"))
        out = out.withColumn("r", F.row_number().over(w)).where(F.col("r") <= fanout)
        front = keep(out.select(F.col("b").alias("node_id")).distinct().join(found.select("node_id"), "node_id", "left_anti").withColumn("distance", F.lit(k)))
        reached.append(front)
        found = found.union(front)
    if "relation" in edges.columns and employers:
        work = edges.where("relation = 'WORKS_AT'").select(F.col("source_id").alias("a"), F.col("target_id").alias("b"), "last_seen").join(found.select(F.col("node_id").alias("a"), "distance"), "a")
        first = work.withColumn("r", F.row_number().over(w)).where(F.col("r") <= employers)
        found = found.union(first.groupBy(F.col("b").alias("node_id")).agg((F.min("distance") + 1).alias("distance")).join(found.select("node_id"), "node_id", "left_anti"))
    return found
