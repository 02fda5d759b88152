"""Registered relationship queries over the projected tables, and their SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from attesta.operators import interactions as I
from attesta.operators import linking, search
from attesta.plans.projection import MODEL_SQL, load, project

COMPANY = "NATION_1"
ORG_A, ORG_B, PERSON_A, PERSON_B, EVENT = "n:3", "n:7", "c:5", "s:5", "o:3"
TO = "('to', 'cc', 'bcc')"


def _contacts(spark, d, scope="all", limit=None, kind=None, since=None, until=None):
    m = load(spark, d)
    return I.contacts(m.parts, m.events, m.people, m.orgs, I.people_of(m.people, ORG_A), kind, since, until, scope, limit)


def _contacts_sql(where: str = "", scope: str = "", limit: int | None = None) -> str:
    return f"""WITH {MODEL_SQL},
mine AS (SELECT h.* FROM happenings h WHERE event_at IS NOT NULL {where} AND event_id IN (SELECT event_id FROM parts JOIN people USING (person_id) WHERE org_id = '{ORG_A}')),
seen AS (SELECT DISTINCT event_id, person_id FROM parts WHERE person_id NOT IN (SELECT person_id FROM people WHERE org_id = '{ORG_A}')),
n AS (SELECT person_id, count(*) AS events, max(event_at) AS last_at, max(struct_pack(a := event_at, e := event_id)).e AS last_event FROM seen JOIN mine USING (event_id) GROUP BY 1)
SELECT n.person_id, p.name, o.name AS org_name, coalesce(o.is_internal, false) AS is_internal, events, last_at, last_event
FROM n LEFT JOIN people p USING (person_id) LEFT JOIN orgs o USING (org_id)
WHERE n.person_id IN (SELECT person_id FROM parts WHERE role <> 'sender') {scope}
{f'ORDER BY events DESC, n.person_id LIMIT {limit}' if limit else ''}"""


def _shared(spark, d, **k):
    m = load(spark, d)
    return I.shared_events(m.parts, m.events, I.people_of(m.people, ORG_A), I.people_of(m.people, ORG_B), **k)


SHARED_SQL = f"""WITH {MODEL_SQL},
a AS (SELECT event_id, list_sort(list_distinct(list(role))) AS roles_a FROM parts JOIN people USING (person_id) WHERE org_id = '{ORG_A}' GROUP BY 1),
b AS (SELECT event_id, list_sort(list_distinct(list(role))) AS roles_b FROM parts JOIN people USING (person_id) WHERE org_id = '{ORG_B}' GROUP BY 1),
shared AS (SELECT * FROM happenings JOIN a USING (event_id) JOIN b USING (event_id))
"""
_AB = "kind = 'email' AND list_contains(roles_a, 'sender') AND list_has_any(roles_b, ['to', 'cc', 'bcc'])"
_BA = "kind = 'email' AND list_contains(roles_b, 'sender') AND list_has_any(roles_a, ['to', 'cc', 'bcc'])"
TOTALS_SQL = f"""count(*) FILTER (kind = 'email') AS emails, count(*) FILTER (kind <> 'email') AS meetings, count(*) FILTER ({_AB}) AS a_to_b, count(*) FILTER ({_BA}) AS b_to_a,
min(event_at) AS first_at, max(event_at) AS last_at, max(event_at) FILTER ({_AB}) AS last_a_to_b, max(event_at) FILTER ({_BA}) AS last_b_to_a"""


def _flat(df):
    return df.withColumns({c: F.array_join(c, ",") for c in ("roles_a", "roles_b")})


def _model(fn):
    return lambda spark, d: fn(load(spark, d))


def _edges(m):
    """Who dealt with whom as edges, for the neighbourhood."""
    mail = m.parts.join(m.events, "event_id")
    return mail.select(F.col("person_id").alias("source_id"), F.col("event_id").alias("target_id"), F.col("event_at").alias("last_seen"))


def _linked(spark, d):
    """Questions about customers and nations, in several spellings."""
    m = project(spark, d)
    k = F.col("c_custkey")
    spelt = F.when(k % 3 == 0, F.col("c_name")).when(k % 3 == 1, F.upper("c_name")).otherwise(F.concat("c_name", F.lit("'s")))
    q = spark.read.parquet(f"{d}/customer.parquet").select(k.alias("question_id"), F.concat(F.lit("did "), spelt, F.lit(" write to Bob in Å"), (k % 7).cast("string"), F.lit("?")).alias("text"))
    rows = m.people.select(F.col("person_id").alias("entity_id"), F.lit("Person").alias("entity_type"), F.col("name").alias("canonical_name"), F.lit("active").alias("status"))
    none = spark.createDataFrame([], "entity_id string, identifier_type string, value string")
    aliases = m.people.select(F.col("person_id").alias("entity_id"), F.concat(F.lit("Mr "), "name").alias("alias"))
    named = rows.withColumn("canonical_name", F.replace("canonical_name", F.lit("#"), F.lit(" ")))
    spaced = q.withColumn("text", F.replace("text", F.lit("#"), F.lit(" ")))
    return linking.link_entities(spaced, named, none, aliases).select("question_id", "gram", "entity_id")


QUERIES = {
    "parts_by_role": _model(lambda m: m.parts.groupBy("role").agg(F.count("*").alias("n"), F.countDistinct("person_id").alias("people"))),
    "events_by_kind": _model(lambda m: m.events.groupBy("kind").agg(F.count("*").alias("n"), F.min("event_at").alias("first_at"), F.max("event_at").alias("last_at"))),
    "contacts_of_company": _contacts,
    "contacts_internal_top": partial(_contacts, scope="internal", limit=20),
    "contacts_external_mail": partial(_contacts, scope="external", kind="email", since="1996-01-01", until="1997-01-01"),
    "shared_events": lambda s, d: _flat(_shared(s, d)),
    "shared_mail_window": lambda s, d: _flat(_shared(s, d, kind="email", since="1995-01-01", until="1996-06-01")),
    "interaction_totals": lambda s, d: I.interaction_totals(_shared(s, d)),
    "interaction_list": lambda s, d: _flat(I.interaction_list(_shared(s, d), 20)),
    "interactions_by_person": _model(lambda m: I.interactions_by_person(m.parts, m.events, I.people_of(m.people, ORG_A), I.people_of(m.people, ORG_B))),
    "participants_of_event": _model(lambda m: I.participants(m.parts, m.people, EVENT)),
    "title_search": _model(lambda m: I.title_search(m.events, ["order", "99"])),
    "affinity_with_asker": _model(lambda m: I.affinity(m.parts, I.people_of(m.people, ORG_A), PERSON_B)),
    "affinity_total": _model(lambda m: I.affinity(m.parts, I.people_of(m.people, ORG_A))),
    "company_affinity": _model(lambda m: I.org_affinity(m.parts, m.people, m.orgs, PERSON_B)),
    "choose_candidate": _model(lambda m: I.choose(I.affinity(m.parts, I.people_of(m.people, ORG_A), PERSON_B))),
    "contact_set": _model(lambda m: I.contact_set(m.parts, PERSON_B)),
    "person_facts": _model(lambda m: I.person_facts(m.parts, m.events, I.people_of(m.people, ORG_A))),
    "top_peers": _model(lambda m: I.top_peers(m.parts, m.people, m.orgs, PERSON_B)),
    "top_external_peers": _model(lambda m: I.top_peers(m.parts, m.people, m.orgs, PERSON_B, external=True)),
    "company_facts": _model(lambda m: I.org_facts(m.parts, m.people, ORG_A)),
    "pair_facts": _model(lambda m: I.pair_facts(m.parts, m.events, PERSON_A, PERSON_B)),
    "people_network": _model(lambda m: I.people_network(m.parts)),
    "broadcast_only_people": _model(lambda m: m.parts.select("person_id").distinct().join(I.receivers(m.parts), "person_id", "left_anti")),
    "neighborhood": _model(lambda m: I.neighborhood(_edges(m), PERSON_B, 2, 5)),
    "find_person": _model(lambda m: linking.find(m.people, m.orgs, m.parts, "Customer#000000005", PERSON_B)),
    "find_company": _model(lambda m: linking.find(m.people, m.orgs, m.parts, COMPANY, PERSON_B)),
    "find_records": _model(lambda m: linking.find_records(m, "order 99", None, PERSON_B)),
    "correspondents": _model(lambda m: I.correspondents(m.parts, m.events, m.people, m.orgs, PERSON_B)),
    "outside_correspondents": _model(lambda m: I.correspondents(m.parts, m.events, m.people, m.orgs, PERSON_B, external=True)),
    "conversations": _model(lambda m: I.conversations(m.parts, m.events, PERSON_B)),
    "company_person_facts": _model(lambda m: I.org_person_facts(m.parts, m.events, m.people, ORG_A, PERSON_B)),
    "linked_names": lambda s, d: _linked(s, d),
    "passage_search": lambda s, d: search.bm25(s.read.parquet(f"{d}/documents.parquet"), "this work is licensed under the general public license"),
    "vector_search": lambda s, d: search.cosine(s.read.parquet(f"{d}/embeddings.parquet"), [1.0] * 64),
}

_PEERS = f"""WITH {MODEL_SQL},
pairs AS (SELECT p.person_id, p.event_id FROM mail_parts p JOIN mail_parts q USING (event_id)
  WHERE q.person_id = '{PERSON_B}' AND p.person_id <> '{PERSON_B}' AND (q.role = 'sender') <> (p.role = 'sender') /*more*/)
SELECT person_id, count(DISTINCT event_id) AS emails FROM pairs GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8"""
_AFF = f"""WITH {MODEL_SQL},
seen AS (SELECT DISTINCT event_id, person_id FROM parts WHERE person_id <> '{PERSON_B}' AND event_id IN (SELECT event_id FROM parts WHERE person_id = '{PERSON_B}')),
scored AS (SELECT p.person_id, count(s.event_id) AS score FROM people p LEFT JOIN seen s USING (person_id) WHERE org_id = '{ORG_A}' GROUP BY 1)"""

_CONTACTS = f"""WITH {MODEL_SQL}, got AS (SELECT * FROM mail_parts WHERE role IN {TO}), sent AS (SELECT * FROM mail_parts WHERE role = 'sender'),
contacts AS ((SELECT g.person_id FROM got g JOIN sent s USING (event_id) WHERE s.person_id = '{PERSON_B}' UNION
SELECT s.person_id FROM sent s JOIN got g USING (event_id) WHERE g.person_id = '{PERSON_B}' AND s.person_id IN (SELECT person_id FROM got)) EXCEPT SELECT '{PERSON_B}'),
mine AS (SELECT DISTINCT event_id FROM mail_parts WHERE person_id = '{PERSON_B}')"""
_CORRESPONDENTS = _CONTACTS + """, n AS (SELECT p.person_id, count(*) AS emails, max(struct_pack(a := event_at, e := event_id)) AS m FROM (SELECT DISTINCT event_id, person_id FROM mail_parts) p JOIN happenings USING (event_id)
  WHERE event_id IN (FROM mine) AND p.person_id IN (FROM contacts) /*more*/ GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8)
SELECT person_id, name, emails, m.a AS last_at, m.e AS last_event FROM n LEFT JOIN people USING (person_id)"""
_FOUND = f"""WITH {MODEL_SQL}, seen AS (SELECT DISTINCT event_id, person_id FROM parts WHERE person_id <> '{PERSON_B}' AND event_id IN (SELECT event_id FROM parts WHERE person_id = '{PERSON_B}'))"""

ORACLE_SQL = {
    "find_person": _FOUND + "SELECT person_id AS id, 'Person' AS type, name, (SELECT count(*) FROM seen s WHERE s.person_id = p.person_id) AS score FROM people p WHERE name = 'Customer#000000005'",
    "find_company": _FOUND + f"SELECT org_id AS id, 'Organization' AS type, name, (SELECT count(DISTINCT event_id) FROM seen JOIN people USING (person_id) WHERE people.org_id = o.org_id) AS score FROM orgs o WHERE name = '{COMPANY}'",
    "find_records": f"WITH {MODEL_SQL} SELECT event_id AS id, CASE kind WHEN 'meeting' THEN 'Meeting' ELSE 'Document' END AS type, title AS name, NULL::BIGINT AS score, NULL AS email, NULL AS organization, event_at FROM happenings WHERE contains(title, 'order') AND contains(title, '99') ORDER BY event_at DESC NULLS LAST, event_id LIMIT 10",
    "correspondents": _CORRESPONDENTS,
    "outside_correspondents": _CORRESPONDENTS.replace("/*more*/", "AND p.person_id NOT IN (SELECT person_id FROM people JOIN orgs USING (org_id) WHERE is_internal)"),
    "conversations": _CONTACTS + f"SELECT h.* FROM happenings h WHERE event_at IS NOT NULL AND event_id IN (FROM mine) AND event_id IN (SELECT event_id FROM sent WHERE person_id = '{PERSON_B}' OR person_id IN (FROM contacts))",
    "company_person_facts": f"""WITH {MODEL_SQL}, a AS (SELECT event_id, list(role) AS roles_a FROM parts WHERE person_id = '{PERSON_B}' GROUP BY 1),
b AS (SELECT event_id, person_id, list(role) AS roles_b FROM parts JOIN people USING (person_id) WHERE org_id = '{ORG_A}' AND person_id <> '{PERSON_B}' GROUP BY ALL),
f AS (SELECT person_id, count(*) AS total, count(event_at) AS dated_total, count(*) FILTER ({_AB}) AS a_to_b, count(*) FILTER ({_BA}) AS b_to_a, min(event_at) AS first_at, max(event_at) AS last_at,
max(event_at) FILTER ({_AB}) AS last_a_to_b, max(event_at) FILTER ({_BA}) AS last_b_to_a,
min(struct_pack(a := event_at, e := event_id)).e AS first_event, max(struct_pack(a := event_at, e := event_id)).e AS last_event FROM happenings JOIN a USING (event_id) JOIN b USING (event_id) GROUP BY 1)
SELECT *, (SELECT count(*) FROM f) AS people FROM f ORDER BY total DESC, person_id LIMIT 15""",
    "linked_names": "SELECT c_custkey AS question_id, lower(replace(c_name, '#', ' ')) AS gram, 'c:' || c_custkey AS entity_id FROM customer",
    "parts_by_role": f"WITH {MODEL_SQL} SELECT role, count(*) AS n, count(DISTINCT person_id) AS people FROM parts GROUP BY 1",
    "events_by_kind": f"WITH {MODEL_SQL} SELECT kind, count(*) AS n, min(event_at) AS first_at, max(event_at) AS last_at FROM happenings GROUP BY 1",
    "contacts_of_company": _contacts_sql(),
    "contacts_internal_top": _contacts_sql(scope="AND is_internal", limit=20),
    "contacts_external_mail": _contacts_sql("AND kind = 'email' AND event_at >= '1996-01-01' AND event_at < '1997-01-01'", "AND NOT coalesce(is_internal, false)"),
    "shared_events": SHARED_SQL + "SELECT event_id, kind, title, event_at, array_to_string(roles_a, ',') AS roles_a, array_to_string(roles_b, ',') AS roles_b FROM shared",
    "shared_mail_window": SHARED_SQL + "SELECT event_id, kind, title, event_at, array_to_string(roles_a, ',') AS roles_a, array_to_string(roles_b, ',') AS roles_b FROM shared WHERE kind = 'email' AND event_at >= '1995-01-01' AND event_at < '1996-06-01'",
    "interaction_totals": SHARED_SQL + f"SELECT {TOTALS_SQL} FROM shared",
    "interaction_list": SHARED_SQL + """SELECT event_id, kind, title, event_at, array_to_string(roles_a, ',') AS roles_a, array_to_string(roles_b, ',') AS roles_b FROM
(SELECT *, row_number() OVER (ORDER BY event_at DESC, event_id) AS newest, row_number() OVER (ORDER BY event_at, event_id) AS oldest FROM shared) WHERE newest <= 20 OR oldest = 1""",
    "interactions_by_person": f"""WITH {MODEL_SQL},
a AS (SELECT event_id, list_sort(list_distinct(list(role))) AS roles_a FROM parts JOIN people USING (person_id) WHERE org_id = '{ORG_A}' GROUP BY 1),
b AS (SELECT event_id, person_id, list_sort(list_distinct(list(role))) AS roles_b FROM parts JOIN people USING (person_id) WHERE org_id = '{ORG_B}' GROUP BY ALL)
SELECT person_id, {TOTALS_SQL}, max(struct_pack(a := event_at, e := event_id, t := title)).t AS last_title FROM happenings JOIN a USING (event_id) JOIN b USING (event_id) GROUP BY person_id""",
    "participants_of_event": f"WITH {MODEL_SQL} SELECT person_id, any_value(name) AS name, array_to_string(list_sort(list_distinct(list(role))), ',') AS roles FROM parts LEFT JOIN people USING (person_id) WHERE event_id = '{EVENT}' GROUP BY 1",
    "title_search": f"WITH {MODEL_SQL} SELECT * FROM happenings WHERE contains(title, 'order') AND contains(title, '99') ORDER BY event_at DESC NULLS LAST, event_id LIMIT 10",
    "affinity_with_asker": _AFF + " SELECT * FROM scored",
    "affinity_total": f"WITH {MODEL_SQL} SELECT p.person_id, count(DISTINCT x.event_id) AS score FROM people p LEFT JOIN parts x USING (person_id) WHERE org_id = '{ORG_A}' GROUP BY 1",
    "company_affinity": f"""WITH {MODEL_SQL}, seen AS (SELECT DISTINCT event_id, org_id FROM parts JOIN people USING (person_id) WHERE person_id <> '{PERSON_B}' AND event_id IN (SELECT event_id FROM parts WHERE person_id = '{PERSON_B}'))
SELECT o.org_id, count(s.event_id) AS score FROM orgs o LEFT JOIN seen s USING (org_id) GROUP BY 1""",
    "choose_candidate": _AFF + """, two AS (SELECT *, lead(score) OVER (ORDER BY score DESC, person_id) AS next_score, row_number() OVER (ORDER BY score DESC, person_id) AS n FROM scored)
SELECT person_id, score, next_score, CASE WHEN next_score IS NULL OR (score > 0 AND score >= 3 * next_score) THEN 'linked' ELSE 'ambiguous' END AS outcome FROM two WHERE n = 1""",
    "contact_set": f"""WITH {MODEL_SQL}, got AS (SELECT * FROM mail_parts WHERE role IN {TO}), sent AS (SELECT * FROM mail_parts WHERE role = 'sender')
(SELECT g.person_id FROM got g JOIN sent s USING (event_id) WHERE s.person_id = '{PERSON_B}' UNION
SELECT s.person_id FROM sent s JOIN got g USING (event_id) WHERE g.person_id = '{PERSON_B}' AND s.person_id IN (SELECT person_id FROM got)) EXCEPT SELECT '{PERSON_B}'""",
    "person_facts": f"""WITH {MODEL_SQL} SELECT person_id, count(DISTINCT event_id) FILTER (role = 'sender') AS sent, count(DISTINCT event_id) FILTER (role IN {TO}) AS received,
count(DISTINCT event_id) FILTER (kind = 'meeting') AS meetings, min(event_at) AS first_at, max(event_at) AS last_at
FROM parts JOIN happenings USING (event_id) JOIN people USING (person_id) WHERE org_id = '{ORG_A}' GROUP BY 1""",
    "top_peers": _PEERS,
    "top_external_peers": _PEERS.replace("/*more*/", "AND p.person_id NOT IN (SELECT person_id FROM people JOIN orgs USING (org_id) WHERE is_internal)"),
    "company_facts": f"WITH {MODEL_SQL} SELECT person_id, any_value(name) AS name, count(DISTINCT event_id) AS events, (SELECT count(*) FROM people WHERE org_id = '{ORG_A}') AS people FROM people LEFT JOIN parts USING (person_id) WHERE org_id = '{ORG_A}' GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 10",
    "pair_facts": f"""WITH {MODEL_SQL}, a AS (SELECT event_id, list(role) AS roles_a FROM parts WHERE person_id = '{PERSON_A}' GROUP BY 1), b AS (SELECT event_id, list(role) AS roles_b FROM parts WHERE person_id = '{PERSON_B}' GROUP BY 1)
SELECT count(*) AS total, count(event_at) AS dated_total, count(*) FILTER ({_AB}) AS a_to_b, count(*) FILTER ({_BA}) AS b_to_a, min(event_at) AS first_at, max(event_at) AS last_at,
max(event_at) FILTER ({_AB}) AS last_a_to_b, max(event_at) FILTER ({_BA}) AS last_b_to_a,
(max(struct_pack(a := event_at, e := event_id)) FILTER ({_AB})).e AS last_a_to_b_event, (max(struct_pack(a := event_at, e := event_id)) FILTER ({_BA})).e AS last_b_to_a_event,
min(struct_pack(a := event_at, e := event_id)).e AS first_event, max(struct_pack(a := event_at, e := event_id)).e AS last_event FROM happenings JOIN a USING (event_id) JOIN b USING (event_id)""",
    "people_network": f"""WITH {MODEL_SQL},
pairs AS (SELECT s.person_id AS sender_id, g.person_id AS receiver_id, count(DISTINCT event_id) AS emails FROM mail_parts s JOIN mail_parts g USING (event_id)
  WHERE s.role = 'sender' AND g.role IN {TO} AND s.person_id <> g.person_id GROUP BY ALL),
best AS (SELECT person_id FROM (SELECT sender_id AS person_id, emails FROM pairs UNION ALL SELECT receiver_id, emails FROM pairs) GROUP BY 1 ORDER BY sum(emails) DESC, 1 LIMIT 60)
SELECT * FROM pairs WHERE emails >= 2 AND sender_id IN (FROM best) AND receiver_id IN (FROM best)""",
    "passage_search": """WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda w: w <> '') AS w FROM documents),
k AS (SELECT count(*) AS n, avg(len(w)) AS a FROM t), h AS (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM t),
f AS (SELECT doc_id, dl, term, count(*) AS tf FROM h WHERE term IN ('this', 'work', 'is', 'licensed', 'under', 'the', 'general', 'public', 'license') GROUP BY ALL), c AS (SELECT term, count(*) AS df FROM f GROUP BY 1)
SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 6) AS score FROM f JOIN c USING (term), k GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12""",
    "vector_search": "SELECT vec_id, round(list_cosine_similarity([x::DOUBLE for x in embedding], [1.0::DOUBLE for x in range(64)]), 6) AS score FROM embeddings ORDER BY 2 DESC, 1 LIMIT 12",
    "broadcast_only_people": f"WITH {MODEL_SQL} SELECT DISTINCT person_id FROM parts WHERE person_id NOT IN (SELECT person_id FROM parts WHERE role <> 'sender')",
    "neighborhood": f"""WITH {MODEL_SQL},
e AS (SELECT person_id AS a, event_id AS b, max(event_at) AS t FROM parts JOIN happenings USING (event_id) GROUP BY ALL UNION ALL SELECT event_id, person_id, max(event_at) FROM parts JOIN happenings USING (event_id) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY t DESC NULLS LAST, b) AS n FROM e),
one AS (SELECT b AS node FROM r WHERE a = '{PERSON_B}' AND n <= 5),
two AS (SELECT DISTINCT b AS node FROM r WHERE n <= 5 AND a IN (FROM one) AND b <> '{PERSON_B}' AND b NOT IN (FROM one))
SELECT '{PERSON_B}' AS node_id, 0 AS distance UNION ALL SELECT node, 1 FROM one UNION ALL SELECT node, 2 FROM two""",
}
