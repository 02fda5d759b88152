"""Registered queries of the graph store, text functions, review queue and maintenance, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.functions import identity as E
from attesta.functions import policy as P
from attesta.functions import text as T
from attesta.operators import graph as G
from attesta.operators import incremental as M
from attesta.operators import review as R
from attesta.plans.projection import MODEL_SQL, STAMP, key, project
from attesta.sources.work import settle


def read(spark, d, t):
    settle(spark)
    return spark.read.parquet(f"{d}/{t}.parquet")


def evidence(spark, d):
    """A row for each order line: mail sent by the customer to the supplier; class and confidence by flag and discount."""
    lines = read(spark, d, "lineitem").join(read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    flag = F.col("l_returnflag")
    return lines.select(
        key("c:", "o_custkey").alias("source_id"), F.when(F.col("l_partkey") % 10 == 0, "REPORTS_TO").when(flag == "R", "VENDOR_OF").otherwise("SENT_TO").alias("relation"), key("s:", "l_suppkey").alias("target_id"),
        key("o:", "o_orderkey").alias("document_id"), F.concat_ws(":", "l_orderkey", "l_partkey").alias("evidence_key"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("doc_seq"),
        F.date_format("o_orderdate", STAMP).alias("observed_at"), (1 - F.col("l_discount")).alias("confidence"),
        F.when(flag == "A", "STRUCTURED_SOURCE").when(flag == "R", "INFERRED_TEXT").otherwise("EXPLICIT_TEXT").alias("provenance"), F.col("l_linestatus").alias("value"),
    )


EVIDENCE_SQL = """evidence AS (SELECT 'c:' || o_custkey AS source_id, CASE WHEN l_partkey % 10 = 0 THEN 'REPORTS_TO' WHEN l_returnflag = 'R' THEN 'VENDOR_OF' ELSE 'SENT_TO' END AS relation,
  's:' || l_suppkey AS target_id, 'o:' || o_orderkey AS document_id, l_orderkey || ':' || l_partkey AS evidence_key, l_orderkey * 10 + l_linenumber AS doc_seq,
  strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS observed_at, 1 - l_discount AS confidence,
  CASE l_returnflag WHEN 'A' THEN 'STRUCTURED_SOURCE' WHEN 'R' THEN 'INFERRED_TEXT' ELSE 'EXPLICIT_TEXT' END AS provenance, l_linestatus AS value
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
edges AS (SELECT source_id, relation, target_id, max(struct_pack(r := CASE provenance WHEN 'STRUCTURED_SOURCE' THEN 3 WHEN 'EXPLICIT_TEXT' THEN 2 ELSE 1 END, o := -doc_seq, p := provenance)).p AS provenance,
  max(confidence) AS confidence, min(observed_at) AS first_seen, max(observed_at) AS last_seen, count(*) AS evidence_count FROM evidence GROUP BY ALL)"""


def entities(m):
    e = m.people.select(F.col("person_id").alias("entity_id"), F.lit("Person").alias("entity_type"), F.col("name").alias("canonical_name"))
    return e.union(m.orgs.select("org_id", F.lit("Organization"), "name")).withColumn("status", F.lit("active"))


def identifiers(spark, d):
    a = E.describe(addresses(spark, d)).select("entity_id", "email", "mailbox")
    return a.unpivot("entity_id", ["email", "mailbox"], "identifier_type", "value").where("value is not null").distinct()


def aliases(spark, d):
    return addresses(spark, d).where("display is not null").select("entity_id", F.col("display").alias("alias")).distinct()


def addresses(spark, d):
    """Invented addresses and display names of the customers, in every spelling that the rules tell apart."""
    k = F.col("c_custkey")
    first = F.substring(F.lower("c_mktsegment"), 1, 5)
    last = F.translate(k.cast("string"), "0123456789", "abcdefghij")
    pick = lambda options: F.get(F.array(*options), (k % len(options)).cast("int"))
    local = pick([F.concat(first, F.lit("."), last), F.concat(first, F.lit("_m_"), last), F.concat(F.substring(first, 1, 1), last), F.lit("noreply"), F.concat(first, F.lit("-"), last), F.concat(first, F.lit("."), last, F.lit("+tag")), F.lit("Office")])
    domain = pick([F.lit(x) for x in ("mail.acme.co.uk", "gmail.com", "lists.acme.com", "ect.acme.com", "houston.rr.com")])
    display = pick([F.concat(F.initcap(first), F.lit(" "), F.initcap(last)), F.concat(last, F.lit(", "), first, F.lit(" q.")), F.lit(None).cast("string"), F.concat(F.lit('"'), last, F.lit(", "), first, F.lit('"'))])
    return read(spark, d, "customer").select(key("c:", "c_custkey").alias("entity_id"), F.concat(local, F.lit("@"), domain).alias("email"), display.alias("display"))


ADDRESSES_SQL = """base AS (SELECT c_custkey AS k, substr(lower(c_mktsegment), 1, 5) AS f, translate(c_custkey::VARCHAR, '0123456789', 'abcdefghij') AS l FROM customer),
addresses AS (SELECT 'c:' || k AS entity_id, [f || '.' || l, f || '_m_' || l, f[1] || l, 'noreply', f || '-' || l, f || '.' || l || '+tag', 'Office'][k % 7 + 1]
  || '@' || ['mail.acme.co.uk', 'gmail.com', 'lists.acme.com', 'ect.acme.com', 'houston.rr.com'][k % 5 + 1] AS email,
  [upper(f[1]) || substr(f, 2) || ' ' || upper(l[1]) || substr(l, 2), l || ', ' || f || ' q.', NULL, '"' || l || ', ' || f || '"'][k % 4 + 1] AS display FROM base)"""


def email_identity(spark, d):
    return E.describe(addresses(spark, d)).drop("display")


def _list(xs) -> str:
    return "(" + ", ".join(f"'{x}'" for x in xs) + ")"


EMAIL_SQL = f"""WITH {ADDRESSES_SQL},
s AS (SELECT *, lower(email) AS e, split_part(lower(email), '@', 1) AS lo, split_part(lower(email), '@', 2) AS dm, string_split(split_part(lower(email), '@', 2), '.') AS la FROM addresses),
t AS (SELECT *, CASE WHEN len(la) > 2 AND array_to_string(list_slice(la, len(la) - 1, len(la)), '.') IN {_list(P.MULTI_PART_SUFFIXES)} THEN array_to_string(list_slice(la, len(la) - 2, len(la)), '.') ELSE array_to_string(list_slice(la, len(la) - 1, len(la)), '.') END AS org,
  CASE WHEN dm = 'gmail.com' THEN replace(split_part(lo, '+', 1), '.', '') || '@gmail.com' END AS pm,
  CASE WHEN regexp_matches(lo, '{E._DOTTED}') THEN regexp_extract(lo, '{E._DOTTED}', ['a', 'b']) WHEN regexp_matches(lo, '{E._DASHED}') THEN regexp_extract(lo, '{E._DASHED}', ['a', 'b']) END AS nm,
  trim(trim(display), '"') AS sh FROM s),
u AS (SELECT *, CASE WHEN contains(sh, ',') THEN string_split(trim(split_part(sh, ',', 2)), ' ')[1] ELSE string_split(sh, ' ')[1] END AS sf,
  CASE WHEN contains(sh, ',') THEN split_part(sh, ',', 1) ELSE string_split(sh, ' ')[-1] END AS sl FROM t),
v AS (SELECT *, regexp_matches(lower(sf), '^[a-z]{{2,}}$') AND regexp_matches(lower(sl), '^[a-z]{{2,}}$') AS good FROM u)
SELECT entity_id, e AS email, lo AS local, dm AS domain, org AS org_domain, pm AS provider_mailbox, coalesce(pm, lo || '@' || org) AS mailbox, nm.a AS first, nm.b AS last,
  CASE WHEN good THEN lower(sf) END AS shown_first, CASE WHEN good THEN lower(sl) END AS shown_last,
  dm IN {_list(P.EXCLUDED_DOMAINS)} OR dm = 'houston.rr.com' AS generic, lo IN {_list(P.BULK_LOCAL_PARTS)} OR (len(la) >= 3 AND la[1] IN {_list(P.BULK_LABELS)}) AS bulk, lo IN {_list(P.ROLE_LOCAL_PARTS)} AS role_address,
  CASE WHEN lo IN {_list(P.ROLE_LOCAL_PARTS)} THEN e ELSE coalesce(trim(display), upper(nm.a[1]) || substr(nm.a, 2) || ' ' || upper(nm.b[1]) || substr(nm.b, 2), e) END AS person_name FROM v"""


def quoted(spark, d):
    body = F.concat("text", F.get(F.array(F.lit(""), F.lit("\nOn Monday, A B wrote:\n> it"), F.lit("\n-----Original Message-----\nold"), F.lit("\n> quoted\nmore"), F.lit("\nA B 10/12/2000 03:43 PM\nTo: C")), (F.col("conv_id") % 5).cast("int")))
    s = T.split_quoted(body)
    return read(spark, d, "conversations").select("conv_id", "turn", F.md5(s["own"]).alias("own_md5"), s["quoted"].alias("quoted"))


QUOTED_SQL = """WITH b AS (SELECT conv_id, turn, text, text || [ '', chr(10) || 'On Monday, A B wrote:' || chr(10) || '> it', chr(10) || '-----Original Message-----' || chr(10) || 'old', chr(10) || '> quoted' || chr(10) || 'more',
  chr(10) || 'A B 10/12/2000 03:43 PM' || chr(10) || 'To: C'][conv_id % 5 + 1] AS body FROM conversations)
SELECT conv_id, turn, md5(CASE WHEN conv_id % 5 = 0 THEN text ELSE regexp_replace(text, '\\s+$', '') END) AS own_md5, trim(substr(body, length(text) + 2)) AS quoted FROM b"""


def number_sets(spark, d):
    return read(spark, d, "documents").select("doc_id", F.array_join(T.numbers(F.col("text")), ",").alias("numbers"))


def labels(spark, d):
    c = F.concat(F.lit("theValue"), F.initcap("event_type"), F.lit("_of-x"))
    return read(spark, d, "events").select("event_type").distinct().select("event_type", E.normalize_label(c).alias("label"), E.relation_key(c).alias("relation_key"))


def sections(spark, d):
    s = read(spark, d, "documents").select("doc_id", T.segment_markdown("text").alias("s"))
    return s.select("doc_id", F.size("s.sections").alias("sections"), F.size(T.broken_sections(F.col("s.raw_text"), F.col("s.sections"))).alias("broken"))


def versions(spark, d):
    """The event stream as document versions: a user's events of a type replace each other."""
    return read(spark, d, "events").select(
        F.concat_ws("/", "user_id", "event_type").alias("document_id"), F.col("event_id").cast("string").alias("version_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("updated_at"), F.col("event_id").alias("seq"), (F.col("event_id") % 50 == 0).alias("deleted")
    )


VERSIONS_SQL = "v AS (SELECT user_id || '/' || event_type AS document_id, event_id::VARCHAR AS version_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS updated_at, event_id AS seq, event_id % 50 = 0 AS deleted FROM events)"


def raised(spark, d):
    return read(spark, d, "events").select(F.concat("event_type", F.lit("/"), F.col("user_id") % 20).alias("dedupe_key"), F.lit("LOW_CONFIDENCE_RELATION").alias("review_type"), F.when(F.col("event_id") % 7 != 0, (F.col("event_id") % 11).cast("string")).alias("example"), F.col("event_id").alias("doc_seq"))


def first_status(spark, d):
    out = G.first_values(evidence(spark, d).withColumn("property", F.lit("linestatus")), ["source_id"], "property", "value", "doc_seq")
    return out.withColumn("conflicts", F.array_join("conflicts", ","))


def entity_page(spark, d):
    v = G.entity_view(entities(project(spark, d)), identifiers(spark, d), aliases(spark, d))
    return v.select("entity_id", "entity_type", "canonical_name", F.array_join("aliases", "|").alias("aliases"), F.array_join(F.col("identifiers")["email"], "|").alias("emails"), F.array_join(F.col("identifiers")["mailbox"], "|").alias("mailboxes"))


def edge_page(spark, d):
    return G.edge_view(G.aggregate_edges(evidence(spark, d)), entities(project(spark, d)))


def graph_stats(spark, d):
    ev = evidence(spark, d)
    reviews = R.raise_items(raised(spark, d)).withColumn("status", F.lit("OPEN"))
    return G.stats(entities(project(spark, d)), G.aggregate_edges(ev), ev, read(spark, d, "orders"), reviews)


QUERIES = {
    "email_identity": email_identity,
    "quoted_mail": quoted,
    "number_sets": number_sets,
    "normalized_labels": labels,
    "document_sections": sections,
    "page_text": lambda s, d: read(s, d, "pages").select("page_id", T.html_to_text("html").alias("text")),
    "normalized_names": lambda s, d: read(s, d, "customer").select("c_custkey", T.normalize_name("c_name").alias("name"), T.name_key(F.col("c_name")).alias("name_key")),
    "question_grams": lambda s, d: read(s, d, "benchmark").select("item_id", F.array_join(T.question_grams(F.col("text")), "|").alias("grams")),
    "edge_aggregation": lambda s, d: G.aggregate_edges(evidence(s, d)),
    "edge_acceptance": lambda s, d: G.acceptance(G.aggregate_edges(evidence(s, d))).select("source_id", "relation", "target_id", "provenance", "confidence", "decision"),
    "edge_cardinality": lambda s, d: G.cardinality(evidence(s, d)),
    "implied_roles": lambda s, d: G.implied_roles(evidence(s, d)).select("entity_id", F.array_join("roles", ",").alias("roles")),
    "first_value_and_conflicts": first_status,
    "evidence_keys": lambda s, d: G.attach_evidence(evidence(s, d)).select("source_id", "relation", "target_id", "evidence_key", "doc_seq"),
    "identifier_owners": lambda s, d: G.own_identifiers(identifiers(s, d).withColumn("doc_seq", F.length("entity_id"))),
    "entity_view": entity_page,
    "edge_view": lambda s, d: G.get_edges(edge_page(s, d), "Person", "VENDOR_OF", "Person"),
    "outgoing_edges": lambda s, d: G.edges_of(edge_page(s, d), "c:5"),
    "incoming_edges": lambda s, d: G.edges_of(edge_page(s, d), "s:5", outgoing=False),
    "find_entity": lambda s, d: G.find_entity(entities(project(s, d)), identifiers(s, d), aliases(s, d), name="Customer#000000005"),
    "list_entities": lambda s, d: G.find_entity(entities(project(s, d)), identifiers(s, d), aliases(s, d), entity_type="Organization"),
    "edge_evidence": lambda s, d: G.evidence_of(evidence(s, d), read(s, d, "orders").select(key("o:", "o_orderkey").alias("document_id"), "o_orderstatus"), "c:5", "SENT_TO", "s:37"),
    "graph_stats": graph_stats,
    "latest_versions": lambda s, d: M.latest_versions(versions(s, d)),
    "stale_versions": lambda s, d: M.stale(versions(s, d).where("seq % 2 = 0").select("document_id", "updated_at"), M.latest_versions(versions(s, d).where("seq % 2 = 1"))),
    "unprocessed_versions": lambda s, d: M.to_process(versions(s, d), versions(s, d).where("seq % 3 = 0"), ("version_id",)).select("document_id", "version_id"),
    "garbage_versions": lambda s, d: M.garbage(versions(s, d).select("document_id", "version_id"), M.latest_versions(versions(s, d))),
    "pruned_documents": lambda s, d: M.prune(versions(s, d).select(F.concat(F.lit("s"), F.col("seq") % 4).alias("system"), "document_id").distinct(), versions(s, d).where("seq % 97 <> 0 and seq % 4 < 3").select(F.concat(F.lit("s"), F.col("seq") % 4).alias("system"), "document_id").distinct(), 0.5),
    "index_queue": lambda s, d: M.pending_index(versions(s, d).select("document_id", F.when(F.col("deleted"), "delete").otherwise("upsert").alias("action"), F.col("seq").alias("enqueued_at"))),
    "review_items": lambda s, d: R.raise_items(raised(s, d)).select("dedupe_key", "review_type", "frequency", F.array_join("examples", ",").alias("examples")),
}

_TAG = r"""(?:[^>"']|"[^"]*"|'[^']*')*""".replace("'", "''")


def _page_sql() -> str:
    """The markup rules one after another; entities that the pages use."""
    c = "html"
    for silent in T.SILENT:
        c = f"regexp_replace({c}, '(?is)<{silent}\\b{_TAG}>.*?(?:</{silent}\\s*>|\\z)', '', 'g')"
    c = f"regexp_replace({c}, '(?is)<!--.*?(?:-->|\\z)', '', 'g')"
    c = f"regexp_replace({c}, '(?is)</?(?:{'|'.join(T.LINES)})\\b{_TAG}>', chr(10), 'g')"
    c = f"regexp_replace({c}, '(?is)<[/!?]?[a-z]{_TAG}>', '', 'g')"
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        c = f"replace({c}, '{entity}', '{sign}')"
    lines = f"array_to_string(list_transform(string_split({c}, chr(10)), lambda x: trim(regexp_replace(x, '[ \\t\\r]+', ' ', 'g'))), chr(10))"
    return f"SELECT page_id, trim(regexp_replace({lines}, '\\n{{3,}}', chr(10) || chr(10), 'g'), chr(10) || ' ') AS text FROM pages"


PAGE_SQL = _page_sql()
_RUNS = ", ".join(f"list_transform(range(1, greatest(len(w) - {n} + 2, 1)), lambda i: lower(array_to_string(list_slice(w, i, i + {n} - 1), ' ')))" for n in (4, 3, 2, 1))
GRAMS_SQL = f"""WITH x AS (SELECT item_id, regexp_extract_all(text, '[\\p{{L}}\\p{{M}}\\p{{N}}@._+&''’-]+') AS xs FROM benchmark),
q AS (SELECT item_id, list_filter(list_transform(xs, lambda x: regexp_replace(regexp_replace(x, '^[.''’&+-]+', ''), '(?:[''’]s)?[.''’&+-]*$', '')), lambda x: x <> '') AS w FROM x)
SELECT item_id, replace(replace(array_to_string(flatten([{_RUNS}]), '|'), 'ß', 'ss'), 'ς', 'σ') AS grams FROM q"""
_E = f"WITH {EVIDENCE_SQL} "
_ENT = f"WITH {MODEL_SQL}, entities AS (SELECT person_id AS entity_id, 'Person' AS entity_type, name AS canonical_name, 'active' AS status FROM people UNION ALL SELECT org_id, 'Organization', name, 'active' FROM orgs)"
_VIEW = f"{_ENT}, {EVIDENCE_SQL}, view AS (SELECT e.*, s.canonical_name AS source_name, s.entity_type AS source_type, t.canonical_name AS target_name, t.entity_type AS target_type FROM edges e JOIN entities s ON s.entity_id = e.source_id JOIN entities t ON t.entity_id = e.target_id) "
_MAILBOX = f"SELECT entity_id, mailbox AS value FROM ({EMAIL_SQL})"
_LATEST = f"WITH {VERSIONS_SQL}, latest AS (SELECT document_id, max_by(struct_pack(i := version_id, u := updated_at, x := deleted), struct_pack(u := updated_at, s := seq)) AS m FROM v /*some*/ GROUP BY 1), cur AS (SELECT document_id, m.i AS version_id, m.u AS updated_at FROM latest WHERE NOT m.x) "

ORACLE_SQL = {
    "email_identity": EMAIL_SQL,
    "quoted_mail": QUOTED_SQL,
    "number_sets": """WITH x AS (SELECT doc_id, list_transform(regexp_extract_all(text, '\\d+'), lambda d: CASE WHEN ltrim(d, '0') = '' THEN '0' ELSE ltrim(d, '0') END) AS ds FROM documents),
u AS (SELECT DISTINCT doc_id, unnest(ds) AS d FROM x)
SELECT doc_id, CASE WHEN ds IS NOT NULL THEN coalesce((SELECT string_agg(d, ',' ORDER BY length(d), d) FROM u WHERE u.doc_id = x.doc_id), '') END AS numbers FROM x""",
    "page_text": PAGE_SQL,
    "question_grams": GRAMS_SQL,
    "normalized_labels": "SELECT DISTINCT event_type, 'the value ' || event_type || ' of x' AS label, 'THE_VALUE_' || upper(event_type) || '_OF_X' AS relation_key FROM events",
    "normalized_names": "SELECT c_custkey, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g')) AS name, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g')) AS name_key FROM customer",
    "edge_aggregation": _E + "SELECT * FROM edges",
    "edge_acceptance": _E + "SELECT source_id, relation, target_id, provenance, confidence, CASE WHEN confidence >= CASE provenance WHEN 'STRUCTURED_SOURCE' THEN 0.60 WHEN 'EXPLICIT_TEXT' THEN 0.85 ELSE 1.01 END THEN 'ACCEPTED' ELSE 'REVIEW' END AS decision FROM edges",
    "edge_cardinality": _E + """, f AS (SELECT source_id, relation, target_id, min(doc_seq) AS first FROM evidence GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY source_id, relation ORDER BY first, target_id) AS place FROM f)
SELECT source_id, relation, target_id, place::INTEGER AS place, CASE WHEN relation <> 'REPORTS_TO' OR place <= 1 THEN 'ACCEPTED' ELSE 'REVIEW' END AS decision FROM p""",
    "implied_roles": _E + "SELECT DISTINCT source_id AS entity_id, 'Vendor' AS roles FROM evidence WHERE relation = 'VENDOR_OF'",
    "first_value_and_conflicts": _E + "SELECT source_id, 'linestatus' AS property, v AS value, array_to_string(list_sort(list_filter(vs, lambda x: x <> v)), ',') AS conflicts FROM (SELECT source_id, min(struct_pack(q := doc_seq, v := value)).v AS v, list_distinct(list(value)) AS vs FROM evidence GROUP BY 1)",
    "evidence_keys": _E + "SELECT source_id, relation, target_id, evidence_key, min(doc_seq) AS doc_seq FROM evidence GROUP BY ALL",
    "identifier_owners": f"""SELECT identifier_type, value, min(struct_pack(n := length(entity_id), e := entity_id)).e AS entity_id FROM (
  SELECT entity_id, 'email' AS identifier_type, email AS value FROM ({EMAIL_SQL}) UNION ALL SELECT entity_id, 'mailbox', mailbox FROM ({EMAIL_SQL})) GROUP BY 1, 2""",
    "entity_view": _ENT + f""", a AS (SELECT * FROM ({EMAIL_SQL})), raw AS (WITH {ADDRESSES_SQL} SELECT * FROM addresses)
SELECT e.entity_id, entity_type, canonical_name, coalesce(r.display, '') AS aliases, a.email AS emails, a.mailbox AS mailboxes FROM entities e LEFT JOIN a USING (entity_id) LEFT JOIN raw r USING (entity_id)""",
    "edge_view": _VIEW + "SELECT * FROM view WHERE relation = 'VENDOR_OF'",
    "outgoing_edges": _VIEW + "SELECT * FROM view WHERE source_id = 'c:5'",
    "incoming_edges": _VIEW + "SELECT * FROM view WHERE target_id = 's:5'",
    "find_entity": _ENT + " SELECT * FROM entities WHERE canonical_name = 'Customer#000000005'",
    "list_entities": _ENT + " SELECT * FROM entities WHERE entity_type = 'Organization'",
    "edge_evidence": _E + "SELECT e.*, o_orderstatus FROM evidence e JOIN orders ON document_id = 'o:' || o_orderkey WHERE source_id = 'c:5' AND relation = 'SENT_TO' AND target_id = 's:37'",
    "graph_stats": f"{_ENT}, {EVIDENCE_SQL} SELECT (SELECT count(*) FROM entities) AS entities, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM evidence) AS evidence, (SELECT count(*) FROM orders) AS documents, (SELECT count(DISTINCT event_type || '/' || user_id % 20) FROM events) AS open_reviews, 0::BIGINT AS unsupported_edges",
    "latest_versions": _LATEST + "SELECT * FROM cur",
    "stale_versions": _LATEST.replace("/*some*/", "WHERE seq % 2 = 1") + "SELECT v.document_id, v.updated_at FROM v JOIN cur USING (document_id) WHERE v.seq % 2 = 0 AND v.updated_at < cur.updated_at",
    "unprocessed_versions": f"WITH {VERSIONS_SQL} SELECT document_id, version_id FROM v WHERE seq % 3 <> 0",
    "garbage_versions": _LATEST + "SELECT document_id, version_id FROM v WHERE (document_id, version_id) NOT IN (SELECT (document_id, version_id) FROM cur)",
    "pruned_documents": f"""WITH {VERSIONS_SQL}, st AS (SELECT DISTINCT 's' || seq % 4 AS system, document_id FROM v), sn AS (SELECT DISTINCT 's' || seq % 4 AS system, document_id FROM v WHERE seq % 97 <> 0 AND seq % 4 < 3),
gone AS (SELECT * FROM st WHERE system IN (SELECT system FROM sn) EXCEPT SELECT * FROM sn), sh AS (SELECT system FROM st GROUP BY 1 HAVING (SELECT count(*) FROM gone g WHERE g.system = st.system) <= 0.5 * count(*))
SELECT * FROM gone WHERE system IN (SELECT system FROM sh)""",
    "index_queue": f"WITH {VERSIONS_SQL} SELECT document_id, max_by(CASE WHEN deleted THEN 'delete' ELSE 'upsert' END, seq) AS action, max(seq) AS enqueued_at FROM v GROUP BY 1",
    "review_items": """WITH r AS (SELECT event_type || '/' || user_id % 20 AS k, CASE WHEN event_id % 7 <> 0 THEN (event_id % 11)::VARCHAR END AS x, event_id AS q FROM events),
f AS (SELECT k, x, min(q) AS first FROM r WHERE x IS NOT NULL GROUP BY ALL), kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY first, x) AS n FROM f) WHERE n <= 5)
SELECT r.k AS dedupe_key, 'LOW_CONFIDENCE_RELATION' AS review_type, (count(DISTINCT kept.x) + count(*) FILTER (kept.x IS NULL))::BIGINT AS frequency,
  coalesce((SELECT string_agg(x, ',' ORDER BY n) FROM kept z WHERE z.k = r.k), '') AS examples FROM r LEFT JOIN kept ON kept.k = r.k AND kept.x = r.x GROUP BY r.k""",
}
