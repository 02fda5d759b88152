"""The evidence graph: edges as an aggregate of evidence, entities with identifiers and aliases, and the read API.

Shapes. evidence: source_id, relation, target_id, document_id, evidence_key, doc_seq, observed_at, confidence, provenance,
properties map. entities: entity_id, entity_type, canonical_name, status, roles, properties. aliases: entity_id, alias.
identifiers: entity_id, identifier_type, value. Deletion needs no code of its own: what current evidence does not support is not there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from attesta.functions import policy as P


def provenance_rank(c: Column) -> Column:
    out = F.lit(0)
    for name, (rank, _, _) in P.PROVENANCE.items():
        out = F.when(c == name, rank).otherwise(out)
    return out


def threshold(c: Column) -> Column:
    """The least confidence that is accepted without review; an unknown class is never."""
    out = F.lit(1.01)
    for name, (_, _, least) in P.PROVENANCE.items():
        out = F.when(c == name, least).otherwise(out)
    return out


def current_evidence(evidence: DataFrame, versions: DataFrame) -> DataFrame:
    """Evidence of the documents' current versions (document_id, version_id)."""
    return evidence.join(versions.select("document_id", "version_id"), ["document_id", "version_id"], "left_semi")


def aggregate_edges(evidence: DataFrame) -> DataFrame:
    """One edge for each (source, relation, target): strongest provenance (the first of equals), greatest confidence, first and last seen."""
    first = F.struct(provenance_rank(F.col("provenance")).alias("rank"), (-F.col("doc_seq")).alias("order"), "provenance")
    return evidence.groupBy("source_id", "relation", "target_id").agg(
        F.max(first)["provenance"].alias("provenance"), F.max("confidence").alias("confidence"),
        F.min("observed_at").alias("first_seen"), F.max("observed_at").alias("last_seen"), F.count("*").alias("evidence_count"),
    )


def attach_evidence(evidence: DataFrame) -> DataFrame:
    """One row for each edge and evidence key: the first document's."""
    w = Window.partitionBy("source_id", "relation", "target_id", "evidence_key").orderBy("doc_seq")
    return evidence.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def first_values(facts: DataFrame, keys: list[str], name: str, value: str, order: str) -> DataFrame:
    """A property's value is the first document's that has one; other values are conflicts, in order."""
    some = facts.where(F.col(value).isNotNull())
    first = F.min(F.struct(order, value))[value]
    return some.groupBy(*keys, name).agg(first.alias(value), F.sort_array(F.collect_set(value)).alias("all_values")).withColumn("conflicts", F.array_except("all_values", F.array(value))).drop("all_values")


def cardinality(edges: DataFrame, order: str = "doc_seq") -> DataFrame:
    """decision: ACCEPTED, or REVIEW of a target beyond a relation's limit; targets count in order of their first document."""
    limit = F.lit(None).cast("int")
    for relation, (_, _, most, _) in P.RELATIONS.items():
        if most:
            limit = F.when(F.col("relation") == relation, most).otherwise(limit)
    first = edges.groupBy("source_id", "relation", "target_id").agg(F.min(order).alias("first"))
    place = F.row_number().over(Window.partitionBy("source_id", "relation").orderBy("first", "target_id"))
    return first.withColumn("place", place).select("source_id", "relation", "target_id", "place", F.when(limit.isNull() | (F.col("place") <= limit), "ACCEPTED").otherwise("REVIEW").alias("decision"))


def acceptance(edges: DataFrame) -> DataFrame:
    """decision by provenance class and confidence."""
    return edges.withColumn("decision", F.when(F.col("confidence") >= threshold(F.col("provenance")), "ACCEPTED").otherwise("REVIEW"))


def implied_roles(edges: DataFrame) -> DataFrame:
    """entity_id, roles that its relations give it."""
    role = F.lit(None).cast("string")
    for relation, (_, _, _, gives) in P.RELATIONS.items():
        if gives:
            role = F.when(F.col("relation") == relation, gives).otherwise(role)
    return edges.select(F.col("source_id").alias("entity_id"), role.alias("role")).where("role is not null").groupBy("entity_id").agg(F.sort_array(F.collect_set("role")).alias("roles"))


def edge_properties(evidence: DataFrame) -> DataFrame:
    """source_id, relation, target_id, properties: of each property the first document's value that there is."""
    key = ["source_id", "relation", "target_id"]
    each = evidence.select(*key, "doc_seq", F.explode("properties").alias("name", "value")).groupBy(*key, "name").agg(F.min(F.when(F.col("value").isNotNull(), F.struct("doc_seq", "value")))["value"].alias("value"))
    return each.where("value is not null").groupBy(*key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "value")))).alias("properties"))


def own_identifiers(claims: DataFrame) -> DataFrame:
    """The owner of (identifier_type, value) is its first claimant and never changes."""
    w = Window.partitionBy("identifier_type", "value").orderBy("doc_seq", "entity_id")
    return claims.withColumn("n", F.row_number().over(w)).where("n = 1").select("identifier_type", "value", "entity_id")


def entity_view(entities: DataFrame, identifiers: DataFrame, aliases: DataFrame) -> DataFrame:
    """Entities with all their identifiers by type, and sorted aliases other than the name."""
    ids = identifiers.groupBy("entity_id", "identifier_type").agg(F.sort_array(F.collect_set("value")).alias("values"))
    ids = ids.groupBy("entity_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("identifier_type", "values")))).alias("identifiers"))
    names = aliases.groupBy("entity_id").agg(F.sort_array(F.collect_set("alias")).alias("aliases"))
    out = entities.join(ids, "entity_id", "left").join(names, "entity_id", "left")
    return out.withColumn("aliases", F.coalesce(F.filter("aliases", lambda a: a != F.col("canonical_name")), F.array().cast("array<string>")))


def edge_view(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges with the names and types of both ends."""
    end = lambda side: entities.select(F.col("entity_id").alias(f"{side}_id"), F.col("canonical_name").alias(f"{side}_name"), F.col("entity_type").alias(f"{side}_type"))
    return edges.join(end("source"), "source_id").join(end("target"), "target_id")


def find_entity(entities: DataFrame, identifiers: DataFrame, aliases: DataFrame, name: str | None = None, identifier: str | None = None, entity_type: str | None = None) -> DataFrame:
    """Entities that meet all the conditions given; a name is matched with names and aliases by two equi-joins, not by OR."""
    out = entities.where(F.col("status") == "active")
    if entity_type:
        out = out.where(F.col("entity_type") == entity_type)
    if identifier:
        out = out.join(identifiers.where(F.lower("value") == identifier.lower()).select("entity_id"), "entity_id", "left_semi")
    if name:
        low = name.lower()
        hits = entities.where(F.lower("canonical_name") == low).select("entity_id").union(aliases.where(F.lower("alias") == low).select("entity_id"))
        out = out.join(hits, "entity_id", "left_semi")
    return out.orderBy("canonical_name", "entity_id")


def edges_of(view: DataFrame, entity_id: str, outgoing: bool = True) -> DataFrame:
    near, far = ("source", "target") if outgoing else ("target", "source")
    return view.where(F.col(f"{near}_id") == entity_id).orderBy("relation", f"{far}_name", f"{far}_id")


def get_edges(view: DataFrame, source_type: str | None = None, relation: str | None = None, target_type: str | None = None) -> DataFrame:
    for name, value in (("source_type", source_type), ("relation", relation), ("target_type", target_type)):
        if value:
            view = view.where(F.col(name) == value)
    return view


def evidence_of(evidence: DataFrame, documents: DataFrame, source_id: str, relation: str, target_id: str) -> DataFrame:
    mine = evidence.where((F.col("source_id") == source_id) & (F.col("relation") == relation) & (F.col("target_id") == target_id))
    return mine.join(documents, "document_id", "left").orderBy(F.col("observed_at").asc_nulls_last(), "evidence_key")


def explain_edge(edges: DataFrame, evidence: DataFrame, documents: DataFrame, decisions: DataFrame, source_id: str, relation: str, target_id: str) -> dict[str, DataFrame]:
    """The edge, its evidence and the candidate decisions behind it."""
    mine = lambda df: df.where((F.col("source_id") == source_id) & (F.col("relation") == relation) & (F.col("target_id") == target_id))
    return {"edge": mine(edges), "evidence": evidence_of(evidence, documents, source_id, relation, target_id), "decisions": mine(decisions)}


def stats(entities: DataFrame, edges: DataFrame, evidence: DataFrame, documents: DataFrame, reviews: DataFrame) -> DataFrame:
    """One row of counts, with edges that no evidence supports."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    key = ["source_id", "relation", "target_id"]
    counts = [n(entities, "entities"), n(edges, "edges"), n(evidence, "evidence"), n(documents, "documents"), n(reviews.where("status = 'OPEN'"), "open_reviews"), n(edges.join(evidence.select(*key), key, "left_anti"), "unsupported_edges")]
    out = counts[0]
    for c in counts[1:]:  # rows of one row each
        out = out.join(F.broadcast(c))
    return out
