"""Links the names of questions to entities: addresses, names and aliases, company domains; and ranks candidates by affinity.

All questions are linked at once: their n-grams are joined with addresses, names and domain labels by equality. Names of any
script are compared as name_key has them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from attesta.functions.text import fold, name_key, question_words
from attesta.operators.interactions import affinity, org_affinity, title_search

LONGEST, PREFIX, LEAD, SHOWN, TITLES = 4, 4, 3, 15, 10
LEAST_LABEL = 3


def runs(questions: DataFrame, longest: int = LONGEST) -> DataFrame:
    """question_id, gram, n_words, capital of every run of up to ``longest`` words, wherever it stands."""
    q = questions.select("question_id", question_words(F.col("text")).alias("w")).where("size(w) > 0")
    q = q.select("question_id", "w", F.explode(F.sequence(F.lit(1), F.lit(longest))).alias("n_words")).where("n_words <= size(w)")
    q = q.select("question_id", "w", "n_words", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("n_words") + 1)).alias("at"))
    words = F.slice("w", F.col("at"), F.col("n_words"))
    said = q.select("question_id", "n_words", F.array_join(words, " ").alias("said"))
    # a script without upper case has no capitals to ask for
    return said.withColumn("gram", fold(F.col("said"))).withColumn("capital", F.col("said").rlike(r"^[\p{Lu}\p{Lt}\p{Lo}]")).drop("said")


def grams(questions: DataFrame, longest: int = LONGEST) -> DataFrame:
    """The runs, each once in a question."""
    return runs(questions, longest).distinct()


def entity_names(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """entity_id, entity_type, key of every name and alias of the active entities."""
    live = entities.where("status = 'active'")
    names = live.select("entity_id", "entity_type", name_key(F.col("canonical_name")).alias("key"))
    return names.union(aliases.join(live.select("entity_id", "entity_type"), "entity_id").select("entity_id", "entity_type", name_key(F.col("alias")))).where("key <> ''").distinct()


def link_entities(questions: DataFrame, entities: DataFrame, identifiers: DataFrame, aliases: DataFrame) -> DataFrame:
    """question_id, gram, entity_id of grams that mean exactly one entity; a gram within a longer linked one is left out.

    An address links to its owner; two words or more to a name or alias of a person or company or, where there is none and they are
    capitalised, to the company whose domain's label they make; one capitalised word to a company's name or domain label.
    """
    # names are as many as entities, and so are never sent to every task
    entities = entities.hint("merge")
    live = entities.where("status = 'active'")
    names = entity_names(entities, aliases).where("entity_type in ('Person', 'Organization')")
    labels = identifiers.where("identifier_type = 'domain'").join(live.select("entity_id"), "entity_id", "left_semi").select("entity_id", F.substring_index("value", ".", 1).alias("key"))
    owners = identifiers.where("identifier_type = 'email'").join(live.select("entity_id"), "entity_id", "left_semi").select("entity_id", F.col("value").alias("key"))
    # what a gram may stand for: an address, a name of several words, else the label they make (Bank of America, bankofamerica.com), or one word of a company
    companies = names.where("entity_type = 'Organization'").select("entity_id", "key").union(labels)
    known = [(owners, "address"), (names.select("entity_id", "key"), "name"), (labels, "label"), (companies, "word")]
    known = reduce(DataFrame.union, [df.select("entity_id", "key", F.lit(kind).alias("kind")) for df, kind in known])
    # a row for each key, however many have it: more than one is no link
    known = known.groupBy("kind", "key").agg(F.min("entity_id").alias("low"), F.max("entity_id").alias("high"))
    # a question is as many rows as it has runs of words, so questions are dealt before they are taken apart
    g = runs(questions.repartition("question_id")).withColumn("name", name_key(F.col("gram")))
    at, one_word = F.contains("gram", F.lit("@")), F.col("n_words") == 1
    as_kind = lambda kind, key, when: F.when(when, F.struct(F.lit(kind).alias("kind"), key.alias("key")))
    asked = F.array_compact(F.array(
        as_kind("address", F.lower("gram"), at & one_word), as_kind("name", F.col("name"), ~at & ~one_word & (F.col("name") != "")),
        as_kind("label", F.replace("name", F.lit(" "), F.lit("")), ~at & ~one_word & F.col("capital") & (F.col("name") != "")),
        as_kind("word", F.col("name"), ~at & one_word & F.col("capital") & (F.length("name") >= LEAST_LABEL)),
    ))
    hits = g.select("question_id", "gram", F.explode(asked).alias("a")).select("question_id", "gram", "a.kind", "a.key").join(known.hint("merge"), ["kind", "key"])
    # of one gram a label counts only where nobody has the name
    plain = F.col("kind") != "label"
    ends = [F.coalesce(f(F.when(plain, F.col(c))), f(c)).alias(c) for f, c in ((F.min, "low"), (F.max, "high"))]
    one = hits.groupBy("question_id", "gram").agg(*ends).where("low = high").select("question_id", "gram", F.col("low").alias("entity_id"))
    # a question has a handful of linked grams
    all_grams = one.groupBy("question_id").agg(F.collect_list("gram").alias("others"))
    return one.join(all_grams, "question_id").where(~F.exists("others", lambda o: (F.length(o) > F.length("gram")) & F.contains(o, F.col("gram")))).drop("others")


def person_candidates(people: DataFrame, said: str, emails: DataFrame | None = None, aliases: DataFrame | None = None) -> DataFrame:
    """People (person_id, name) that a name may mean: the whole name or alias; of one word also the first name or the start of an address;
    of more, where nobody has the whole name, the last name with first names of which one begins with the other."""
    spark = people.sparkSession
    key = spark.createDataFrame([(said,)], "said string").select(name_key(F.col("said"))).first()[0] or ""
    words = key.split()
    if not words:
        return people.select("person_id", "name").limit(0)
    names = people.select(F.col("person_id").alias("id"), name_key(F.col("name")).alias("key"), F.lit(True).alias("own"))
    if aliases is not None:
        more = aliases.select(F.col("entity_id").alias("id"), name_key(F.col("alias")).alias("key"), F.lit(False).alias("own"))
        names = names.union(more.join(people.select(F.col("person_id").alias("id")), "id", "left_semi"))
    exact = names.where(F.col("key") == key).select("id")
    if len(words) == 1:
        hit = exact.union(names.where(F.substring_index("key", " ", 1) == key).select("id"))
        if emails is not None:
            local = F.substring_index(F.substring_index("email", "@", 1), ".", 1)
            hit = hit.union(emails.where(local == key).select(F.col("person_id").alias("id")))
    else:
        first, last = F.substring_index("key", " ", 1), F.substring_index("key", " ", -1)
        near = names.where(F.col("own") & F.contains("key", F.lit(" ")) & (last == words[-1]) & (F.startswith(first, F.lit(words[0])) | F.startswith(F.lit(words[0]), first)))
        none = exact.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(1).alias("one"))
        # one row or none: nobody has the whole name
        hit = exact.union(near.select("id", F.lit(1).alias("one")).join(F.broadcast(none), "one").select("id"))
    return people.join(hit.distinct(), F.col("person_id") == F.col("id"), "left_semi").select("person_id", "name").distinct()


def org_candidates(orgs: DataFrame, said: str, domains: DataFrame | None = None, aliases: DataFrame | None = None) -> DataFrame:
    """Organizations (org_id, name) of that name, alias or domain label, else, of four letters or more, whose domain or name begins with the first word."""
    spark = orgs.sparkSession
    key = spark.createDataFrame([(said,)], "said string").select(name_key(F.col("said"))).first()[0] or ""
    if not key:
        return orgs.select("org_id", "name").limit(0)
    label, first = key.replace(" ", ""), key.split()[0]
    names = orgs.select("org_id", name_key(F.col("name")).alias("key"), F.lower(F.substring_index("name", ".", 1)).alias("label"))
    if domains is not None:
        names = names.union(domains.select("org_id", F.lit("").alias("key"), F.substring_index("domain", ".", 1)))
    if aliases is not None:
        names = names.union(aliases.select(F.col("entity_id").alias("org_id"), name_key(F.col("alias")), F.lit("")))
    begins = F.startswith("label", F.lit(first)) if len(first) >= PREFIX else F.lit(False)
    rank = F.when((F.col("key") == key) | (F.col("label") == label), 1).when(begins, 2)
    ranked = names.withColumn("rank", rank).where("rank is not null").groupBy("org_id").agg(F.min("rank").alias("rank"))
    ranked = ranked.withColumn("best", F.min("rank").over(Window.partitionBy(F.lit(1)))).where("rank = best")
    return orgs.join(ranked.select("org_id"), "org_id", "left_semi").select("org_id", "name")


def find(people: DataFrame, orgs: DataFrame, parts: DataFrame, said: str, asker: str | None = None, limit: int = SHOWN) -> DataFrame:
    """id, type, name, score: people and companies ranked by events shared with the asker (without one, by all events); the asker is left out."""
    return _ranked(people, orgs, parts, person_candidates(people, said), org_candidates(orgs, said), asker).orderBy(F.desc("score"), "id").limit(limit)


def _ranked(people: DataFrame, orgs: DataFrame, parts: DataFrame, p: DataFrame, o: DataFrame, asker: str | None, works: DataFrame | None = None) -> DataFrame:
    who = p.join(affinity(parts, p, asker), "person_id").select(F.col("person_id").alias("id"), F.lit("Person").alias("type"), "name", "score")
    what = o.join(org_affinity(parts, people if works is None else works, o, asker), "org_id").select(F.col("org_id").alias("id"), F.lit("Organization").alias("type"), "name", "score")
    out = who.union(what)
    return out.where(F.col("id") != asker) if asker else out


def find_records(model, said: str, kind: str | None = None, asker: str | None = None, limit: int = SHOWN) -> DataFrame:
    """id, type, name, score, email, organization, event_at: everything of a graph that a name, address or title may mean.

    An address means its owner. Otherwise people, companies and, by all words of the title, the newest meetings and documents; kind asks for one type.
    Ranked by events shared with the asker, titles after them by time.
    """
    emails = domains = None
    if model.identifiers is not None:
        emails = model.identifiers.where("identifier_type = 'email'").select(F.col("entity_id").alias("person_id"), F.col("value").alias("email"))
        domains = model.identifiers.where("identifier_type = 'domain'").select(F.col("entity_id").alias("org_id"), F.col("value").alias("domain"))
    none = model.events.limit(0)
    if "@" in said and emails is not None:
        owner = emails.where(F.col("email") == said.strip().lower()).select("person_id")
        p, o, titles = model.people.join(owner, "person_id", "left_semi").select("person_id", "name"), model.orgs.select("org_id", "name").limit(0), none
    else:
        p = person_candidates(model.people, said, emails, model.aliases) if kind in (None, "Person") else model.people.select("person_id", "name").limit(0)
        o = org_candidates(model.orgs, said, domains, model.aliases) if kind in (None, "Organization") else model.orgs.select("org_id", "name").limit(0)
        of_kind = {"Meeting": "meeting", "Document": "email"}.get(kind)
        events = model.events.where(F.col("kind") == of_kind) if of_kind else model.events
        titles = title_search(events, said.split(), TITLES) if kind in (None, "Meeting", "Document") else none
    ranked = _ranked(model.people, model.orgs, model.parts, p, o, asker, model.works)
    first_email = emails.groupBy(F.col("person_id").alias("id")).agg(F.min("email").alias("email")) if emails is not None else ranked.sparkSession.createDataFrame([], "id string, email string")
    staff = (model.works if model.works is not None else model.people.select("person_id", "org_id")).join(model.orgs.select("org_id", F.col("name").alias("organization")), "org_id")
    first_org = staff.groupBy(F.col("person_id").alias("id")).agg(F.min("organization").alias("organization"))
    ranked = ranked.join(first_email, "id", "left").join(first_org, "id", "left").withColumn("event_at", F.lit(None).cast("string"))
    null = F.lit(None).cast("string")
    named = titles.select(F.col("event_id").alias("id"), F.when(F.col("kind") == "meeting", "Meeting").otherwise("Document").alias("type"), F.col("title").alias("name"), F.lit(None).cast("long").alias("score"), null.alias("email"), null.alias("organization"), F.col("event_at"))
    out = ranked.select("id", "type", "name", "score", "email", "organization", "event_at").union(named)
    return out.orderBy(F.desc_nulls_last("score"), F.desc_nulls_last("event_at"), "id").limit(limit)


def close_candidates(found: DataFrame, lead: int = LEAD) -> bool:
    """Whether the best candidate does not lead clearly."""
    top = [r["score"] for r in found.where("score is not null").orderBy(F.desc("score"), "id").limit(2).collect()]
    return len(top) == 2 and (top[0] == 0 or top[0] < lead * top[1])


def resolve_mentions(people: DataFrame, orgs: DataFrame, parts: DataFrame, mentions: list[tuple[str, str | None]], asker: str | None = None, emails: DataFrame | None = None, aliases: DataFrame | None = None, works: DataFrame | None = None) -> list[dict]:
    """(person, company or None) mentions as linked, ambiguous or unknown: the company first, then the person among its people."""
    out = []
    for said, company in mentions:
        staff, org = people, None
        if company:
            best = _ranked(people, orgs, parts, people.select("person_id", "name").limit(0), org_candidates(orgs, company, None, aliases), asker, works)
            org = best.orderBy(F.desc("score"), "id").first()
            if org:
                inside = (people if works is None else works).where(F.col("org_id") == org["id"]).select("person_id")
                staff = people.join(inside, "person_id", "left_semi")
        found = _ranked(people, orgs, parts, person_candidates(staff, said, emails, aliases), orgs.select("org_id", "name").limit(0), asker, works)
        rows = found.orderBy(F.desc("score"), "id").limit(5).collect()
        lead = len(rows) < 2 or (rows[0]["score"] > 0 and rows[0]["score"] >= LEAD * rows[1]["score"])
        outcome = "unknown" if not rows else "linked" if lead else "ambiguous"
        out.append({"said": said, "company": org["id"] if org else None, "outcome": outcome, "candidates": [r["id"] for r in (rows[:1] if outcome == "linked" else rows)], "names": [r["name"] for r in (rows[:1] if outcome == "linked" else rows)]})
    return out
