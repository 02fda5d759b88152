"""E-mail identity as column expressions: every function is built in, so it stays in generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import policy as P

NAMESPACE = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"
ALPHA = r"^[a-z]{2,}$"


def normalize_email(c: Column) -> Column:
    return F.lower(F.trim(c))


def normalize_domain(c: Column) -> Column:
    """Without scheme, path, leading www. and final dots."""
    host = F.regexp_replace(F.lower(F.trim(c)), r"^[a-z][a-z0-9+.-]*://", "")
    return F.regexp_replace(F.regexp_replace(F.substring_index(host, "/", 1), r"^www\.", ""), r"\.+$", "")


def local_part(email: Column) -> Column:
    return F.substring_index(normalize_email(email), "@", 1)


def domain_of(email: Column) -> Column:
    e = normalize_email(email)
    return F.when(F.contains(e, F.lit("@")), F.substring(e, F.instr(e, "@") + 1, F.length(e)))


def normalize_identifier(kind: Column, value: Column) -> Column:
    """Case does not count for e-mail, domain, team key and mailbox; other identifiers keep it."""
    return F.when(kind == "domain", normalize_domain(value)).when(kind.isin("email", "team_key", "mailbox"), normalize_email(value)).otherwise(F.trim(value))


def normalize_label(c: Column) -> Column:
    """camelCase, snake_case and kebab-case as spaced lower case."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1 $2"), r"[\s_-]+", " ")))


def relation_key(c: Column) -> Column:
    return F.upper(F.replace(normalize_label(c), F.lit(" "), F.lit("_")))


def registrable_domain(domain: Column) -> Column:
    """The last two labels, or three after a listed suffix of two."""
    labels = F.split(F.trim(F.lower(domain), F.lit(".")), r"\.")
    two = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")
    three = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 2, F.lit(1)), 3), ".")
    return F.when((F.size(labels) > 2) & two.isin(P.MULTI_PART_SUFFIXES), three).otherwise(two)


def provider_mailbox(email: Column) -> Column:
    """The mailbox behind a provider's spellings, null for other domains."""
    local, domain, out = local_part(email), domain_of(email), F.lit(None).cast("string")
    for name, (same, dots, tag) in P.PROVIDERS.items():
        x = F.substring_index(local, "+", 1) if tag else local
        x = F.replace(x, F.lit("."), F.lit("")) if dots else x
        out = F.when((domain == name) & (x != ""), F.concat(x, F.lit(f"@{same}"))).otherwise(out)
    return out


def mailbox(email: Column) -> Column:
    """The address a person is known by: the provider's, or the local part at the registrable domain."""
    return F.coalesce(provider_mailbox(email), F.concat(local_part(email), F.lit("@"), registrable_domain(domain_of(email))))


#: first[.m].last with . or _ between (the surname may hold a hyphen), or first[-m]-last.
_DOTTED = r"^[._]*([a-z]{2,})(?:[._]+[a-z])?[._]+([a-z]+-[a-z]+|[a-z]{2,})[._]*$"
_DASHED = r"^-*([a-z]{2,})(?:-+[a-z])?-+([a-z]{2,})-*$"


_EITHER = f"^(?:{_DOTTED[1:-1]}|{_DASHED[1:-1]})$"


def name_from_local(local: Column) -> Column:
    """struct<first, last> or null."""
    both = lambda i: F.concat(F.regexp_extract(local, _EITHER, i), F.regexp_extract(local, _EITHER, i + 2))
    return F.when(local.rlike(_EITHER), F.struct(both(1).alias("first"), both(2).alias("last")))


def name_from_display(display: Column) -> Column:
    """struct<first, last> of "First ... Last" or "Last, First ..." if both are plain names, or null."""
    text = F.trim(F.regexp_replace(F.trim(display), "^['\"]+|['\"]+$", ""))
    comma = F.contains(text, F.lit(","))
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    given = F.filter(F.split(F.substring(text, F.instr(text, ",") + 1, F.length(text)), r"\s+"), lambda w: w != "")
    first = F.when(comma, F.get(given, F.lit(0))).otherwise(F.get(words, F.lit(0)))
    last = F.when(comma, F.trim(F.substring_index(text, ",", 1))).when(F.size(words) > 1, F.element_at(words, -1))
    clean = lambda c: F.lower(F.regexp_replace(c, r"^\.+|\.+$", ""))
    ok = ~F.contains(text, F.lit("@")) & clean(first).rlike(ALPHA) & clean(last).rlike(ALPHA)
    return F.when(ok, F.struct(clean(first).alias("first"), clean(last).alias("last")))


def display_name(name: Column) -> Column:
    """Capitalised, each piece of a hyphenated surname too."""
    last = F.array_join(F.transform(F.split(name["last"], "-"), F.initcap), "-")
    return F.when(name.isNotNull(), F.concat_ws(" ", F.initcap(name["first"]), last))


def handles(name: Column) -> Column:
    """Other local parts of a person: flast and lastname."""
    return F.array(F.concat(F.substring(name["first"], 1, 1), name["last"]), name["last"])


def is_generic_domain(domain: Column) -> Column:
    """An excluded domain or a subdomain of one: a suffix of labels is listed."""
    labels = F.split(domain, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.coalesce(F.arrays_overlap(suffixes, F.array(*map(F.lit, P.EXCLUDED_DOMAINS))), F.lit(False))


def is_bulk_sender(email: Column) -> Column:
    local, labels = local_part(email), F.split(domain_of(email), r"\.")
    affix = "^(?:" + "|".join(P.BULK_PREFIXES) + ")|(?:" + "|".join(P.BULK_SUFFIXES) + ")$"
    return F.coalesce(local.isin(P.BULK_LOCAL_PARTS) | local.rlike(affix) | ((F.size(labels) >= 3) & F.get(labels, F.lit(0)).isin(P.BULK_LABELS)), F.lit(False))


def is_role_address(email: Column) -> Column:
    return F.coalesce(local_part(email).isin(P.ROLE_LOCAL_PARTS), F.lit(False))


def person_name(email: Column, name: Column) -> Column:
    """The name to show: of a role address the address, else the given name, the name in the address, the address."""
    return F.when(is_role_address(email), normalize_email(email)).otherwise(F.coalesce(F.nullif(F.trim(name), F.lit("")), display_name(name_from_local(local_part(email))), normalize_email(email)))


def uuid5(text: Column, namespace: str = NAMESPACE) -> Column:
    """Version 5 UUID of a text."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(text, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(F.substring(variant, -1, 1), F.substring(h, 18, 3)), F.substring(h, 21, 12))


def evidence_key(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\u001f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 32)


def describe(addresses: DataFrame, email: str = "email", display: str = "display") -> DataFrame:
    """Everything that an address and a display name say, in steps, so that no step's code repeats the one before."""
    e, local, domain = F.col("_e"), F.col("_local"), F.col("_domain")
    d = addresses.withColumn("_e", normalize_email(F.col(email)))
    d = d.withColumns({"_local": local_part(e), "_domain": domain_of(e)})
    d = d.withColumns({"_name": name_from_local(local), "_shown": name_from_display(F.col(display)), "_org": registrable_domain(domain), "_box": provider_mailbox(e)})
    out = {
        "email": e, "local": local, "domain": domain, "org_domain": F.col("_org"), "provider_mailbox": F.col("_box"), "mailbox": F.coalesce("_box", F.concat("_local", F.lit("@"), "_org")),
        "first": F.col("_name.first"), "last": F.col("_name.last"), "shown_first": F.col("_shown.first"), "shown_last": F.col("_shown.last"),
        "generic": is_generic_domain(domain), "bulk": is_bulk_sender(e), "role_address": is_role_address(e),
        "person_name": F.when(is_role_address(e), e).otherwise(F.coalesce(F.nullif(F.trim(display), F.lit("")), display_name(F.col("_name")), e)),
    }
    return d.withColumns(out).drop("_e", "_local", "_domain", "_name", "_shown", "_org", "_box")
