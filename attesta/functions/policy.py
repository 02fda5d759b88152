"""The default ontology and policies.

Fixed values: type, relation and alias names, thresholds and address lists are the interface of the data model, so
they are stated here as they are; everything that reads them is elsewhere.
"""

from __future__ import annotations

#: Fixed values. Type: (parent, identity fields, properties).
ENTITY_TYPES = {
    "Person": (None, ["email", "employee_id", "mailbox"], ["canonical_name", "first_name", "last_name", "email", "job_title", "department"]),
    "Organization": (None, ["domain", "external_id"], ["canonical_name", "domain", "organization_type", "is_internal"]),
    "Document": (None, ["source_id"], ["title", "source_system", "source_id", "mime_type", "created_at", "modified_at", "uri", "checksum"]),
    "Project": (None, ["project_key", "external_id"], ["canonical_name", "status", "start_date", "end_date", "description"]),
    "Event": (None, ["event_external_id"], ["name", "event_type", "start_time", "end_time", "location", "description"]),
    "Location": (None, ["external_id"], ["canonical_name", "address", "location_type"]),
    "Team": (None, ["team_key", "external_id"], ["canonical_name", "description"]),
    "Meeting": ("Event", ["meeting_external_id"], ["title", "source_system", "meeting_external_id", "is_external"]),
    "Product": (None, ["external_id"], ["canonical_name", "description"]),
    "Contract": (None, ["contract_number", "external_id"], ["name", "contract_number", "effective_date", "expiration_date", "status", "value", "currency"]),
    "Initiative": (None, ["external_id"], ["canonical_name", "description"]),
    "ActionItem": (None, ["action_item_key", "external_id"], ["description", "status", "due_date", "source_system", "recording_timestamp", "playback_url"]),
    "Opportunity": (None, ["external_id"], ["name", "stage", "value", "currency", "expected_close_date", "external_id"]),
}
#: Fixed values. Role: the type that may have it.
ROLES = {"Customer": "Organization", "Vendor": "Organization"}
BUSINESS = ["Organization", "Project", "Initiative", "Product", "Contract", "Opportunity"]
#: Fixed values. Relation: (source types, target types, most targets of a source, role of the source).
RELATIONS = {
    "WORKS_AT": (["Person"], ["Organization"], None, None),
    "MEMBER_OF": (["Person"], ["Team", "Organization"], None, None),
    "MANAGES": (["Person"], ["Person", "Team"], None, None),
    "REPORTS_TO": (["Person"], ["Person"], 1, None),
    "ATTENDED": (["Person"], ["Meeting"], None, None),
    "HAS_PARTICIPANT": (["Event"], ["Person", "Organization"], None, None),
    "ORGANIZED_BY": (["Event"], ["Person", "Organization"], None, None),
    "AUTHORED_BY": (["Document"], ["Person", "Team", "Organization"], None, None),
    "SENT_TO": (["Document"], ["Person"], None, None),
    "MENTIONS": (["Document", "Meeting"], ["*"], None, None),
    "RELATED_TO": (BUSINESS, BUSINESS, None, None),
    "ASSOCIATED_WITH": (["*"], ["*"], None, None),
    "WORKS_ON": (["Person", "Team"], ["Project", "Initiative"], None, None),
    "OWNS_PROJECT": (["Person", "Team"], ["Project"], None, None),
    "ABOUT": (["Document", "Meeting"], ["Project", "Initiative", "Product", "Organization", "Opportunity"], None, None),
    "CUSTOMER_OF": (["Organization"], ["Organization"], None, "Customer"),
    "VENDOR_OF": (["Organization"], ["Organization"], None, "Vendor"),
    "PART_OF": (["Project", "Team"], ["Initiative", "Organization"], None, None),
    "BETWEEN": (["Contract"], ["Organization"], None, None),
    "ASSIGNED_TO": (["ActionItem"], ["Person"], None, None),
    "ORIGINATED_IN": (["ActionItem"], ["Meeting", "Document"], 1, None),
    "USES_PRODUCT": (["Organization", "Team", "Project"], ["Product"], None, None),
}
#: Fixed values. Type, and role if the words say one: the words.
TYPE_ALIASES = {
    ("Person", None): ["person", "people", "employee", "contact", "individual"],
    ("Organization", None): ["company", "organization", "organisation", "firm", "business"],
    ("Organization", "Customer"): ["customer", "customer company", "client"],
    ("Organization", "Vendor"): ["vendor", "supplier"],
    ("Document", None): ["document", "email", "file", "memo", "report"],
    ("Project", None): ["project"],
    ("Event", None): ["event"],
    ("Location", None): ["location", "office"],
    ("Team", None): ["team", "department"],
    ("Meeting", None): ["meeting", "call"],
    ("Product", None): ["product", "offering"],
    ("Contract", None): ["contract", "agreement"],
    ("Initiative", None): ["initiative", "program"],
    ("Opportunity", None): ["opportunity", "deal"],
    ("ActionItem", None): ["action item", "task", "to do", "follow up"],
}
#: Fixed values. Relation: the words for it.
RELATION_ALIASES = {
    "WORKS_AT": ["works at", "works for", "employed by", "employee of"],
    "MEMBER_OF": ["member of", "on the team", "belongs to"],
    "MANAGES": ["manages", "manager of", "supervises"],
    "REPORTS_TO": ["reports to"],
    "ATTENDED": ["attended", "joined", "was present at"],
    "HAS_PARTICIPANT": ["has participant", "invited", "invitee"],
    "ORGANIZED_BY": ["organized by", "hosted by", "scheduled by"],
    "AUTHORED_BY": ["authored by", "written by", "sent by", "created by"],
    "MENTIONS": ["mentions", "refers to"],
    "WORKS_ON": ["works on", "working on", "contributes to"],
    "OWNS_PROJECT": ["owns", "owner of", "leads", "accountable for", "responsible for", "project owner"],
    "ABOUT": ["about", "regarding", "concerns"],
    "CUSTOMER_OF": ["customer of", "client of", "buys from"],
    "VENDOR_OF": ["vendor of", "supplier to", "supplies"],
    "PART_OF": ["part of", "belongs to initiative"],
    "BETWEEN": ["between", "signed by", "party to"],
    "USES_PRODUCT": ["uses", "uses product", "is using"],
    "SENT_TO": ["sent to", "addressed to", "recipient", "cc"],
    "ASSIGNED_TO": ["assigned to", "assignee", "owned by person"],
    "ORIGINATED_IN": ["raised in", "came from", "from meeting"],
}
#: Fixed values. Suggested relation: (source types, target types, canonical relation).
CONTEXT_MAPPINGS = {
    "OWNS": (["Person", "Team"], ["Project"], "OWNS_PROJECT"),
    "LEADS": (["Person", "Team"], ["Project"], "OWNS_PROJECT"),
    "EMPLOYED_BY": (["Person"], ["Organization"], "WORKS_AT"),
    "PARTICIPATED_IN": (["Person"], ["Meeting"], "ATTENDED"),
    "SPOKE_IN": (["Person"], ["Meeting"], "ATTENDED"),
    "INVITED_TO": (["Meeting"], ["Person"], "HAS_PARTICIPANT"),
}
#: Fixed values. Provenance class: (rank, evidence that it needs, least confidence for acceptance).
PROVENANCE = {
    "HUMAN_CONFIRMED": (4, ["reviewer"], 0.0),
    "STRUCTURED_SOURCE": (3, ["document_id", "source_field"], 0.6),
    "EXPLICIT_TEXT": (2, ["document_id", "evidence_text"], 0.85),
    "INFERRED_TEXT": (1, ["document_id", "evidence_text"], 1.01),
}
#: Fixed values. Where a fact comes from: its confidence.
TRUST = {
    "email.from": 1.0,
    "email.recipients": 1.0,
    "meeting.transcript_speaker": 0.99,
    "meeting.recorded_by": 0.95,
    "meeting.calendar_invitee": 0.95,
    "meeting.action_item": 0.95,
    "document.author": 0.95,
    "fathom.team": 0.9,
    "email_domain_employment": 0.7,
}
#: Domains, address parts and words by which addresses and sentences are told apart.
EXCLUDED_DOMAINS = [
    "gmail.com", "googlemail.com", "yahoo.com", "outlook.com", "hotmail.com", "live.com", "msn.com", "icloud.com", "me.com", "aol.com", "proton.me",
    "protonmail.com", "gmx.com", "rr.com", "comcast.net", "att.net", "sbcglobal.net", "verizon.net", "cox.net", "bellsouth.net", "earthlink.net",
    "juno.com", "netzero.net", "prodigy.net", "mindspring.com", "excite.com", "charter.net", "optonline.net", "mac.com",
]
BULK_LOCAL_PARTS = [
    "noreply", "no-reply", "no_reply", "donotreply", "do-not-reply", "do_not_reply", "newsletter", "newsletters", "news", "info", "alerts", "alert",
    "notifications", "notification", "notify", "mailer-daemon", "postmaster", "bounce", "bounces", "listserv", "majordomo", "mailman", "owner",
    "marketing", "promotions", "updates", "digest", "announce", "announcements", "webmaster", "subscriptions", "unsubscribe",
]
BULK_PREFIXES = [
    "owner-", "bounce-", "bounces-", "return-",
]
BULK_SUFFIXES = [
    "-request", "-bounces", "-owner", "-admin",
]
BULK_LABELS = [
    "lists", "list", "listserv", "mailman", "majordomo", "email", "e", "em", "news", "newsletter", "newsletters", "info", "bounce", "bounces", "mkt",
    "marketing", "reply", "updates", "alerts", "notifications", "mailer",
]
MULTI_PART_SUFFIXES = [
    "co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "co.in", "com.br", "com.mx", "com.cn", "com.sg", "co.za",
    "com.ar", "co.kr", "com.tr",
]
#: Fixed values. Provider domain: (domain that it is the same as, dots ignored, +tag ignored).
PROVIDERS = {"gmail.com": ("gmail.com", True, True), "googlemail.com": ("gmail.com", True, True)}
ROLE_LOCAL_PARTS = [
    "receptionist", "reception", "frontdesk", "front-desk", "office", "info", "hello", "contact", "contactus", "support", "help", "helpdesk", "sales",
    "billing", "accounts", "accounting", "admin", "hr", "careers", "jobs", "recruiting", "talent", "interviews", "onboarding", "team", "staff",
    "service", "services", "customerservice", "orders", "bookings", "reservations", "events",
]
ABBREVIATIONS = [
    "u.s", "e.g", "i.e", "etc", "vs", "dr", "mr", "mrs", "ms", "inc", "ltd", "co", "corp", "no", "fig", "approx", "jr", "sr", "st", "dept", "est",
]
