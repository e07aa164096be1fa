"""Text normalisation, classification and parsing as column functions.

Lists and patterns in capitals are fixed values: they decide results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lifecycle of an item, by the first family with a pattern that its text has.
INFORMATIONAL = (
    r"received\s+(?:and\s+)?(?:filed|placed\s+on\s+file)",
    r"information\s+(?:only|item|report)",
    r"presentation\s+only",
    r"not\s+for\s+(?:committee|board)\s+discussion",
    r"no\s+action\s+(?:taken|required|necessary)",
    r"received\s+as\s+information",
)
STATUSES = (
    ("pulled", (
        r"pull(?:ed|ing|s)?\s+(?:item|from|the\s+agenda)",
        r"(?:item|request|was|has\s+been)\s+(?:has\s+been\s+)?pull(?:ed|ing|s)\b",
        r"removed\s+(?:from|by)\s+(?:the\s+)?(?:agenda|consent)",
    )),
    ("tabled", (r"\btabl(?:e|ed|ing)\b", r"laid\s+(?:over|on\s+the\s+table)")),
    ("continued", (
        r"continu(?:e|ed|ation|ing)\s+(?:to|until|the\s+item|consideration)",
        r"continued\s+(?:from|public\s+hearing)",
        r"(?:item|hearing|meeting)\s+(?:was\s+)?continued\s+(?:to|until)",
        r"continue\s+the\s+(?:item|hearing|matter|public\s+hearing)",
    )),
    ("held", (
        r"\b(?:held|hold)\s+(?:over|in\s+abeyance|for\s+?(?:further|additional))",
        r"(?:held|hold)\s+(?:(?:item|case|matter|request|application)\s+)?(?:\S+\s+)?in\s+abeyance",
        r"(?:item|matter|consideration|request|application)\s+(?:was\s+)?(?:held|hold)\s+(?:over|in)",
        r"\bheld\b(?!\s+(?:in|by|at|on\s+(?:behalf|file|hold)|open|accountable))",
    )),
    ("withdrawn", (r"withdraw(?:n|al)?\s+(?:by|from|the\s+(?:item|request))", r"(?:item|request|application)\s+(?:was\s+)?withdraw(?:n|al)")),
    ("approved_as_amended", (
        r"approved\s+(?:as\s+)?(?:amended|modified|revised)",
        r"approve\s+(?:as\s+)?(?:amended|modified)",
        r"adopt(?:ed)?\s+(?:as\s+)?(?:amended|modified|revised)",
    )),
    ("denied", (
        r"\b(?:denied?|denial)\b(?!\s+(?:the\s+opportunity|access|entry))",
        r"\bdenial\s+of\b",
        r"motion\s+(?:to\s+)?(?:deny|denied)\b",
        r"recommend(?:ation)?\s+(?:of\s+)?denial",
    )),
    ("approved", (
        r"\b(?:approve(?:d|s)?|approval)\b(?!\s+(?:as\s+amended|as\s+modified))",
        r"adopt(?:ed)?\b",
        r"motion\s+(?:to\s+)?(?:approve|adopt|carry)",
        r"\bcarried\b",
        r"recommend(?:ation)?\s+(?:of\s+)?(?:\w+\s+)?approval",
    )),
)
#: Families of errors, the first with a pattern that the message has.
TRANSIENT = (
    r"5\d{2}", r"timeout", r"timed ?out", r"connection refused", r"connection reset", r"connectionerror", r"dns lookup", r"network is unreachable",
    r"econnrefused", r"econnreset", r"read timed out", r"operation timed out", r"ssl", r"certificate verify", r"ratelimit", r"rate.limit", r"429",
    r"received http 0", r"temporary failure", r"temporarily unavailable", r"server error", r"internal server error", r"gateway", r"bad gateway",
    r"service unavailable", r"service temporarily", r"too many requests", r"net::err_", r"websocket", r"playwright.*timeout",
)
CODE = (
    r"typeerror", r"attributeerror", r"importerror", r"modulenotfounderror", r"keyerror", r"indexerror", r"valueerror", r"zerodivisionerror",
    r"assertionerror", r"notimplementederror", r"syntaxerror", r"nameerror", r"recursionerror", r"runtimeerror", r"operator does not exist",
    r"type mismatch", r"cannot import", r"no module named", r"object.*has no attribute", r"unsupported operand", r"invalid literal for int",
    r"not subscriptable", r"not iterable", r"list index out of range", r"not enough values to unpack", r"undefinedfunction", r"undefinedcolumn",
    r"psycopg2", r"database error", r"dialect.*not supported", r"sql type.*not recognized",
)
DATA = (
    r"body not found", r"unknown body", r"jurisdiction.*not found", r"unknown jurisdiction", r"cannot determine body", r"no.*body.*field",
    r"not found in database", r"meeting .* not found", r"foreign key.*violation", r"duplicate key.*violation", r"unique constraint",
    r"null value.*violation", r"not-null constraint", r"invalid input value", r"relation .* not exist", r"column .* not exist",
    r"scalar.*returned more than one", r"integrity.*constraint", r"body.*empty", r"meeting.*empty", r"cannot.*resolve", r"unable to determine",
    r"missing.*flag", r"no.*source.*flag", r"could not determine", r"could not resolve",
)
#: Titles before names, and roles after a comma.
TITLES = (
    "chairperson", "chairman", "chairwoman", "vice chair", "vice-chair", "vice chairperson", "vice-chairperson", "councilmember", "council man", "council woman",
    "commissioner", "mayor", "vice mayor", "vice-mayor", "dr", "dr.", "honorable", "hon.", "the honorable", "mr", "mr.", "mrs", "mrs.", "ms", "ms.", "mx", "mx.",
    "attorney", "esq", "esq.",
)
ROLES = (
    "chair", "vice chair", "vice-chair", "councilmember", "commissioner", "attorney", "atty", "esq", "planner", "agent", "representative", "rep", "manager", "director",
    "president", "vice president", "ceo", "cfo", "member", "chairman", "chairwoman", "chairperson", "interim director", "assistant director", "senior planner",
    "associate planner", "principal planner",
)
#: Suffixes of companies.
COMPANY = r"P\.?L\.?C\.?|P\.?L\.?L\.?C\.?|P\.?C\.?|P\.?A\.?|L\.?L\.?C\.?|I\.?N\.?C\.?|L\.?T\.?D\.?|C\.?O\.?R\.?P\.?|L\.?L\.?P\.?|C\.?O\.?"
#: Words that tell a firm, and words that tell an organisation.
FIRM = (
    "law", "firm", "corporation", "company", "group", "engineering", "consulting", "architecture", "planning", "development", "properties", "management", "services", "design",
    "solutions", "llc", "inc", "plc", "ltd", "corp", "llp", "pllc", "pa ", "pc ", "pa.", "pc.", "homes", "construction", "partnership", "association", "incorporated", "power",
    "energy", "transmission", "architecture studios", "landscape architecture", "landscaping architecture",
)
ORGANISATION = (
    "llc", "inc", "plc", "ltd", "corp", "corporation", "company", "group", "firm", "partnership", "consulting", "planning", "engineering", "law ", "office", "pa ", "pc ", "llp",
    "association", "incorporated", "development", "properties", "management", "services", "architecture", "construction", "design", "homes", "church", "assembly of god",
    "university", "hospital", "district", "department", "commission", "committee", "board of", "city of", "town of", "county of", "architect", "attorney", "engineer", "solutions",
)
#: Beginnings of what isn't a name, and words that excuse them.
FILLERS = ("the ", "and ", "to ", "for ", "of ", "a ", "an ", "in ", "on ", "is ", "it ", "be ")
EXCUSED = ("church", "city of", "town of", "county of", "state of")
#: Kinds of meetings, the first that type or title has.
MEETING_KINDS = ("executive", "informal", "formal", "special")
#: First word of a motion's result.
MOTIONS = {
    "approve": "approved", "appoint": "approved", "concur": "approved", "deny": "denied", "denied": "denied", "continue": "continued", "continued": "continued",
    "withdraw": "withdrawn", "accept": "accepted", "reject": "rejected",
}
#: Subjects of closed sessions, and themes of those flagged, the first that matches.
SUBJECTS = (
    ("litigation", r"\bV\s*\.|\bVS\s*\.|LITIGATION|LAWSUIT|APPEAL|SETTLEMENT|INJUNCTION|PETITION|CLAIM(S)?\b|SUBPOENA|DEPOSITION|DISCOVERY|ARBITRATION|JUDGMENT|LIEN|TAKINGS|CONDEMNATION|EMINENT DOMAIN|DISTRICT COURT|SUPERIOR COURT|COURT OF APPEALS|NO\.\s*\d{2}-"),
    ("personnel", r"SALARY|PERSONNEL|EMPLOYMENT|HIRING|DISMISSAL|DISCIPLINE|PERFORMANCE EVALUATION|APPOINTMENT|PROMOTION|DEMOTION|RESIGNATION|EMPLOYEE|COMPENSATION|CHIEF DEPUTY|RECRUITMENT"),
    ("land", r"REAL PROPERTY|PURCHASE.*(PROPERTY|LAND)|SALE.*(PROPERTY|LAND)|LEASE|ACQUISITION|EASEMENT|APN\b|DEED|RIGHTS?[- ]OF[- ]WAY|PROPERTY.*(ACQUISITION|SALE|PURCHASE)"),
    ("procurement", r"PROCUREMENT|CONTRACT|RFP\b|RFQ\b|BID\b|COMPETITION IMPRACTICABLE|SOLE SOURCE|VENDOR|AGREEMENT"),
    ("policy_admin", r"POLICY|TAX\b|TAXES|LEVY|BUDGET|EXPENDITURE|AUTHORITY AND RESPONSIBIL|RESPONSIBILITIES|REPORT\b|UPDATE|TECHNOLOGY|RICO|FLOODPLAIN|FLOOD CONTROL|ZONING|ORDINANCE|REGULATION|RATES?|FEES?|PROGRAM|GRANT|STUDY\b|STRATEGY|PLAN\b|PLANNING|HEALTH\b|AIR QUALITY|PM 2\.5|PM10|WATER"),
)
THEMES = (
    ("property_tax_levy", r"PROPERTY TAX|TAX LEVY|TAX RATES|CASH DEFICIT"),
    ("budget_finance", r"BUDGET|EXPENDITURE LIMIT|OFFICE OF BUDGET|FINANCE"),
    ("rico", r"RICO"),
    ("constable_sheriff_equipment", r"CONSTABLE|SHERIFF|VEHICLE|EQUIPMENT|UPGRADE"),
    ("technology_it", r"TECHNOLOGY|IT UPDATE|CYBER|SOFTWARE|SYSTEMS? UPDATE"),
    ("procurement_contracts", r"PROCUREMENT|COMPETITION IMPRACTICABLE|CONTRACT|SOLE SOURCE|RFP"),
    ("board_authority_general", r"BOARD AUTHORITY|RESPONSIBILIT"),
    ("public_health_air", r"PUBLIC HEALTH|AIR QUALITY|PM 2\.5|PM10|EMISSION"),
    ("flood_zoning_landuse", r"FLOOD|ZONING|FLOODPLAIN|LAND USE|CODE ENFORCEMENT"),
    ("compensation_benefits", r"COMPENSATION|DEFERRED COMP|PENSION|RETIREMENT|BENEFIT"),
    ("debt_securities", r"BOND|DEBT|SECURITIES|UNDERWRIT"),
    ("misc", r""),
)
#: Points of a story by topic, words that add points when frequent, and body that adds points.
TOPIC_POINTS = {"bonds-finance": 40, "policy-planning": 35, "infrastructure": 25, "homelessness": 30, "development-pipeline": 15, "annexation": 20, "enforcement-signals": 10}
FREQUENT, BODY_POINTS = ("homeless", "shelter", "amendment", "iga with"), {"bos": 10}


def _any(patterns) -> str:
    return "(?i)" + "|".join(f"(?:{p})" for p in patterns)


def first_match(text: Column, rules, otherwise: str) -> Column:
    """Name of the first rule one of whose patterns occurs in the text, whatever the case."""
    given = F.coalesce(text, F.lit(""))
    return F.coalesce(*(F.when(given.rlike(_any(patterns)), F.lit(name)) for name, patterns in rules), F.lit(otherwise))


def lifecycle(text: Column) -> Column:
    return first_match(text, (("informational", INFORMATIONAL), *STATUSES), "unknown")


def lifecycle_with_context(text: Column, action: Column) -> Column:
    """What the recorded action says, or else the text."""
    stated = first_match(action, STATUSES, "")
    return F.when(stated != "", stated).otherwise(lifecycle(text))


def error_category(text: Column) -> Column:
    return first_match(text, (("TRANSIENT", TRANSIENT), ("CODE", CODE), ("DATA", DATA)), "UNKNOWN")


def tagged_error(text: Column) -> Column:
    """The tag in brackets that a message begins with, or an empty string."""
    return F.regexp_extract(text, r"^\[(\w+)\]", 1)


def meeting_kind(kind: Column, title: Column | None = None) -> Column:
    """Executive, Informal, Formal or Special by type and title, or else the type itself, or Unknown."""
    raw = F.trim(F.coalesce(kind, F.lit("")))
    low = F.lower(F.concat_ws(" ", kind, F.lit("") if title is None else title))
    return F.coalesce(*(F.when(F.contains(low, F.lit(k)), F.lit(k.capitalize())) for k in MEETING_KINDS), F.when(raw != "", raw), F.lit("Unknown"))


def cancelled(title: Column) -> Column:
    return F.coalesce(title, F.lit("")).rlike(r"(?i)\bCANCEL(?:LED|ED)?\b")


def motion_result(text: Column) -> Column:
    """Outcome by the first word; nothing at all was approved, an unknown word stays as it is."""
    raw = F.regexp_replace(text, r"^\s+|\s+$", "")
    word = F.lower(F.regexp_extract(raw, r"^(\S*)", 1))
    known = F.create_map(*(F.lit(x) for kv in MOTIONS.items() for x in kv))
    return F.when(F.coalesce(text, F.lit("")) == "", "approved").otherwise(F.coalesce(F.try_element_at(known, word), raw))


def _literal(words) -> str:
    return "|".join(w.replace(".", r"\.") for w in words)


def _plain(name: Column, dropped: str) -> Column:
    """Lower case, without what ``dropped`` matches and a leading article, single spaces."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), dropped, ""), r"\s+", " "))
    return F.regexp_replace(bare, r"^the\s+", "")


def person_name(name: Column) -> Column:
    """Without the title before and the role after a comma, without marks other than apostrophes and hyphens."""
    untitled = F.regexp_replace(F.trim(name), rf"(?i)^(?:{_literal(TITLES)})(?: +|$)", "")
    return _plain(F.regexp_replace(untitled, rf"(?i),\s*(?:{_literal(ROLES)})\s*$", ""), r"(?U)[^\w\s'\-]")


def org_name(name: Column) -> Column:
    """Without a company suffix, marks and hyphens; & is and."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(name), r"\s+", " "), rf"(?i)\s+(?:{COMPANY})\.?\s*$", "")
    return _plain(F.regexp_replace(bare, "&", " and "), r"(?U)[^\w\s']")


def is_firm(name: Column) -> Column:
    low = F.lower(F.trim(name))
    return low.rlike("&| and |" + _literal(FIRM))


def entity_type(name: Column) -> Column:
    """person, or organization: by a word that tells it, a comma, or a single word."""
    other = F.lower(F.trim(name)).rlike(_literal(ORGANISATION)) | F.contains(name, F.lit(",")) | (F.size(F.split(F.trim(name), r"\s+")) <= 1)
    return F.when(other, "organization").otherwise("person")


def valid_name(name: Column, longest: int = 100) -> Column:
    """Whether a match may be a name: neither too long nor too short, and it doesn't begin like running text."""
    low = F.lower(name)
    return F.length(name).between(2, longest) & (~low.rlike("^(?:" + "|".join(FILLERS) + ")") | low.rlike("|".join(EXCUSED)))


def plausible_person(name: Column, known: Column) -> Column:
    """Whether a name looks like a person's: a word of it is among ``known`` names (an array), it is short, and no heading.

    The names are data: pass them as an array column, such as a broadcast one-row aggregate.
    """
    given = F.trim(name)
    words = F.split(given, r"\s+")
    heading = (F.upper(given) == given) & (F.length(given) > 4)
    small = (F.size(words) >= 2) & F.forall(words, lambda w: F.left(w, F.lit(1)).rlike(r"(?U)^\p{Ll}"))
    return F.coalesce(
        F.arrays_overlap(F.transform(words, F.lower), known) & ~heading & ~small & (F.size(words) <= 3) & F.length(given).between(2, 35) & ~given.rlike("[0-9]"), F.lit(False)
    )


def c_number(text: Column) -> Column:
    """The first contract number of a text, or an empty string."""
    return F.coalesce(F.regexp_extract(text, r"\(?(C-\d{2}-\d{2}-\d{3}(?:-[A-Z0-9]{1,3}){1,3})\)?", 1), F.lit(""))


def case_revision(number: Column) -> Column:
    """The last part of a number, if it has at most four characters; else an empty string."""
    return F.regexp_extract(number, r"-([^-]{0,4})$", 1)


def case_base(number: Column) -> Column:
    """A number without its revision."""
    return F.regexp_replace(number, r"-[^-]{0,4}$", "")


def statutes(text: Column) -> Column:
    """Distinct paragraphs of the closed-session statute that a text cites, sorted as text."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?i)38-431\.03\(A\)\((\d+)\)"), F.lit(1))))


def subjects(text: Column) -> Column:
    """Labels of a closed session's subject, in their order."""
    return F.array_compact(F.array(*(F.when(text.rlike("(?i)" + pattern), F.lit(name)) for name, pattern in SUBJECTS)))


def flagged_session(text: Column) -> Column:
    """Cites paragraph 3 but not 1, 4 or 5, isn't about litigation, but about policy or procurement."""
    cited, about = statutes(text), subjects(text)
    other = F.arrays_overlap(cited, F.array(*map(F.lit, "145")))
    return F.array_contains(cited, "3") & ~other & ~F.array_contains(about, "litigation") & F.arrays_overlap(about, F.array(F.lit("policy_admin"), F.lit("procurement")))


def session_theme(text: Column) -> Column:
    return F.coalesce(*(F.when(text.rlike("(?i)" + pattern), F.lit(name)) for name, pattern in THEMES))


def impact_score(title: Column, text: Column, topic: Column, body: Column) -> Column:
    """Points of a story: amounts of money, topic, body, frequent words, and the details of land use."""
    given = F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(text, F.lit("")))
    low = F.lower(given)
    every = lambda pattern, group=0: F.regexp_extract_all(low, F.lit(pattern), F.lit(group))
    total = lambda points: F.aggregate(points, F.lit(0), lambda a, x: a + x)

    def tiers(amount: Column) -> Column:
        n = F.regexp_replace(amount, r"[$,]", "").try_cast("decimal(38,0)")
        return F.when(n >= 10_000_000, 50).when(n >= 1_000_000, 20).when(n >= 100_000, 10).when(n >= 10_000, 5).otherwise(0)

    land = r"(\d+)\s*(spaces?|parking|units?|lots?|acres?|sf|sq\s*ft|stories?)"

    def detail(n: Column, unit: Column) -> Column:
        n = n.try_cast("decimal(38,0)")
        return F.when(unit.rlike("^(?:unit|lot|space)") & (n >= 5), 8).when(unit.startswith("parking") & (n >= 20), 10).when(unit.startswith("acre") & (n >= 2), 12).when(unit.startswith("stor") & (n >= 3), 8).otherwise(0)

    frequent = reduce(lambda a, b: a | b, (F.regexp_count(low, F.lit(word)) > 3 for word in FREQUENT))
    topics = F.create_map(*(F.lit(x) for kv in TOPIC_POINTS.items() for x in kv))
    bodies = F.create_map(*(F.lit(x) for kv in BODY_POINTS.items() for x in kv))
    address = F.coalesce(text, F.lit("")).rlike(r"\d+\s+[A-Z][a-z]*(?:\s+[A-Z][a-z]*)*\s+(?:Street|Avenue|Drive|Lane|Road|Way|Boulevard|Circle|Court)\b")
    area = (F.regexp_count(low, F.lit(" and ")) >= 3) & low.rlike("street|avenue|road|between|north of|south of")
    return (
        total(F.transform(every(r"\$[\d,]+"), tiers))
        + F.coalesce(F.try_element_at(topics, topic), F.lit(0))
        + F.coalesce(F.try_element_at(bodies, body), F.lit(0))
        + F.when(frequent, 15).otherwise(0)
        + total(F.zip_with(every(land, 1), every(land, 2), detail))
        + 5 * F.size(every("city center|downtown|historic|overlay|specific plan"))
        + F.when(address, 8).otherwise(0)
        + F.when(area, 10).otherwise(0)
    ).cast("long")


def joined_lines(text: Column) -> Column:
    """Words broken at line ends put together, and runs of empty lines made one."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)(\w)-\n(\w)", "$1$2"), r"\n{3,}", "\n\n")


def canonical_body(code: Column, aliases: dict[str, str]) -> Column:
    """The code that a body is known by, whatever the case; an unknown one stays as it is."""
    known = F.create_map(*(F.lit(x) for kv in aliases.items() for x in kv))
    return F.coalesce(F.try_element_at(known, F.lower(code)), code)


def jurisdiction_of(code: Column, prefixes: dict[str, str], otherwise: str = "") -> Column:
    """The jurisdiction of the first prefix that a body's code begins with."""
    return F.coalesce(*(F.when(code.startswith(p), F.lit(name)) for p, name in prefixes.items()), F.lit(otherwise))


def slug(text: Column) -> Column:
    """Letters and digits with hyphens between, in lower case; `meeting` if there are none."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), "[\u0300-\u036f]", "")
    made = F.lower(F.regexp_replace(F.regexp_replace(bare, r"[^a-zA-Z0-9]+", "-"), r"^-+|-+$", ""))
    return F.when(made == "", "meeting").otherwise(made)


def item_number(number: Column) -> Column:
    """A number, or a number and a leaf in upper case, without leading zeros and closing marks; null for anything else."""
    raw = F.trim(F.regexp_replace(F.trim(number), r"[.)]+$", ""))
    shape = r"^(\d{1,3})(?:\.([A-Za-z0-9]{1,3}))?$"
    base, leaf = F.regexp_extract(raw, shape, 1).try_cast("int").cast("string"), F.upper(F.regexp_extract(raw, shape, 2))
    return F.when(raw.rlike(shape) & (raw != "0"), F.when(leaf == "", base).otherwise(F.concat_ws(".", base, leaf)))


def item_parent(number: Column) -> Column:
    """The number before the point; null at the top and where there is no such number."""
    return F.nullif(F.regexp_extract(number, r"^(.+)\.[^.]+$", 1), F.lit(""))


def item_depth(number: Column) -> Column:
    return (F.size(F.split(number, r"\.")) - 1).cast("long")


def iso_date(text: Column) -> Column:
    """A date in any of the usual forms as an ISO string; null where none fits."""
    forms = ("yyyy-MM-dd", "M/d/yyyy", "MMMM d, yyyy", "MMM d, yyyy", "MMMM d yyyy", "MMM d yyyy", "yyyyMMdd")
    return F.date_format(F.coalesce(*(F.try_to_timestamp(F.trim(text), F.lit(f)) for f in forms)), "yyyy-MM-dd")


def tokens(text: Column, least: int = 1) -> Column:
    """Distinct lower-case words of letters and digits, sorted."""
    words = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: F.length(w) >= least)
    return F.array_sort(F.array_distinct(words))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common tokens; 0 if there are none at all."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double")), F.lit(0.0))


def vocabulary_overlap(a: Column, b: Column) -> Column:
    """0.7 of containment and 0.3 of Jaccard, to four places."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    contained = F.coalesce(F.try_divide(both, F.least(F.size(a), F.size(b)).cast("double")), F.lit(0.0))
    return F.round(0.7 * contained + 0.3 * jaccard(a, b), 4)


def normalised_tokens(text: Column) -> Column:
    """Letters and digits in lower case, single spaces between words."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9\s]", " "), r"\s+", " "))


def name_similarity(a: Column, b: Column) -> Column:
    """The best of token Jaccard, equal tokens in another order, containment (0.85) and acronym (0.75), of normalised names."""
    a, b = normalised_tokens(a), normalised_tokens(b)
    x, y = F.array_remove(F.split(a, " "), ""), F.array_remove(F.split(b, " "), "")
    short, long = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    inside = F.when((short >= 3) & (F.contains(a, b) | F.contains(b, a)) & (short > 0.25 * long), 0.85).otherwise(0.0)
    initials = lambda words: F.array_join(F.transform(words, lambda w: F.left(w, F.lit(1))), "")
    p, q = initials(x), initials(y)
    acronym = F.when((F.length(p) >= 2) & (q != "") & ((p == q) | F.contains(b, p) | F.contains(a, q)), 0.75).otherwise(0.0)
    same = F.when((F.array_sort(x) == F.array_sort(y)) & (F.size(x) > 0), 1.0).otherwise(0.0)
    return F.greatest(jaccard(F.array_distinct(x), F.array_distinct(y)), same, inside, acronym)


def highlighted(text: Column, term: str) -> Column:
    """Escaped for HTML, with each occurrence of the term, as it is written, marked."""
    def escaped(c: Column) -> Column:
        for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")):
            c = F.replace(c, F.lit(sign), F.lit(entity))
        return c

    safe, mark = escaped(F.coalesce(text, F.lit(""))), escaped(F.lit(term))
    return F.replace(safe, mark, F.concat(F.lit("<mark>"), mark, F.lit("</mark>"))) if term else safe


def snippet(text: Column, words: int, around: Column) -> Column:
    """``words`` words of a text from shortly before the first one that ``around`` (a pattern in lower case) begins, or from the start."""
    split = F.split(F.trim(text), r"\s+")
    at = F.coalesce(F.array_position(F.transform(split, lambda w: F.regexp_like(F.lower(w), around)), True).cast("int"), F.lit(0))
    return F.concat_ws(" ", F.slice(split, F.greatest(F.lit(1), at - words // 4), words))


def identity_key(kind: str, **parts: Column) -> Column:
    """SHA-256 of kind:sorted(name=value|...), absent values marked."""
    named = [F.concat(F.lit(name + "="), F.coalesce(parts[name].cast("string"), F.lit("∅"))) for name in sorted(parts)]
    return F.sha2(F.concat(F.lit(kind + ":"), F.concat_ws("|", *named)).cast("binary"), 256)


def content_hash(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def vocabulary_of(value: Column, canonical: list[str], compatible: dict[str, str]) -> Column:
    """canonical, compatible or unmapped."""
    return F.when(value.isin(canonical), "canonical").when(value.isin(list(compatible)), "compatible").otherwise("unmapped")
