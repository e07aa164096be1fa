"""Scalar functions on fixed cases, with the values that their rules give, worked out by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import votes as V
from ..operators.events import event_of

joined = lambda c: F.concat_ws(",", c)
_TWO = lambda f, x: f(F.split_part(x, F.lit("|"), F.lit(1)), F.split_part(x, F.lit("|"), F.lit(2)))
_FOUR = lambda f, x: f(*(F.split_part(x, F.lit("|"), F.lit(i)) for i in range(1, 5)))

CASES = {
    "lifecycle": (lambda X: T.lifecycle(X), {
        "Received and filed": "informational", "Presentation only by staff": "informational", "No action taken": "informational", "An information item": "informational",
        "Pulled from the agenda": "pulled", "The item was pulled": "pulled", "Removed from the agenda": "pulled", "Laid over": "tabled", "Tabling the motion": "tabled",
        "Continued to March 4": "continued", "Continue the hearing": "continued", "Held over": "held", "The matter is held": "held", "The meeting was held in chambers": "unknown",
        "Held by consent": "unknown", "Withdrawn by the applicant": "withdrawn", "The application was withdrawn": "withdrawn", "Approved as amended": "approved_as_amended",
        "Adopted as revised": "approved_as_amended", "Motion to deny": "denied", "Denied access to the site": "unknown", "Staff recommend denial": "denied", "Motion carried": "approved",
        "Adopted": "approved", "Recommendation of approval": "approved", "Approval of the minutes": "approved", "Discussion": "unknown", "": "unknown", None: "unknown",
    }),
    "lifecycle_in_context": (lambda X: _TWO(T.lifecycle_with_context, X), {"Approval of a lease|Denied 5-0": "denied", "Approval of a lease|": "approved", "Received and filed|aye": "informational", "Talk|Tabled": "tabled"}),
    "error": (lambda X: T.error_category(X), {
        "HTTP 503": "TRANSIENT", "Rate limit hit": "TRANSIENT", "SSL handshake failed": "TRANSIENT", "status 429": "TRANSIENT", "TypeError after timeout": "TRANSIENT", "Bad Gateway": "TRANSIENT",
        "invalid literal for int() with base 10: 'x'": "CODE", "psycopg2 failure": "CODE", "KeyError: 'a'": "CODE", "'A' object has no attribute 'b'": "CODE", "no module named x": "CODE",
        "duplicate key value: violation": "DATA", "body not found": "DATA", "not-null constraint": "DATA", "relation x does not exist": "DATA", "could not determine it": "DATA", "odd": "UNKNOWN", "": "UNKNOWN", None: "UNKNOWN",
    }),
    "tag": (lambda X: T.tagged_error(X), {"[CODE] KeyError": "CODE", "CODE KeyError": "", "[] x": ""}),
    "motion": (lambda X: T.motion_result(X), {
        None: "approved", "": "approved", "   ": "", "Approve item 4": "approved", "Appoint X": "approved", "concur": "approved", "Passed 5-2": "Passed 5-2", "carried": "carried", "Deny": "denied",
        "Withdraw": "withdrawn", "Accept the report": "accepted", "Reject bids": "rejected", "Approved": "Approved", " Tabled ": "Tabled", "Continued to May": "continued",
    }),
    "vote": (lambda X: V.normalize_vote(X), {"Aye": "yes", " YES ": "yes", "no": "no", "Nay": "no", "Abstained": "abstain", "absent": "absent", "Recused": "recused", "present": "present"}),
    "meeting_kind": (lambda X: _TWO(T.meeting_kind, X), {"Special Executive|": "Executive", "|Informal study": "Informal", "Formal Meeting|": "Formal", "Planning & Zoning|Agenda": "Planning & Zoning", "|": "Unknown", " |Agenda": "Unknown"}),
    "cancelled": (lambda X: T.cancelled(X).cast("string"), {"CANCELED: Formal": "true", "Cancelled meeting": "true", "Cancel it": "true", "Cancellation": "false", "Formal": "false", None: "false"}),
    "person": (lambda X: T.person_name(X), {
        "Mayor John Giles": "john giles", "Vice Mayor Ann O'Neil": "ann o'neil", "Dr. José Peña": "josé peña", "John Smith, Chair": "john smith", "Smith, John, Esq": "smith john",
        "The Honorable Kate Gallego": "kate gallego", "Acme, Inc": "acme inc", "Jean-Luc  Picard": "jean-luc picard", "the  Board": "board", "Mayor": "", "Mayoral Candidate": "mayoral candidate",
    }),
    "organisation": (lambda X: T.org_name(X), {
        "Tiffany & Bosco, P.A.": "tiffany and bosco", "Z-101-26": "z10126", "The Salt River Project": "salt river project", "Acme L.L.C.": "acme", "Smith Co": "smith", "Vertical Bridge Inc.": "vertical bridge", "O'Hara's": "o'hara's",
    }),
    "firm": (lambda X: T.is_firm(X).cast("string"), {"Tiffany & Bosco": "true", "John Smith": "false", "Lawson Mary": "true", "Acme Homes": "true", "Dee and Doe": "true"}),
    "entity_type": (lambda X: T.entity_type(X), {"Acme LLC": "organization", "Smith, John": "organization", "Cher": "organization", "John Smith": "person", "Board of Health": "organization", "Mary Law": "person"}),
    "valid_name": (lambda X: T.valid_name(X).cast("string"), {"the applicant": "false", "The City of Mesa": "true", "X": "false", "John Smith": "true", "a" * 101: "false", "Of Mice": "false"}),
    "plausible": (lambda X: T.plausible_person(X, F.array(F.lit("mark"), F.lit("duff"))).cast("string"), {
        "Mark Freeman": "true", "Jennifer Duff": "true", "Study Session": "false", "MARK FREEMAN": "false", "mark freeman": "false", "Mark van der Freeman": "false", "Mark 2": "false", "Mark": "true", None: "false",
    }),
    "contract_number": (lambda X: T.c_number(X), {"Item (C-86-25-040-X-00) approved": "C-86-25-040-X-00", "C-06-25-199-02": "C-06-25-199-02", "C-06-25-199": "", "none": "", None: ""}),
    "number_base": (lambda X: T.case_base(X), {"C-86-25-040-X-00": "C-86-25-040-X", "C-06-25-199-02": "C-06-25-199", "ABC": "ABC", "X-12345": "X-12345", "Z-1": "Z"}),
    "number_revision": (lambda X: T.case_revision(X), {"C-86-25-040-X-00": "00", "C-06-25-199-02": "02", "ABC": "", "X-12345": "", "Z-1": "1"}),
    "item_number": (lambda X: T.item_number(X), {"01": "1", "4.aa": "4.AA", "12)": "12", " 7. ": "7", "A1": None, "1.2.3": None, "": None, None: None, "1234": None, "003.b.": "3.B", "0": None}),
    "item_parent": (lambda X: T.item_parent(X), {"4.AA": "4", "4": None, "A": None}),
    "slug": (lambda X: T.slug(X), {"City Council — Study Session!": "city-council-study-session", "": "meeting", "---": "meeting", "Cafe\u0301 Bar": "cafe-bar", None: "meeting", "A--B": "a-b"}),
    "date": (lambda X: T.iso_date(X), {"Apr 23, 2026": "2026-04-23", "April 9, 2026": "2026-04-09", "Apr 23 2026": "2026-04-23", "4/9/2026": "2026-04-09", "2026-04-09": "2026-04-09", "soon": None, None: None}),
    "similarity": (lambda X: F.round(_TWO(T.name_similarity, X), 4).cast("string"), {
        "Vertical Bridge|Annmarie Beckett, Vertical Bridge/Clear Blue Services": "0.85", "JCJ|JCJ Services": "0.5", "Smith, John|John Smith": "1.0", "AB|ABC Corp": "0.0", "Salt River Project|SRP": "0.75", "Oak Trust|Elm Trust": "0.3333",
    }),
    "event": (lambda X: F.concat_ws("/", event_of(X)["kind"], event_of(X)["outcome"]), {
        "Approved  as\namended": "decision.approval/approved_as_amended", "WITHDRAWN": "decision.continuation/withdrawn", "received and filed": "procedure.receipt/received", "sustained": "decision.approval/sustained", "opined": "",
    }),
    "statutes": (lambda X: joined(T.statutes(X)), {"A.R.S. 38-431.03(A)(4) and 38-431.03(a)(3), 38-431.03(A)(4)": "3,4", "none": "", None: ""}),
    "subjects": (lambda X: joined(T.subjects(X)), {"Smith v. County": "litigation", "Employee salary": "personnel", "Sale of the land": "land", "RFP for water": "procurement,policy_admin", "Picnic": ""}),
    "flagged": (lambda X: T.flagged_session(X).cast("string"), {
        "Budget 38-431.03(A)(3)": "true", "Budget 38-431.03(A)(3) 38-431.03(A)(4)": "false", "Budget lawsuit 38-431.03(A)(3)": "false", "Picnic 38-431.03(A)(3)": "false", "Contract 38-431.03(A)(3) and 38-431.03(A)(7)": "true",
    }),
    "theme": (lambda X: T.session_theme(X), {"Tax levy and budget": "property_tax_levy", "Budget": "budget_finance", "New vehicle": "constable_sheriff_equipment", "Pension": "compensation_benefits", "Picnic": "misc"}),
    "impact": (lambda X: _FOUR(T.impact_score, X).cast("string"), {
        "Bond|for $12,000,000 and $50,000|bonds-finance|bos": "105", "Plan|120 units, 3 acres and 4 stories downtown|none|pz": "33", "Lot|at 12 Main Street|annexation|x": "28", "Talk|$ and $999|none|x": "0",
        "Shelter|shelter shelter shelter|homelessness|x": "45", "Area|between A and B and C and D|none|x": "10",
    }),
    "joined_lines": (lambda X: T.joined_lines(X), {"Assess-\nment": "Assessment", "a\n\n\n\nb": "a\n\nb", "a - b": "a - b"}),
    "highlight": (lambda X: T.highlighted(X, "A&B"), {"<A&B> 'x'": "&lt;<mark>A&amp;B</mark>&gt; &#39;x&#39;", "ab": "ab", None: ""}),
    "snippet": (lambda X: T.snippet(X, 4, F.lit("^hit")), {"one two three hit five six seven": "three hit five six", "none of it is here": "none of it is", "hit": "hit"}),
    "body": (lambda X: T.canonical_body(X, {"planning": "pz", "board of health": "health"}), {"Planning": "pz", "Board of Health": "health", "other-1": "other-1"}),
    "jurisdiction": (lambda X: T.jurisdiction_of(X, {"apache-junction": "apache-junction", "mc-": "county"}), {"apache-junction-cc": "apache-junction", "mc-home": "county", "pz": ""}),
}


def _query(name):
    def query(spark, d):
        function, cases = CASES[name]
        rows = spark.createDataFrame([(i, x) for i, x in enumerate(cases)], "n int, x string")
        return rows.select("n", "x", function(F.col("x")).alias("value"))

    query.__doc__ = f"{name} of fixed cases."
    return query


def _quoted(value) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def _sql(name) -> str:
    rows = ", ".join(f"({i}::INT, {_quoted(x)}::VARCHAR, {_quoted(v)}::VARCHAR)" for i, (x, v) in enumerate(CASES[name][1].items()))
    return f"SELECT * FROM (VALUES {rows}) t(n, x, value)"


PLANS = {f"{name}_cases": (_query(name), _sql(name)) for name in CASES}
