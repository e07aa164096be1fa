"""Minutes of meetings read into members, presence and motions, as Arrow batches of whole texts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Headings of lists of members, of those absent, and headings that end a list.
PRESENT = r"(?:board(?: members?)?|commissioners?|commission members?|council ?members?|members?) present|(?:panel )?members? in attendance|council attendance|roll call"
ABSENT = r"(?:board(?: members?)?|commissioners?|commission members?|council ?members?|panel members?|members?) absent|members? not present"
ENDS = r"staff|guests?|others? present|call to order|unscheduled|scheduled|pledge|invocation|consent agenda|\d+\."
#: Offices before or after names.
OFFICES = "Chairperson|Vice Chair|Vice-Chair|Chairman|Chair|Vice Mayor|Mayor|Councilmember|Council Member|Commissioner|Board Member|Panel Member|Member|Secretary|Treasurer|Ex-Officio|Ex Officio|Mr.|Ms.|Mrs.|Dr."

_OFFICE = "(?:" + OFFICES.replace(".", r"\.") + ")"
_HEADING = re.compile(rf"^\s*(?:\d+\.\s*)?(?:(?P<present>{PRESENT})|(?P<absent>{ABSENT})|(?P<end>{ENDS}))\b\s*:?\s*(?P<rest>.*)$", re.I)
_BEFORE, _AFTER = re.compile(rf"^({_OFFICE})\s+", re.I), re.compile(rf"\s*[,—-]+\s*({_OFFICE})\b.*$", re.I)
_NAME = re.compile(r"^[A-Za-z][A-Za-z\s'.\-]+$")
_PERSON = rf"(?:{_OFFICE}\s+)?([A-Z][a-z]+(?:\s+[A-Z][a-zA-Z']+)+)"
_MOTION = re.compile(rf"{_PERSON}\s+(?:made\s+a\s+motion\s+to|moved\s+to)\s+([^.,]*)")
_SECOND = re.compile(rf"seconded\s+by\s+{_PERSON}", re.I)
_COUNT = re.compile(r"(?:passed|approved|carried|adopted)\b[^.]*?(\d+)\s*[-–]\s*(\d+)", re.I)
_ALL = re.compile(r"(?:passed|approved|carried|adopted)\s+unanimously|approved\s+by\s+all\s+(?:panel\s+)?members?\s+present", re.I)
_AGAINST = re.compile(r"\d+\s*[-–]\s*\d+\s*[,;]\s*([^.]*?)\s*(?:dissenting|voting\s+(?:no|against))", re.I)
_LISTED = {"yes": re.compile(r"ayes?:\s*([^:]*?)(?=\s*(?:nays?|noes|absent)\s*:|\.|$)", re.I | re.S), "no": re.compile(r"(?:nays?|noes):\s*([^:]*?)(?=\s*absent\s*:|\.|$)", re.I | re.S)}


def normalised(name: str) -> str:
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s'-]", "", name.lower())).strip()


def _member(entry: str) -> tuple[str, str | None] | None:
    """Name and office of an entry of a list; None if it is no name."""
    entry, office = re.sub(r"\s+", " ", entry).strip(" ,;"), None
    if m := _AFTER.search(entry):
        entry, office = entry[: m.start()], m[1]
    if m := _BEFORE.match(entry):
        entry, office = entry[m.end() :], office or m[1]
    return (entry.strip(), office) if len(entry.strip()) >= 3 and _NAME.match(entry.strip()) else None


def attendance(text: str | None) -> list[tuple[str, str | None, bool]]:
    """(name, office, present) of the members that lists under their headings name, each once."""
    found: dict[str, tuple[str, str | None, bool]] = {}
    state = None
    for line in (text or "").split("\n"):
        heading = _HEADING.match(line)
        if heading:
            state = None if heading["end"] else heading["present"] is not None
            entries = re.split(r",\s*|\s+and\s+", heading["rest"]) if state is not None else []
        elif state is None or not line.strip():
            continue
        else:
            # several names on a line, or one with its office
            entries = [line] if _AFTER.search(line) else re.split(r",\s*|\s+and\s+", line)
        for entry in entries:
            member = _member(entry)
            if member and (" " in member[0] or len(member[0]) >= 6) and not re.search(r"called|moved|seconded|approved|passed|vote", member[0], re.I):
                found.setdefault(normalised(member[0]), (*member, state))
    return list(found.values())


def _named(listed: str, members: list[str]) -> list[str]:
    """The members that a list names, in full or by last name."""
    out = []
    for entry in re.split(r",\s*|\s+and\s+|\s*&\s*|\n", re.sub(rf"\b{_OFFICE}s?(?=\s)", "", listed)):
        wanted = normalised(re.sub(r"^and\s+", "", entry.strip()))
        for name in members:
            if len(wanted) >= 3 and (normalised(name) == wanted or normalised(name).split()[-1] == wanted.split()[-1]):
                out.append(name)
                break
    return out


def motions(text: str | None) -> list[dict]:
    """Motions in their order: mover, seconder, action, result, unanimous, yes and no (names).

    A motion's paragraph runs to the next motion. If its result names nobody,
    but was unanimous, all present voted for it; if it names those against, all
    others present did.
    """
    text = text or ""
    members = attendance(text)
    present = [name for name, _, there in members if there]
    starts = [m for m in _MOTION.finditer(text)]
    out = []
    for i, m in enumerate(starts):
        rest = text[m.end() : starts[i + 1].start() if i + 1 < len(starts) else len(text)]
        second, count, every = _SECOND.search(rest), _COUNT.search(rest), _ALL.search(rest)
        votes = {k: _named(p.search(rest)[1], present) if p.search(rest) else [] for k, p in _LISTED.items()}
        if against := _AGAINST.search(rest):
            votes["no"] = _named(against[1], present)
            votes["yes"] = [n for n in present if n not in votes["no"]]
        if every and not votes["yes"]:
            votes["yes"] = present
        lost = re.search(r"\bfailed\b", rest, re.I) or (count and int(count[1]) <= int(count[2]))
        result = "withdrawn" if re.search(r"\b(?:the|this)\s+item\s+was\s+withdrawn\b", rest, re.I) else "failed" if lost else "approved" if every or count or votes["yes"] else "unknown"
        out.append({"mover": m[1], "seconder": second[1] if second else None, "action": re.sub(r"\s+", " ", m[2]).strip(), "result": result, "unanimous": bool(every), "yes": votes["yes"], "no": votes["no"]})
    return out


def members_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, name, normalized_name, office and present: a row for each member that minutes list. Null texts have none."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [(i, name, normalised(name), office, there) for i, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) for name, office, there in attendance(text)]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["id", "name", "normalized_name", "office", "present"])

    return df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "id long, name string, normalized_name string, office string, present boolean")


def motions_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, motion (from 1), mover, seconder, action, result, unanimous, yes and no (arrays of names): a row for each motion."""
    names = ("mover", "seconder", "action", "result", "unanimous", "yes", "no")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [(i, n, *(m[k] for k in names)) for i, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) for n, m in enumerate(motions(text), 1)]
            columns = list(zip(*rows, strict=True)) or [[]] * 9
            types = (pa.int64(), pa.int32(), *[pa.string()] * 4, pa.bool_(), *[pa.list_(pa.string())] * 2)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["id", "motion", *names])

    return df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "id long, motion int, mover string, seconder string, action string, result string, unanimous boolean, yes array<string>, no array<string>")
