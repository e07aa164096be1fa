"""Event extraction from text, and its place in the items of a document."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Verbs with their event type and outcome.
VERBS = {
    "approved": ("decision.approval", "approved"),
    "approved_with_conditions": ("decision.approval", "approved_with_conditions"),
    "approved_with_stipulations": ("decision.approval", "approved_with_stipulations"),
    "approved_subject_to": ("decision.approval", "approved_subject_to"),
    "approved_subject_to_conditions": ("decision.approval", "approved_subject_to"),
    "approved_subject_to_stipulations": ("decision.approval", "approved_subject_to"),
    "approved_as_amended": ("decision.approval", "approved_as_amended"),
    "denied": ("decision.denial", "denied"),
    "denied_without_prejudice": ("decision.denial", "denied_without_prejudice"),
    "continued": ("decision.continuation", "continued"),
    "tabled": ("decision.continuation", "tabled"),
    "deferred": ("decision.continuation", "deferred"),
    "extended": ("decision.continuation", "extended"),
    "adopted": ("legislation.adoption", "adopted"),
    "introduced": ("legislation.introduction", "introduced"),
    "amended": ("legislation.amendment", "amended"),
    "received": ("procedure.receipt", "received"),
    "received_and_filed": ("procedure.receipt", "received"),
    "discussed": ("procedure.discussion", "discussed"),
    "discussion_only": ("procedure.discussion", "discussed"),
    "for_discussion": ("procedure.discussion", "discussed"),
    "preliminary_review": ("procedure.discussion", "reviewed"),
    "withdrawn": ("decision.continuation", "withdrawn"),
    "sustained": ("decision.approval", "sustained"),
    "vacated": ("decision.approval", "vacated"),
    "called_to_order": ("procedure.discussion", "called_to_order"),
    "no_action": ("procedure.discussion", "no_action"),
    "no_response": ("procedure.discussion", "no_response"),
    "discussion": ("procedure.discussion", "discussed"),
}
#: Outcomes of procedure, which may be left out downstream.
PROCEDURAL = ("called_to_order", "no_action", "no_response")
#: Words shortly before a verb that make it no event.
GUARDS = r"\b(?:not|never|would|could|should|may|might|previously|if|unless)\b[^.]{0,24}$"
_PATTERN = re.compile(r"\b(" + "|".join(v.replace("_", r"\s+") for v in sorted(VERBS, key=len, reverse=True)) + r")\b", re.I)
_GUARD = re.compile(GUARDS, re.I)
_CASE = re.compile(r"\b[A-Z]{1,3}-\d{2,6}(?:-\d{1,6})*\b")


def verb_key(verb: Column) -> Column:
    """A verb as it is looked up: one underscore for all white space, lower case."""
    return F.replace(F.lower(F.trim(F.regexp_replace(verb, r"\s+", " "))), F.lit(" "), F.lit("_"))


def event_of(verb: Column) -> Column:
    """kind and outcome of a verb; null if it isn't known."""
    known = F.create_map(*(x for v, (kind, outcome) in VERBS.items() for x in (F.lit(v), F.struct(F.lit(kind).alias("kind"), F.lit(outcome).alias("outcome")))))
    return F.try_element_at(known, verb_key(verb))


EVENT_SCHEMA = "id long, start int, end int, verb string, kind string, outcome string, case_number string, confidence float"


def extract_events(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row an event: offsets are code points, end exclusive; guarded verbs are left out.

    Runs as batches in Python, since offsets by the JVM's patterns would be
    UTF-16 units. Null texts have no events.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for m in _PATTERN.finditer(text or ""):
                    if _GUARD.search(text[max(0, m.start() - 40) : m.start()]):
                        continue
                    kind, outcome = VERBS[re.sub(r"\s+", "_", m[1].lower())]
                    near = _CASE.search(text, max(0, m.start() - 80), m.end() + 80)
                    rows.append((i, m.start(), m.end(), m[1].lower(), kind, outcome, near[0] if near else None, 0.9 if near else 0.6))
            columns = list(zip(*rows, strict=True)) or [[]] * 8
            types = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.float32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["id", "start", "end", "verb", "kind", "outcome", "case_number", "confidence"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, EVENT_SCHEMA)


def compound_groups(events: DataFrame, gap: int = 30) -> DataFrame:
    """Events of a document numbered by group: one that begins within ``gap`` of the last one's end goes on with its group."""
    w = Window.partitionBy("id").orderBy("start")
    new = F.col("start") - F.lag("end").over(w) > gap
    return events.withColumn("_new", F.coalesce(new, F.lit(True)).cast("int")).withColumn("group", F.sum("_new").over(w)).drop("_new")


def planned(existing: DataFrame, proposed: DataFrame, key: str, payload: str) -> DataFrame:
    """key and action for proposals against what exists: insert, replay, update (higher confidence) or inconsistent.

    Confidences are compared as 32-bit floats.
    """
    old = existing.select(key, F.col(payload).alias("_old"), F.col("confidence").cast("float").alias("_had"))
    best = proposed.groupBy(key).agg(F.max(F.struct(F.col("confidence").cast("float").alias("confidence"), F.col(payload))).alias("b"), F.count_distinct(payload).alias("_n")).select(key, "b.*", "_n")
    action = F.when(F.col("_n") > 1, "inconsistent").when(F.col("_old").isNull(), "insert").when(F.col("confidence") > F.col("_had"), "update").otherwise("replay")
    return best.join(old, key, "left").select(key, action.alias("action"))


def participants(df: DataFrame, names_col: str, entities: DataFrame) -> DataFrame:
    """Names linked to the best entity that shares a word: exact .95, containment .7 of the lengths' ratio, else 0.6 of Jaccard.

    ``df`` has id and an array of names, ``entities`` has entity_id and name.
    Candidates come from an equi-join on words, so nothing is compared with all.
    """
    words = lambda c: F.filter(F.array_distinct(F.split(F.lower(c), "[^a-z0-9]+")), lambda w: F.length(w) > 2)
    named = df.select("id", F.explode(names_col).alias("name")).distinct()
    left = named.select("id", "name", words(F.col("name")).alias("words"))
    right = entities.select("entity_id", F.col("name").alias("entity"), words(F.col("name")).alias("entity_words"))
    pairs = left.withColumn("w", F.explode("words")).join(right.withColumn("w", F.explode("entity_words")), "w").drop("w").distinct()
    a, b = F.lower("name"), F.lower("entity")
    ratio = F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b))
    both = F.size(F.array_intersect("words", "entity_words"))
    score = F.when(a == b, 0.95).when((F.contains(a, b) | F.contains(b, a)) & (ratio >= 0.6), 0.7 * ratio).when(both >= 2, 0.6 * both / F.size(F.array_union("words", "entity_words")))
    scored = pairs.withColumn("confidence", score.cast("float")).where("confidence is not null")
    best = scored.groupBy("id", "name").agg(F.max(F.struct("confidence", (-F.col("entity_id")).alias("neg"))).alias("b"))
    return best.select("id", "name", (-F.col("b.neg")).alias("entity_id"), "b.confidence")
