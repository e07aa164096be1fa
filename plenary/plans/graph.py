"""Entities, the graph over them, resolution, audits and integrity."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import name_similarity, normalised_tokens, org_name, tokens, vocabulary_of
from ..operators.relational import distinct_on, top_per_group
from ..operators.resolution import blocked_pairs, components, survivors
from ..sources.civic import attendance, meetings, table, with_views

#: Which kind of entity a relation may go from and to.
PREDICATES = (("MEMBER_OF", "person", "body"), ("PRESENT_AT", "person", "meeting"), ("PART_OF", "body", "jurisdiction"), ("APPLIED_FOR", "organisation", "case"))


def entities(spark, d):
    """id, name, kind (of the brand), mentions: parts and the lines that name them."""
    mentions = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.count(F.lit(1)).alias("mentions"))
    part = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("kind"))
    return part.join(mentions, "id", "left").withColumn("mentions", F.coalesce("mentions", F.lit(0)))


def entity_directory(spark, d):
    """Entities with the range of dates that mention them, most mentioned first."""
    m = meetings(spark, d).select("meeting_id", "meeting_date")
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("meeting_id"), F.col("l_partkey").alias("id"))
    seen = lines.join(m, "meeting_id").groupBy("id").agg(F.count(F.lit(1)).alias("mentions"), F.min("meeting_date").alias("first_seen"), F.max("meeting_date").alias("last_seen"))
    part = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("kind"))
    return part.join(seen, "id").orderBy(F.desc("mentions"), "name", "id").limit(100)


def entity_kind_counts(spark, d):
    return entities(spark, d).groupBy("kind").agg(F.count(F.lit(1)).alias("entities"), F.count_distinct("name").alias("names"), F.sum("mentions").alias("mentions"))


def entity_top_per_kind(spark, d):
    """The five most mentioned of each kind with at least three entities."""
    e = entities(spark, d)
    enough = e.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).where("n >= 3").select("kind")
    return top_per_group(e.join(enough, "kind"), ["kind"], 5, F.desc("mentions"), "name", "id")


def entity_timeline(spark, d):
    """One mention of an entity a meeting, the latest hundred."""
    lines = table(spark, d, "lineitem").where("l_partkey = 7").select(F.col("l_orderkey").alias("meeting_id"), "l_linenumber", "l_suppkey", "l_extendedprice")
    one = distinct_on(lines, ["meeting_id"], "l_linenumber", "l_suppkey", "l_extendedprice")
    return one.join(meetings(spark, d).select("meeting_id", "meeting_date", "body"), "meeting_id").orderBy(F.desc("meeting_date"), "meeting_id").limit(100).select("meeting_id", "meeting_date", "body", "l_linenumber")


def entity_by_jurisdiction(spark, d):
    """Mentions of every entity by jurisdiction."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("meeting_id"), F.col("l_partkey").alias("id"))
    return lines.join(meetings(spark, d).select("meeting_id", "jurisdiction_id"), "meeting_id").groupBy("id", "jurisdiction_id").agg(F.count(F.lit(1)).alias("mentions"), F.count_distinct("meeting_id").alias("meetings"))


def relations_both_ways(spark, d):
    """Neighbours of members in the graph of shared meetings of a day, either direction once."""
    seen = attendance(spark, d).join(meetings(spark, d).where("meeting_date = '1997-05-05'").select("meeting_id"), "meeting_id").select("meeting_id", "member_id")
    other = seen.withColumnRenamed("member_id", "other_id")
    edges = seen.join(other, "meeting_id").where("member_id < other_id").select("member_id", "other_id")
    return edges.union(edges.select("other_id", "member_id")).distinct()


def graph_edges(spark, d):
    """Edges by predicate: members of bodies, present at meetings, bodies part of jurisdictions."""
    seen = attendance(spark, d).where("present").join(meetings(spark, d).select("meeting_id", "body_id"), "meeting_id")
    member = seen.select(F.lit("MEMBER_OF").alias("predicate"), F.col("member_id").alias("subject"), F.col("body_id").alias("object")).distinct()
    present = seen.select(F.lit("PRESENT_AT").alias("predicate"), F.col("member_id").alias("subject"), F.col("meeting_id").alias("object"))
    part_of = table(spark, d, "nation").select(F.lit("PART_OF").alias("predicate"), F.col("n_nationkey").cast("long").alias("subject"), F.col("n_regionkey").cast("long").alias("object"))
    return member.unionByName(present).unionByName(part_of)


def graph_accounting(spark, d):
    """Every proposed edge in one class: new, replay of a known one, or unresolved."""
    known = graph_edges(spark, d).where("subject % 3 = 0").select("predicate", "subject", "object", F.lit(True).alias("known"))
    state = F.when(F.col("subject") % 17 == 5, "unresolved").when(F.col("known"), "replay").otherwise("new")
    return graph_edges(spark, d).join(known, ["predicate", "subject", "object"], "left").groupBy("predicate", state.alias("state")).agg(F.count(F.lit(1)).alias("edges"))


def predicate_audit(spark, d):
    """Edges whose ends have kinds that the predicate doesn't allow."""
    rules = spark.createDataFrame(list(PREDICATES), "predicate string, domain string, range string")
    kinds = graph_edges(spark, d).select("predicate", F.when(F.col("subject") % 29 == 0, "organisation").when(F.col("predicate") == "PART_OF", "body").otherwise("person").alias("from_kind"), F.when(F.col("predicate") == "MEMBER_OF", "body").when(F.col("predicate") == "PRESENT_AT", "meeting").otherwise("jurisdiction").alias("to_kind"))
    j = kinds.join(F.broadcast(rules), "predicate", "left")  # a fixed list of four
    return j.groupBy("predicate", "from_kind", "to_kind").agg(F.count(F.lit(1)).alias("edges"), F.count_if((F.col("from_kind") != F.col("domain")) | (F.col("to_kind") != F.col("range"))).alias("violations"))


def vocabulary_audit(spark, d):
    """Each observed value: canonical, compatible or unmapped, with its count."""
    p = table(spark, d, "orders")
    return p.groupBy(F.col("o_orderpriority").alias("value")).agg(F.count(F.lit(1)).alias("rows")).select("value", "rows", vocabulary_of(F.col("value"), ["1-URGENT", "2-HIGH", "3-MEDIUM"], {"5-LOW": "3-MEDIUM"}).alias("class"))


def type_conflicts(spark, d):
    """Entities of one name and different kinds; the winner by kind, unless the other has far more mentions."""
    e = entities(spark, d)
    o = e.select(F.col("id").alias("other_id"), "name", F.col("kind").alias("other_kind"), F.col("mentions").alias("other_mentions"))
    pairs = e.join(o, "name").where((F.col("id") < F.col("other_id")) & (F.col("kind") != F.col("other_kind")))
    outnumbered = (F.col("mentions") <= 2) & (F.col("other_mentions") > 3 * F.col("mentions"))
    return pairs.select("name", "id", "other_id", F.when(outnumbered | (F.col("other_kind") < F.col("kind")), F.col("other_id")).otherwise(F.col("id")).alias("winner"))


def duplicate_names(spark, d):
    """Names that several entities have, with the keeper."""
    return entities(spark, d).groupBy(org_name(F.col("name")).alias("name")).agg(F.count(F.lit(1)).alias("entities"), F.sum("mentions").alias("mentions"), F.min("id").alias("keeper"), (F.count(F.lit(1)) - 1).alias("excess")).where("entities > 1")


def similar_names(spark, d):
    """Pairs of distinct names that share a token and are similar enough."""
    names = entities(spark, d).select("name").distinct().select(F.col("name").alias("id"))
    pairs = blocked_pairs(names, "id", tokens(F.col("id")))
    return pairs.select(F.col("id").alias("name"), F.col("other_id").alias("other"), F.round(name_similarity(F.col("id"), F.col("other_id")), 4).alias("similarity")).where("similarity > 0.3")


def equal_name_merges(spark, d):
    """Entities merged into the most mentioned one of exactly the same name, with summed mentions."""
    e = entities(spark, d)
    return _merged(e, e.select("id", F.min("id").over(Window.partitionBy("name")).alias("component")))


def merge_plan(spark, d):
    """Entities merged into the most mentioned one of a component of similar names, with summed mentions."""
    e = entities(spark, d)
    names = e.where("name is not null").select(F.col("name").alias("id")).distinct()
    label = components(_alike(names), names)
    return _merged(e, e.join(label.select(F.col("id").alias("name"), "component"), "name", "left").select("id", F.coalesce("component", F.concat(F.lit("\0"), F.col("id").cast("string"))).alias("component")))


def _alike(names):
    """Pairs (a, b) of names with a similarity of 0.85 or more.

    All of them share a word, or one contains the other: then its first three
    characters are three of the longer's in a row. Acronyms count 0.75 and can't merge.
    """
    shared = blocked_pairs(names, "id", tokens(F.col("id"))).select(F.col("id").alias("a"), F.col("other_id").alias("b"))
    plain = names.select("id", normalised_tokens(F.col("id")).alias("plain")).where(F.length("plain") >= 3)
    heads = plain.select(F.col("id").alias("a"), F.col("plain").alias("inner"), F.left("plain", F.lit(3)).alias("_block"))
    parts = F.transform(F.sequence(F.lit(1), F.length("plain") - 2), lambda i: F.substring(F.col("plain"), i, F.lit(3)))
    longer = plain.select(F.col("id").alias("b"), F.col("plain").alias("outer"), F.explode(F.array_distinct(parts)).alias("_block"))
    inside = heads.join(longer, "_block").where((F.col("a") != F.col("b")) & F.contains("outer", "inner")).select("a", "b")
    return shared.union(inside).distinct().where(name_similarity(F.col("a"), F.col("b")) >= 0.85)


def _merged(e, label):
    s = survivors(e, label, "mentions")
    return e.join(s, "id").groupBy("survivor").agg(F.count(F.lit(1)).alias("merged"), F.sum("mentions").alias("mentions"), F.count_if(F.col("id") != F.col("survivor")).alias("victims"))


def integrity_invariants(spark, d):
    """Named counts that should be 0."""
    lines, orders, part, labels, docs = (table(spark, d, t) for t in ("lineitem", "orders", "part", "labels", "documents"))
    repeats = lines.groupBy("l_orderkey", "l_linenumber").agg((F.count(F.lit(1)) - 1).alias("n")).where("n > 0").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))
    no_item = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").agg(F.count(F.lit(1)).alias("rows"))
    no_part = lines.join(part, F.col("l_partkey") == F.col("p_partkey"), "left_anti").agg(F.count(F.lit(1)).alias("rows"))
    unlabelled = docs.join(labels, "doc_id", "left_anti").agg(F.count(F.lit(1)).alias("rows"))
    named = [df.select(F.lit(n).alias("invariant"), "rows") for n, df in (("repeated_items", repeats), ("meetings_without_items", no_item), ("unknown_entities", no_part), ("unlabelled_documents", unlabelled))]
    return named[0].union(named[1]).union(named[2]).union(named[3])


def supporting_edges(spark, d):
    """Of each body and month, the members who were present at all its meetings of the month."""
    held = meetings(spark, d).select("meeting_id", "body", F.left("meeting_date", F.lit(7)).alias("month"))
    return _always_present(spark, d, held, ["body", "month"])


def _always_present(spark, d, held, keys):
    """Relational division: of each group of meetings, the members present at all of them."""
    need = held.groupBy(*keys).agg(F.count(F.lit(1)).alias("need"))
    has = held.join(attendance(spark, d).where("present"), "meeting_id").groupBy(*keys, "member_id").agg(F.count(F.lit(1)).alias("has"))
    return has.join(need, keys).where("has = need").select(*keys, "member_id", "need")


def polymorphic_documents(spark, d):
    """Labels by what they are about: conversations or documents, by the parity of the id."""
    labels = table(spark, d, "labels").withColumn("source_type", F.when(F.col("doc_id") % 2 == 0, "document").otherwise("conversation"))
    docs = labels.where("source_type = 'document'").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id").select("source_type", F.col("lang").alias("about"))
    conv = labels.where("source_type = 'conversation'").join(table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), "role").distinct(), "doc_id").select("source_type", F.col("role").alias("about"))
    return docs.union(conv).groupBy("source_type", "about").agg(F.count(F.lit(1)).alias("labels"))


_E = """entities AS (SELECT p_partkey AS id, p_name AS name, p_brand AS kind, coalesce(mentions, 0) AS mentions FROM part
  LEFT JOIN (SELECT l_partkey, count(*) AS mentions FROM lineitem GROUP BY 1) ON l_partkey = p_partkey)"""
_G = """seen AS (SELECT member_id, meeting_id, body_id FROM attendance JOIN meetings USING (meeting_id) WHERE present),
 edges AS (SELECT DISTINCT 'MEMBER_OF' AS predicate, member_id AS subject, body_id AS object FROM seen
  UNION ALL SELECT 'PRESENT_AT', member_id, meeting_id FROM seen
  UNION ALL SELECT 'PART_OF', n_nationkey::BIGINT, n_regionkey::BIGINT FROM nation)"""
_ENT = f"WITH {_E}\n"

PLANS = {
    "entity_directory": (entity_directory, with_views("meetings") + """SELECT p_partkey AS id, p_name AS name, p_brand AS kind, count(*) AS mentions, min(meeting_date) AS first_seen, max(meeting_date) AS last_seen
  FROM part JOIN lineitem ON l_partkey = p_partkey JOIN meetings ON meeting_id = l_orderkey GROUP BY 1, 2, 3 ORDER BY mentions DESC, name, id LIMIT 100"""),
    "entity_kind_counts": (entity_kind_counts, _ENT + "SELECT kind, count(*) AS entities, count(DISTINCT name) AS names, sum(mentions)::BIGINT AS mentions FROM entities GROUP BY 1"),
    "entity_top_per_kind": (entity_top_per_kind, _ENT + """SELECT id, name, kind, mentions FROM entities WHERE kind IN (SELECT kind FROM entities GROUP BY 1 HAVING count(*) >= 3)
  QUALIFY row_number() OVER (PARTITION BY kind ORDER BY mentions DESC, name, id) <= 5"""),
    "entity_timeline": (entity_timeline, with_views("meetings") + """SELECT meeting_id, meeting_date, body, l_linenumber FROM (SELECT DISTINCT ON (l_orderkey) l_orderkey, l_linenumber FROM lineitem WHERE l_partkey = 7
  ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice) JOIN meetings ON meeting_id = l_orderkey ORDER BY meeting_date DESC, meeting_id LIMIT 100"""),
    "entity_by_jurisdiction": (entity_by_jurisdiction, with_views("meetings") + """SELECT l_partkey AS id, jurisdiction_id, count(*) AS mentions, count(DISTINCT meeting_id) AS meetings
  FROM lineitem JOIN meetings ON meeting_id = l_orderkey GROUP BY 1, 2"""),
    "relations_both_ways": (relations_both_ways, with_views("attendance", "meetings", more="""s AS (SELECT meeting_id, member_id FROM attendance JOIN meetings USING (meeting_id) WHERE meeting_date = '1997-05-05')""")
  + "SELECT DISTINCT a.member_id, b.member_id AS other_id FROM s a JOIN s b USING (meeting_id) WHERE a.member_id <> b.member_id"),
    "graph_edges": (graph_edges, with_views("attendance", "meetings", more=_G) + "SELECT * FROM edges"),
    "graph_accounting": (graph_accounting, with_views("attendance", "meetings", more=_G) + """SELECT predicate, CASE WHEN subject % 17 = 5 THEN 'unresolved' WHEN subject % 3 = 0 THEN 'replay' ELSE 'new' END AS state,
  count(*) AS edges FROM edges GROUP BY 1, 2"""),
    "predicate_audit": (predicate_audit, with_views("attendance", "meetings", more=_G + """, k AS (SELECT predicate, CASE WHEN subject % 29 = 0 THEN 'organisation' WHEN predicate = 'PART_OF' THEN 'body' ELSE 'person' END AS from_kind,
  CASE predicate WHEN 'MEMBER_OF' THEN 'body' WHEN 'PRESENT_AT' THEN 'meeting' ELSE 'jurisdiction' END AS to_kind FROM edges)""")
  + "SELECT predicate, from_kind, to_kind, count(*) AS edges, count(*) FILTER (from_kind <> CASE predicate WHEN 'PART_OF' THEN 'body' ELSE 'person' END) AS violations FROM k GROUP BY 1, 2, 3"),
    "vocabulary_audit": (vocabulary_audit, """SELECT o_orderpriority AS value, count(*) AS rows, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 'canonical'
  WHEN o_orderpriority = '5-LOW' THEN 'compatible' ELSE 'unmapped' END AS class FROM orders GROUP BY 1"""),
    "type_conflicts": (type_conflicts, _ENT + """SELECT a.name, a.id, b.id AS other_id, CASE WHEN (a.mentions <= 2 AND b.mentions > 3 * a.mentions) OR b.kind < a.kind THEN b.id ELSE a.id END AS winner
  FROM entities a JOIN entities b ON a.name = b.name AND a.id < b.id AND a.kind <> b.kind"""),
    "duplicate_names": (duplicate_names, _ENT + "SELECT lower(name) AS name, count(*) AS entities, sum(mentions)::BIGINT AS mentions, min(id) AS keeper, count(*) - 1 AS excess FROM entities GROUP BY 1 HAVING count(*) > 1"),
    "similar_names": (similar_names, """WITH n AS (SELECT DISTINCT p_name AS name, list_distinct(string_split_regex(lower(p_name), '[^a-z0-9]+')) AS t,
    list_aggregate(list_transform(string_split(p_name, ' '), lambda w: left(w, 1)), 'string_agg', '') AS initials FROM part),
  s AS (SELECT a.name, b.name AS other, a.initials AS p, b.initials AS q, len(list_intersect(a.t, b.t)) AS i, len(list_distinct(a.t || b.t)) AS u FROM n a JOIN n b ON a.name < b.name)
  SELECT name, other, round(greatest(i / u, CASE WHEN contains(name, other) OR contains(other, name) THEN 0.85 ELSE 0 END,
    CASE WHEN length(p) > 1 AND (p = q OR contains(other, p) OR contains(name, q)) THEN 0.75 ELSE 0 END), 4)::DOUBLE AS similarity FROM s WHERE i > 0 AND i / u > 0.3"""),
    "equal_name_merges": (equal_name_merges, _ENT + """SELECT survivor, count(*) AS merged, sum(mentions)::BIGINT AS mentions, count(*) FILTER (id <> survivor) AS victims
  FROM (SELECT *, first_value(id) OVER (PARTITION BY name ORDER BY mentions DESC, id) AS survivor FROM entities) GROUP BY 1"""),
    "merge_plan": (merge_plan, None),
    "integrity_invariants": (integrity_invariants, """SELECT 'repeated_items' AS invariant, coalesce(sum(n), 0)::BIGINT AS rows FROM (SELECT count(*) - 1 AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)
  UNION ALL SELECT 'meetings_without_items', count(*) FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
  UNION ALL SELECT 'unknown_entities', count(*) FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE l_partkey = p_partkey)
  UNION ALL SELECT 'unlabelled_documents', count(*) FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)"""),
    "supporting_edges": (supporting_edges, with_views("attendance", "meetings", more="""held AS (SELECT meeting_id, body, left(meeting_date, 7) AS month FROM meetings)""")
  + """SELECT body, month, member_id, need FROM (SELECT body, month, member_id, count(*) AS has FROM held JOIN attendance USING (meeting_id) WHERE present GROUP BY 1, 2, 3)
  JOIN (SELECT body, month, count(*) AS need FROM held GROUP BY 1, 2) USING (body, month) WHERE has = need"""),
    "polymorphic_documents": (polymorphic_documents, """SELECT 'document' AS source_type, lang AS about, count(*) AS labels FROM labels JOIN documents USING (doc_id) WHERE doc_id % 2 = 0 GROUP BY 2
  UNION ALL SELECT 'conversation', role, count(*) FROM labels JOIN (SELECT DISTINCT conv_id, role FROM conversations) ON conv_id = doc_id WHERE doc_id % 2 <> 0 GROUP BY 2"""),
}
