"""Replication, parity and governance audits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.replication import dangling, field_mismatches, latest_receipts, multiset_diff, reconcile, secondary_conflicts, upsert
from ..sources.civic import attendance, meetings, table, with_views


def _copies(spark, d):
    """A target table and a newer source of it."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.round("o_totalprice", 2).alias("price"))
    target = o.where("o_orderkey % 10 <> 1")
    source = o.where("o_orderkey % 10 <> 2").withColumn("price", F.when(F.col("o_orderkey") % 7 == 0, F.col("price") + 1).otherwise(F.col("price")))
    return target, source


def upserted(spark, d):
    target, source = _copies(spark, d)
    return upsert(target, source, ["o_orderkey"])


def incremental_upsert(spark, d):
    """Only what changed since the last sync is taken."""
    target, source = _copies(spark, d)
    dates = meetings(spark, d).select(F.col("meeting_id").alias("o_orderkey"), "meeting_date")
    fresh = source.join(dates, "o_orderkey").where("meeting_date > '1999-12-31'").drop("meeting_date")
    return upsert(target, fresh, ["o_orderkey"]).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("price"), 2).alias("amount"))


def reconciled(spark, d):
    target, source = _copies(spark, d)
    return reconcile(target, source, "o_orderkey")


def unique_conflicts(spark, d):
    """Parts whose code belongs to another part already, which is the first of all with that code."""
    part = _coded(spark, d)
    return _conflicts(part, part)


def _coded(spark, d):
    return table(spark, d, "part").select("p_partkey", F.concat_ws("/", "p_name", "p_brand", "p_type").alias("code"))


def _conflicts(target, source):
    return secondary_conflicts(target, source.groupBy("code").agg(F.min("p_partkey").alias("p_partkey")), "p_partkey", "code")


def sync_validation(spark, d):
    """Rows missing from the target fail, surplus ones are allowed."""
    target, source = _copies(spark, d)
    t, s = (df.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias(n)) for df, n in ((target, "target_rows"), (source, "source_rows")))
    return t.join(s, "o_orderstatus", "full_outer").select("o_orderstatus", "target_rows", "source_rows", F.when(F.col("target_rows") < F.col("source_rows"), "deficit").otherwise("ok").alias("verdict"))


def table_diff(spark, d):
    target, source = _copies(spark, d)
    n = multiset_diff(target, source, ["o_orderkey", "o_custkey", "o_orderstatus", "price"])
    return n.agg(F.count(F.lit(1)).alias("hashes"), F.sum("left_n").alias("left_rows"), F.sum("right_n").alias("right_rows"))


def parity(spark, d):
    target, source = _copies(spark, d)
    return field_mismatches(target, source, "o_orderkey", ["o_custkey", "o_orderstatus", "price"])


def dangling_references(spark, d):
    lines = table(spark, d, "lineitem")
    return dangling(lines, [("l_partkey", table(spark, d, "part").where("p_partkey % 50 <> 7"), "p_partkey"), ("l_suppkey", table(spark, d, "supplier").where("s_suppkey <> 5"), "s_suppkey")])


def newly_dangling(spark, d):
    """References that dangle now and did not before."""
    lines, part = table(spark, d, "lineitem"), table(spark, d, "part")
    now, before = dangling(lines, [("l_partkey", part.where("p_partkey % 50 <> 7"), "p_partkey")]), dangling(lines, [("l_partkey", part.where("p_partkey % 100 <> 7"), "p_partkey")])
    return now.join(before.select("reference", "value"), ["reference", "value"], "left_anti")


def receipt_fold(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("identity"), F.date_format("ts", "yyyy-MM-dd HH").alias("recorded_at"), F.col("event_type").alias("digest"))
    return latest_receipts(e, "identity", "recorded_at", "digest")


def receipt_merge(spark, d):
    """One action for each identity of two sets of receipts: append, replay, conflict or keep."""
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("identity")).agg(F.max("event_type").alias("digest"))
    old = e.where("identity % 3 <> 0").withColumnRenamed("digest", "old")
    new = e.where("identity % 4 <> 0").withColumn("digest", F.when(F.col("identity") % 5 == 0, "other").otherwise(F.col("digest")))
    action = F.when(F.col("old").isNull(), "append").when(F.col("digest").isNull(), "keep").when(F.col("old") == F.col("digest"), "replay").otherwise("conflict")
    return old.join(new, "identity", "full_outer").groupBy(action.alias("action")).agg(F.count(F.lit(1)).alias("identities"))


def duplicate_key_families(spark, d):
    """Items that share meeting and number: exact copies, or different items of the same number; the keeper is the first."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.md5(F.concat_ws("|", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).cast("binary")).alias("hash"))
    w = Window.partitionBy("l_orderkey", "l_linenumber")
    v = lines.withColumn("rows", F.count(F.lit(1)).over(w)).where("rows > 1").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("hash").alias("different"), F.min("l_partkey").alias("keeper"))
    return v.withColumn("family", F.when(F.col("different") == 1, "exact_duplicate").when(F.col("different") == F.col("rows"), "distinct_same_number").otherwise("mixed"))


def orphan_parents(spark, d):
    """Item numbers whose parent is no item of the meeting."""
    sub = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("number"), (F.col("l_linenumber") - 1).alias("parent")).distinct().where("parent >= 1")
    have = sub.select("l_orderkey", F.col("number").alias("parent"))
    first = table(spark, d, "lineitem").where("l_linenumber = 1").select("l_orderkey", F.lit(1).alias("parent"))
    return sub.join(have.union(first).distinct(), ["l_orderkey", "parent"], "left_anti").select("l_orderkey", "number", "parent")


def attachment_cascade(spark, d):
    """Documents to items: by source key, else by the only item of the meeting's number, else ambiguous or none."""
    ref = table(spark, d, "documents").select("doc_id", (F.col("doc_id") * 7 % 15000).alias("meeting_id"), (F.col("doc_id") % 5 + 1).cast("int").alias("number"), (F.col("doc_id") % 2000).alias("part_id"))
    items = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("meeting_id"), F.col("l_linenumber").alias("number"), F.col("l_partkey").alias("part_id"))
    exact = items.groupBy("meeting_id", "part_id").agg(F.count(F.lit(1)).alias("exact"))
    by_number = items.groupBy("meeting_id", "number").agg(F.count(F.lit(1)).alias("numbered"))
    by_meeting = items.groupBy("meeting_id").agg(F.count(F.lit(1)).alias("inside"))
    j = ref.join(exact, ["meeting_id", "part_id"], "left").join(by_number, ["meeting_id", "number"], "left").join(by_meeting, "meeting_id", "left")
    state = F.when(F.col("exact") == 1, "source_key").when(F.col("numbered") == 1, "number").when(F.col("inside") == 1, "only_item").when(F.col("inside").isNull(), "no_items").otherwise("ambiguous")
    return j.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("documents"))


def prefix_repair(spark, d):
    """Truncated codes that begin exactly one live code."""
    codes = table(spark, d, "nation").select(F.col("n_name").alias("code"))
    cut = codes.select(F.expr("left(code, length(code) - 1)").alias("cut")).distinct()
    # both sides are the list of bodies; the prefixes of each code make an equi-join
    prefixes = codes.select("code", F.explode(F.transform(F.sequence(F.lit(1), F.length("code")), lambda n: F.left(F.col("code"), n))).alias("cut"))
    return cut.join(prefixes, "cut").groupBy("cut").agg(F.count(F.lit(1)).alias("n"), F.min("code").alias("code")).select("cut", F.when(F.col("n") == 1, F.col("code")).alias("repaired"), F.when(F.col("n") == 1, "unique").otherwise("ambiguous").alias("state"))


def fill_from_parent(spark, d):
    """Empty bodies of items filled from their meeting, or reported as orphans."""
    items = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("meeting_id"), F.when(F.col("l_partkey") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("P"), (F.col("l_partkey") % 9).cast("string"))).alias("body"))
    known = meetings(spark, d).where("meeting_id % 5 <> 0").select("meeting_id", F.col("body").alias("parent_body"))
    j = items.join(known, "meeting_id", "left")
    state = F.when(F.col("body") != "", "kept").when(F.col("parent_body").isNotNull(), "fillable").otherwise("orphaned")
    return j.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("items"), F.count_distinct(F.coalesce(F.nullif("body", F.lit("")), "parent_body")).alias("bodies"))


def retention_inventory(spark, d):
    """Documents and characters by source, with cumulative age buckets."""
    age = F.col("doc_id") % 120
    return table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("files"), F.sum("n_chars").alias("bytes"), *(F.count_if(age > n).alias(f"over_{n}") for n in (7, 30, 90)), F.max("n_chars").alias("largest"))


def next_check(spark, d):
    """When to look at a meeting again: on its day if ahead, two days on if past, never after the sunset."""
    day, today = F.to_date("meeting_date"), F.lit("2000-01-01").cast("date")
    when = F.when(day > today, day).when(F.datediff(today, day) <= 30, F.date_add(today, 2))
    return meetings(spark, d).select("meeting_id", F.date_format(when, "yyyy-MM-dd").alias("next_check"))


def longest_text_backfill(spark, d):
    """The longest text of each source and language."""
    docs = table(spark, d, "documents")
    return docs.groupBy("source", "lang").agg(F.max(F.struct("n_chars", (-F.col("doc_id")).alias("neg"))).alias("best")).select("source", "lang", F.col("best.n_chars").alias("n_chars"), (-F.col("best.neg")).alias("doc_id"))


def crosswalk(spark, d):
    """Meetings of two bodies on one day, corroborated by members in common."""
    m = meetings(spark, d).select("meeting_id", "body", "meeting_date")
    x, y = m.where("body = 'NATION_3'"), m.where("body = 'NATION_4'").select(F.col("meeting_id").alias("other_id"), "meeting_date")
    seats = attendance(spark, d).groupBy("meeting_id").agg(F.collect_set("member_id").alias("members"))
    pairs = x.join(y, "meeting_date").join(seats, "meeting_id").join(seats.select(F.col("meeting_id").alias("other_id"), F.col("members").alias("others")), "other_id")
    shared = F.size(F.array_intersect("members", "others")).cast("long")
    return pairs.select("meeting_id", "other_id", "meeting_date", shared.alias("shared"), F.when(shared > 0, "corroborated").otherwise("dated_only").alias("state"))


_C = """o AS (SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 2) AS price FROM orders),
 target AS (SELECT * FROM o WHERE o_orderkey % 10 <> 1),
 source AS (SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 7 = 0 THEN price + 1 ELSE price END AS price FROM o WHERE o_orderkey % 10 <> 2)"""
_W = f"WITH {_C}\n"
_I = "items AS (SELECT l_orderkey AS meeting_id, l_linenumber AS number, l_partkey AS part_id FROM lineitem)"

PLANS = {
    "upserted": (upserted, _W + "SELECT * FROM source UNION ALL SELECT * FROM target t WHERE NOT EXISTS (SELECT 1 FROM source s WHERE s.o_orderkey = t.o_orderkey)"),
    "incremental_upsert": (incremental_upsert, with_views("meetings", more=_C + ", fresh AS (SELECT s.* FROM source s JOIN meetings ON meeting_id = o_orderkey WHERE meeting_date > '1999-12-31')")
  + """SELECT o_orderstatus, count(*) AS rows, round(sum(price), 2) AS amount FROM (SELECT * FROM fresh UNION ALL SELECT * FROM target t
  WHERE NOT EXISTS (SELECT 1 FROM fresh s WHERE s.o_orderkey = t.o_orderkey)) GROUP BY 1"""),
    "reconciled": (reconciled, _W + """SELECT o_orderkey, 'delete' AS action FROM target t WHERE NOT EXISTS (SELECT 1 FROM source s WHERE s.o_orderkey = t.o_orderkey)
  UNION ALL SELECT o_orderkey, 'insert' FROM source s WHERE NOT EXISTS (SELECT 1 FROM target t WHERE s.o_orderkey = t.o_orderkey)"""),
    "unique_conflicts": (unique_conflicts, """WITH p AS (SELECT p_partkey, p_name || '/' || p_brand || '/' || p_type AS code FROM part)
  SELECT p.code, p.p_partkey FROM p JOIN (SELECT code, min(p_partkey) AS k FROM p GROUP BY 1) s ON s.code = p.code WHERE p_partkey <> k"""),
    "sync_validation": (sync_validation, _W + """SELECT o_orderstatus, target_rows, source_rows, CASE WHEN target_rows < source_rows THEN 'deficit' ELSE 'ok' END AS verdict
  FROM (SELECT o_orderstatus, count(*) AS target_rows FROM target GROUP BY 1) FULL JOIN (SELECT o_orderstatus, count(*) AS source_rows FROM source GROUP BY 1) USING (o_orderstatus)"""),
    "table_diff": (table_diff, _W + """, a AS (SELECT *, count(*) AS n FROM target GROUP BY ALL), b AS (SELECT *, count(*) AS m FROM source GROUP BY ALL)
  SELECT count(*) AS hashes, sum(coalesce(n, 0))::BIGINT AS left_rows, sum(coalesce(m, 0))::BIGINT AS right_rows
  FROM a FULL JOIN b USING (o_orderkey, o_custkey, o_orderstatus, price) WHERE coalesce(n, 0) <> coalesce(m, 0)"""),
    "parity": (parity, _W + "SELECT o_orderkey, 'price' AS fields FROM target t JOIN source s USING (o_orderkey) WHERE t.price IS DISTINCT FROM s.price"),
    "dangling_references": (dangling_references, """SELECT 'l_partkey' AS reference, l_partkey::VARCHAR AS value, count(*) AS rows FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey % 50 <> 7 AND p_partkey = l_partkey) GROUP BY 2
  UNION ALL SELECT 'l_suppkey', l_suppkey::VARCHAR, count(*) FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey <> 5 AND s_suppkey = l_suppkey) GROUP BY 2"""),
    "newly_dangling": (newly_dangling, """SELECT 'l_partkey' AS reference, l_partkey::VARCHAR AS value, count(*) AS rows FROM lineitem
  WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey % 50 <> 7 AND p_partkey = l_partkey) AND EXISTS (SELECT 1 FROM part WHERE p_partkey % 100 <> 7 AND p_partkey = l_partkey) GROUP BY 2"""),
    "receipt_fold": (receipt_fold, """WITH e AS (SELECT DISTINCT user_id AS identity, strftime(ts, '%Y-%m-%d %H') AS seen, event_type AS digest FROM events),
  t AS (SELECT *, max(seen) OVER (PARTITION BY identity) AS latest, count(*) OVER (PARTITION BY identity) AS whole FROM e)
  SELECT identity, min(digest) AS digest, CASE WHEN count(DISTINCT digest) > 1 THEN 'conflict' ELSE 'current' END AS state, max(whole) - count(DISTINCT digest) AS superseded FROM t WHERE seen = latest GROUP BY 1"""),
    "receipt_merge": (receipt_merge, """WITH e AS (SELECT user_id AS identity, max(event_type) AS digest FROM events GROUP BY 1)
  SELECT CASE WHEN identity % 3 = 0 THEN 'append' WHEN identity % 4 = 0 THEN 'keep' WHEN identity % 5 = 0 THEN 'conflict' ELSE 'replay' END AS action, count(*) AS identities FROM e WHERE NOT (identity % 3 = 0 AND identity % 4 = 0) GROUP BY 1"""),
    "duplicate_key_families": (duplicate_key_families, """SELECT *, CASE WHEN different = 1 THEN 'exact_duplicate' WHEN different = rows THEN 'distinct_same_number' ELSE 'mixed' END AS family
  FROM (SELECT l_orderkey, l_linenumber, count(*) AS rows, count(DISTINCT (l_partkey, l_suppkey)) AS different, min(l_partkey) AS keeper FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1)"""),
    "orphan_parents": (orphan_parents, """SELECT DISTINCT l_orderkey, l_linenumber AS number, l_linenumber - 1 AS parent FROM lineitem a WHERE l_linenumber > 1
  AND NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber - 1)"""),
    "attachment_cascade": (attachment_cascade, f"""WITH {_I}, r AS (SELECT doc_id, doc_id * 7 % 15000 AS meeting_id, doc_id % 5 + 1 AS number, doc_id % 2000 AS part_id FROM documents),
  c AS (SELECT doc_id, count(*) FILTER (i.part_id = r.part_id) AS x, count(*) FILTER (i.number = r.number) AS n, count(i.meeting_id) AS a FROM r LEFT JOIN items i ON i.meeting_id = r.meeting_id GROUP BY 1)
  SELECT CASE WHEN x = 1 THEN 'source_key' WHEN n = 1 THEN 'number' WHEN a = 1 THEN 'only_item' WHEN a = 0 THEN 'no_items' ELSE 'ambiguous' END AS state, count(*) AS documents FROM c GROUP BY 1"""),
    "prefix_repair": (prefix_repair, """WITH c AS (SELECT DISTINCT left(n_name, length(n_name) - 1) AS cut FROM nation)
  SELECT cut, CASE WHEN count(*) = 1 THEN min(n_name) END AS repaired, CASE WHEN count(*) = 1 THEN 'unique' ELSE 'ambiguous' END AS state FROM c JOIN nation ON starts_with(n_name, cut) GROUP BY 1"""),
    "fill_from_parent": (fill_from_parent, with_views("meetings", more="""i AS (SELECT l_orderkey, CASE WHEN l_partkey % 3 = 0 THEN '' ELSE 'P' || (l_partkey % 9) END AS b FROM lineitem),
  j AS (SELECT b, p.body AS pb FROM i LEFT JOIN (SELECT meeting_id, body FROM meetings WHERE meeting_id % 5 <> 0) p ON meeting_id = l_orderkey)""")
  + """SELECT CASE WHEN b <> '' THEN 'kept' WHEN pb IS NOT NULL THEN 'fillable' ELSE 'orphaned' END AS state, count(*) AS items, count(DISTINCT coalesce(nullif(b, ''), pb)) AS bodies FROM j GROUP BY 1"""),
    "retention_inventory": (retention_inventory, "SELECT source, count(*) AS files, sum(n_chars)::BIGINT AS bytes, " + ", ".join(f"count(*) FILTER (doc_id % 120 > {n}) AS over_{n}" for n in (7, 30, 90)) + ", max(n_chars) AS largest FROM documents GROUP BY 1"),
    "next_check": (next_check, with_views("meetings") + """SELECT meeting_id, CASE WHEN meeting_date > '2000-01-01' THEN meeting_date WHEN date_diff('day', meeting_date::DATE, DATE '2000-01-01') <= 30 THEN '2000-01-03' END AS next_check FROM meetings"""),
    "longest_text_backfill": (longest_text_backfill, "SELECT DISTINCT ON (source, lang) source, lang, n_chars, doc_id FROM documents ORDER BY source, lang, n_chars DESC, doc_id"),
    "crosswalk": (crosswalk, with_views("attendance", "meetings") + """SELECT x.meeting_id, y.meeting_id AS other_id, x.meeting_date, count(b.member_id) AS shared, CASE WHEN count(b.member_id) > 0 THEN 'corroborated' ELSE 'dated_only' END AS state
  FROM meetings x JOIN meetings y ON x.meeting_date = y.meeting_date AND x.body = 'NATION_3' AND y.body = 'NATION_4'
  JOIN attendance a ON a.meeting_id = x.meeting_id LEFT JOIN attendance b ON b.meeting_id = y.meeting_id AND b.member_id = a.member_id
  WHERE EXISTS (SELECT 1 FROM attendance z WHERE z.meeting_id = y.meeting_id) GROUP BY 1, 2, 3"""),
}
