"""Read models of meetings, memberships, filters and status."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.relational import distinct_on, or_join, page, symmetric_counts, top_per_group
from ..sources.civic import agenda_items, attendance, meetings, table, with_views

AS_OF = "1998-06-30"


def status_summary(spark, d):
    """Meetings by status, null as pending, with the share of the whole."""
    m = meetings(spark, d)
    total = m.agg(F.count(F.lit(1)).alias("whole"))
    return m.groupBy(F.coalesce("status", F.lit("pending")).alias("status")).agg(F.count(F.lit(1)).alias("meetings"), F.min("meeting_date").alias("first_date"), F.max("meeting_date").alias("last_date")).crossJoin(F.broadcast(total)).select(
        "status", "meetings", "first_date", "last_date", F.round(F.col("meetings") / F.col("whole"), 4).alias("share")
    )


def sync_report(spark, d):
    """Failures by category since a day, by ordered rules on the kind of meeting."""
    kind = F.col("meeting_type")
    category = F.when(kind.startswith("1"), "TRANSIENT").when(kind.startswith("2"), "CODE").when(kind.startswith("3"), "DATA").otherwise("UNKNOWN")
    rows = meetings(spark, d).where((F.col("status") == "failed") & (F.col("meeting_date") >= AS_OF))
    return rows.groupBy(category.alias("category"), "body").agg(F.count(F.lit(1)).alias("failures"), F.max("meeting_date").alias("latest"))


def filtered_meetings(spark, d):
    """One page of the meetings that pass optional filters, with totals."""
    filters = {"jurisdiction_id": 2, "status": "complete", "body": None, "from": "1996-01-01", "to": "1999-12-31"}
    m = meetings(spark, d)
    for name, value in filters.items():
        if value is not None and value != "all":
            m = m.where(F.col("meeting_date") >= value if name == "from" else F.col("meeting_date") <= value if name == "to" else F.col(name) == value)
    return page(m.select("meeting_id", "body", "meeting_date", "meeting_type"), [F.desc("meeting_date"), "meeting_id"], 3, 25)


def calendar_by_day(spark, d):
    """Each day's meetings by priority tier."""
    tier = F.when(F.col("meeting_type").startswith("1"), 0).when(F.col("meeting_type").startswith("2"), 1).otherwise(2)
    m = meetings(spark, d).where(F.col("meeting_date").between("1997-03-01", "1997-03-31")).withColumn("tier", tier)
    key = F.concat(F.col("tier").cast("string"), F.lpad(F.col("meeting_id").cast("string"), 9, "0"))
    return m.groupBy("meeting_date").agg(F.count(F.lit(1)).alias("meetings"), F.count_if(F.col("tier") == 0).alias("urgent"), F.array_join(F.array_sort(F.collect_list(key)), ",").alias("ordered"))


def monthly_buckets(spark, d):
    """Meetings by month, and by the Monday of their week."""
    day = F.to_date("meeting_date")
    return meetings(spark, d).groupBy(F.date_format(F.trunc(day, "month"), "yyyy-MM-dd").alias("month"), F.date_format(F.trunc(day, "week"), "yyyy-MM-dd").alias("week")).agg(F.count(F.lit(1)).alias("meetings"))


def filter_options(spark, d):
    """Bodies of each jurisdiction, sorted."""
    r, n = table(spark, d, "region"), table(spark, d, "nation")
    return r.join(n, F.col("r_regionkey") == F.col("n_regionkey"), "left").groupBy(F.col("r_name").alias("jurisdiction")).agg(F.count("n_nationkey").alias("bodies"), F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("names"))


def meeting_detail(spark, d):
    """Items of each meeting of a day with votes and sums."""
    m = meetings(spark, d).where("meeting_date = '1997-05-05'").select("meeting_id", "body", "meeting_date")
    items = agenda_items(spark, d)
    return m.join(items, "meeting_id").groupBy("meeting_id", "body", "meeting_date", "item_number").agg(F.count(F.lit(1)).alias("rows"), F.min("title").alias("title"), F.round(F.sum("price"), 2).alias("amount"))


def meetings_or_body(spark, d):
    """Meetings with the body that matches by id or by code; a meeting that two bodies match comes twice, never more."""
    m = meetings(spark, d).select("meeting_id", F.col("body").alias("code"), (F.col("body_id") + F.when(F.col("meeting_id") % 7 == 0, 1).otherwise(0)).alias("ref"))
    bodies = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("body_id"), "n_name")
    return or_join(m, bodies, "meeting_id", [("ref", "body_id"), ("code", "n_name")], "body_id").select("meeting_id", "code", "ref", "body_id", "n_name")


def meetings_without_items(spark, d):
    items = agenda_items(spark, d).select("meeting_id")
    return meetings(spark, d).join(items, "meeting_id", "left_anti").select("meeting_id", "body", "meeting_date")


def meetings_with_expensive_items(spark, d):
    items = agenda_items(spark, d).where("price > 90000").select("meeting_id")
    return meetings(spark, d).join(items, "meeting_id", "left_semi").select("meeting_id", "body", "meeting_date")


def memberships(spark, d):
    """Terms: a member's first to last attended meeting of a body; open if within the last half year."""
    seen = attendance(spark, d).where("present").join(meetings(spark, d).select("meeting_id", "body", "meeting_date"), "meeting_id")
    terms = seen.groupBy("body", "member_id").agg(F.min("meeting_date").alias("term_start"), F.max("meeting_date").alias("last_seen"))
    return terms.withColumn("term_end", F.when(F.col("last_seen") < "2001-02-01", F.col("last_seen")))


def current_membership(spark, d):
    """Memberships valid on a day, a page of them."""
    t = memberships(spark, d).where((F.col("term_start") <= AS_OF) & (F.col("term_end").isNull() | (F.col("term_end") >= AS_OF)))
    return page(t.select("body", "member_id", "term_start"), ["body", "member_id"], 2, 50)


def latest_membership(spark, d):
    """Of each member, the body joined last."""
    return distinct_on(memberships(spark, d), ["member_id"], F.desc("term_start"), "body").select("member_id", "body", "term_start")


def attendance_reconcile(spark, d):
    """Recorded against observed attendance: update, insert, retain or same."""
    old = attendance(spark, d).where(F.col("member_id") % 3 != 0).withColumnRenamed("present", "was")
    new = attendance(spark, d).where(F.col("member_id") % 4 != 0).withColumn("present", F.col("present") != (F.col("member_id") % 5 == 0))
    action = F.when(F.col("was").isNull(), "insert").when(F.col("present").isNull(), "retain").when(F.col("was") == F.col("present"), "same").otherwise("update")
    return old.join(new, ["meeting_id", "member_id"], "full_outer").groupBy(action.alias("action")).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.coalesce("present", "was")).alias("present"))


def revision_history(spark, d):
    """Purchases of a customer as revisions of a case, each with the days since the last."""
    from pyspark.sql import Window

    o = table(spark, d, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("item_id"), F.to_date("o_orderdate").alias("day"))
    w = Window.partitionBy("case_id").orderBy("day", "item_id")
    return o.select("case_id", "item_id", F.date_format("day", "yyyy-MM-dd").alias("on_day"), F.row_number().over(w).cast("long").alias("revision"), F.datediff("day", F.lag("day").over(w)).cast("long").alias("days_since"))


def status_crosstab(spark, d):
    """Extraction status by age and jurisdiction."""
    age = F.datediff(F.lit("2001-08-02").cast("date"), F.to_date("meeting_date"))
    bucket = F.when(age <= 30, "0-30").when(age <= 90, "31-90").when(age <= 365, "91-365").otherwise("older")
    return meetings(spark, d).groupBy(bucket.alias("age"), "jurisdiction_id").agg(
        F.count(F.lit(1)).alias("meetings"), *(F.count_if(F.coalesce(F.col("status") == s, F.lit(False))).alias(s) for s in ("complete", "failed")), F.count_if(F.col("status").isNull()).alias("pending")
    )


def busiest_per_body(spark, d):
    """The three days with most meetings of each body that has at least ten days."""
    days = meetings(spark, d).groupBy("body", "meeting_date").agg(F.count(F.lit(1)).alias("meetings"))
    bodies = days.groupBy("body").agg(F.count(F.lit(1)).alias("days")).where("days >= 10").select("body")
    return top_per_group(days.join(bodies, "body"), ["body"], 3, F.desc("meetings"), "meeting_date")


def code_overlap(spark, d):
    """Dates on which both of two bodies met."""
    day = lambda b: meetings(spark, d).where(F.col("body") == b).select("meeting_date")
    return day("NATION_3").intersect(day("NATION_4"))


def code_difference(spark, d):
    day = lambda b: meetings(spark, d).where(F.col("body") == b).select("meeting_date")
    return day("NATION_3").subtract(day("NATION_4"))


def child_count_difference(spark, d):
    """Meetings by date of two bodies, compared."""
    m = meetings(spark, d)
    return symmetric_counts(m.where("body = 'NATION_3'"), m.where("body = 'NATION_4'"), ["meeting_date"])


def data_inventory(spark, d):
    """Coverage of each body: meetings, dates, items, and completeness."""
    items = agenda_items(spark, d).groupBy("meeting_id").agg(F.count(F.lit(1)).alias("items"))
    return meetings(spark, d).join(items, "meeting_id", "left").groupBy("body").agg(
        F.count(F.lit(1)).alias("meetings"), F.min("meeting_date").alias("first_date"), F.max("meeting_date").alias("last_date"),
        F.sum(F.coalesce("items", F.lit(0))).alias("items"), F.count_if(F.col("items").isNull()).alias("without_items"),
        F.round(F.try_divide(F.sum("items"), F.count("items")), 4).alias("items_per_meeting"),
    ).where("meetings >= 3")


_SEEN = "FROM attendance JOIN meetings USING (meeting_id) WHERE present"
_TERMS = f"""memberships AS (SELECT *, CASE WHEN last_seen < '2001-02-01' THEN last_seen END AS term_end
  FROM (SELECT body, member_id, min(meeting_date) AS term_start, max(meeting_date) AS last_seen {_SEEN} GROUP BY 1, 2))"""

PLANS = {
    "status_summary": (status_summary, with_views("meetings") + """SELECT coalesce(status, 'pending') AS status, count(*) AS meetings, min(meeting_date) AS first_date,
  max(meeting_date) AS last_date, round(count(*) / (SELECT count(*) FROM meetings), 4) AS share FROM meetings GROUP BY 1"""),
    "sync_report": (sync_report, with_views("meetings") + """SELECT CASE left(meeting_type, 1) WHEN '1' THEN 'TRANSIENT' WHEN '2' THEN 'CODE' WHEN '3' THEN 'DATA' ELSE 'UNKNOWN' END AS category,
  body, count(*) AS failures, max(meeting_date) AS latest FROM meetings WHERE status = 'failed' AND meeting_date >= '1998-06-30' GROUP BY 1, 2"""),
    "filtered_meetings": (filtered_meetings, with_views("meetings", more="""m AS (SELECT meeting_id, body, meeting_date, meeting_type FROM meetings
  WHERE jurisdiction_id = 2 AND status = 'complete' AND meeting_date BETWEEN '1996-01-01' AND '1999-12-31')""") + """SELECT *, (SELECT count(*) FROM m) AS total_count,
  ceil((SELECT count(*) FROM m) / 25)::BIGINT AS total_pages FROM m ORDER BY meeting_date DESC, meeting_id LIMIT 25 OFFSET 50"""),
    "calendar_by_day": (calendar_by_day, with_views("meetings", more="""t AS (SELECT *, CASE left(meeting_type, 1) WHEN '1' THEN 0 WHEN '2' THEN 1 ELSE 2 END AS tier FROM meetings
  WHERE meeting_date BETWEEN '1997-03-01' AND '1997-03-31')""") + """SELECT meeting_date, count(*) AS meetings, count(*) FILTER (tier = 0) AS urgent,
  string_agg(tier::VARCHAR || lpad(meeting_id::VARCHAR, 9, '0'), ',' ORDER BY tier::VARCHAR || lpad(meeting_id::VARCHAR, 9, '0')) AS ordered FROM t GROUP BY 1"""),
    "monthly_buckets": (monthly_buckets, with_views("meetings") + """SELECT strftime(date_trunc('month', meeting_date::DATE), '%Y-%m-%d') AS month,
  strftime(date_trunc('week', meeting_date::DATE), '%Y-%m-%d') AS week, count(*) AS meetings FROM meetings GROUP BY 1, 2"""),
    "filter_options": (filter_options, """SELECT r_name AS jurisdiction, count(n_nationkey) AS bodies, string_agg(n_name, ',' ORDER BY n_name) AS names
  FROM region LEFT JOIN nation ON r_regionkey = n_regionkey GROUP BY 1"""),
    "meeting_detail": (meeting_detail, with_views("meetings", "agenda_items") + """SELECT meeting_id, body, meeting_date, item_number, count(*) AS rows, min(title) AS title,
  round(sum(i.price), 2) AS amount FROM meetings JOIN agenda_items i USING (meeting_id) WHERE meeting_date = '1997-05-05' GROUP BY ALL"""),
    "meetings_or_body": (meetings_or_body, with_views("meetings", more="""m AS (SELECT meeting_id, body AS code, body_id + CASE WHEN meeting_id % 7 = 0 THEN 1 ELSE 0 END AS ref FROM meetings)""")
  + "SELECT meeting_id, code, ref, n_nationkey::BIGINT AS body_id, n_name FROM m LEFT JOIN nation ON ref = n_nationkey OR code = n_name"),
    "meetings_without_items": (meetings_without_items, with_views("meetings") + """SELECT meeting_id, body, meeting_date FROM meetings
  WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = meeting_id)"""),
    "meetings_with_expensive_items": (meetings_with_expensive_items, with_views("meetings") + """SELECT meeting_id, body, meeting_date FROM meetings
  WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = meeting_id AND l_extendedprice > 90000)"""),
    "memberships": (memberships, with_views("attendance", "meetings", more=_TERMS) + "SELECT * FROM memberships"),
    "current_membership": (current_membership, with_views("attendance", "meetings", more=_TERMS + """, t AS (SELECT body, member_id, term_start FROM memberships
  WHERE term_start <= '1998-06-30' AND (term_end IS NULL OR term_end >= '1998-06-30'))""") + """SELECT *, (SELECT count(*) FROM t) AS total_count,
  ceil((SELECT count(*) FROM t) / 50)::BIGINT AS total_pages FROM t ORDER BY body, member_id LIMIT 50 OFFSET 50"""),
    "latest_membership": (latest_membership, with_views("attendance", "meetings", more=_TERMS) + """SELECT DISTINCT ON (member_id) member_id, body, term_start FROM memberships
  ORDER BY member_id, term_start DESC, body"""),
    "attendance_reconcile": (attendance_reconcile, with_views("attendance") + """SELECT CASE WHEN was IS NULL THEN 'insert' WHEN n.present IS NULL THEN 'retain' WHEN was = n.present THEN 'same' ELSE 'update' END AS action,
  count(*) AS rows, count(*) FILTER (coalesce(n.present, was)) AS present
  FROM (SELECT meeting_id, member_id, present AS was FROM attendance WHERE member_id % 3 <> 0) o
  FULL JOIN (SELECT meeting_id, member_id, present <> (member_id % 5 = 0) AS present FROM attendance WHERE member_id % 4 <> 0) n USING (meeting_id, member_id) GROUP BY 1"""),
    "revision_history": (revision_history, """SELECT o_custkey AS case_id, o_orderkey AS item_id, strftime(o_orderdate, '%Y-%m-%d') AS on_day,
  row_number() OVER w AS revision, date_diff('day', lag(o_orderdate) OVER w, o_orderdate) AS days_since
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"""),
    "status_crosstab": (status_crosstab, with_views("meetings", more="a AS (SELECT *, date_diff('day', meeting_date::DATE, DATE '2001-08-02') AS days FROM meetings)") + """SELECT
  CASE WHEN days <= 30 THEN '0-30' WHEN days <= 90 THEN '31-90' WHEN days <= 365 THEN '91-365' ELSE 'older' END AS age, jurisdiction_id, count(*) AS meetings,
  count(*) FILTER (status = 'complete') AS complete, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status IS NULL) AS pending FROM a GROUP BY 1, 2"""),
    "busiest_per_body": (busiest_per_body, with_views("meetings", more="days AS (SELECT body, meeting_date, count(*) AS meetings FROM meetings GROUP BY 1, 2)") + """SELECT body, meeting_date, meetings FROM days
  WHERE body IN (SELECT body FROM days GROUP BY 1 HAVING count(*) >= 10) QUALIFY row_number() OVER (PARTITION BY body ORDER BY meetings DESC, meeting_date) <= 3"""),
    "code_overlap": (code_overlap, with_views("meetings") + "SELECT meeting_date FROM meetings WHERE body = 'NATION_3' INTERSECT SELECT meeting_date FROM meetings WHERE body = 'NATION_4'"),
    "code_difference": (code_difference, with_views("meetings") + "SELECT meeting_date FROM meetings WHERE body = 'NATION_3' EXCEPT SELECT meeting_date FROM meetings WHERE body = 'NATION_4'"),
    "child_count_difference": (child_count_difference, with_views("meetings") + """SELECT meeting_date, coalesce(a.n, 0) AS left_n, coalesce(b.n, 0) AS right_n, coalesce(a.n, 0) - coalesce(b.n, 0) AS difference
  FROM (SELECT meeting_date, count(*) AS n FROM meetings WHERE body = 'NATION_3' GROUP BY 1) a
  FULL JOIN (SELECT meeting_date, count(*) AS n FROM meetings WHERE body = 'NATION_4' GROUP BY 1) b USING (meeting_date)"""),
    "data_inventory": (data_inventory, with_views("meetings") + """SELECT body, count(*) AS meetings, min(meeting_date) AS first_date, max(meeting_date) AS last_date,
  coalesce(sum(items), 0)::BIGINT AS items, count(*) FILTER (items IS NULL) AS without_items, round(sum(items) / count(items), 4) AS items_per_meeting
  FROM meetings LEFT JOIN (SELECT l_orderkey, count(*) AS items FROM lineitem GROUP BY 1) ON l_orderkey = meeting_id GROUP BY 1 HAVING count(*) >= 3"""),
}
