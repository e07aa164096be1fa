"""Accounting of processing, adjudication, samples, editorial and operational reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import events as E
from ..operators import relational as R
from ..operators.minutes import members_of, motions_of
from ..operators.resolution import repointed
from ..sources.civic import attendance, meetings, member_votes, table, with_views
from .quality import hash_rank

AS_OF = "1998-08-02"


def best_mentions(spark, d):
    """Of each meeting the line of the highest price, as 32-bit floats."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return R.keep_best(lines, ["l_orderkey"], "l_extendedprice", "l_linenumber", "l_partkey", "l_suppkey").select("l_orderkey", "l_linenumber", "l_partkey")


def item_spans(spark, d):
    """From each of a user's events to the next; the last one ends at the end of the year."""
    starts = table(spark, d, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("start")).distinct()
    return R.spans(starts, "user_id", "start", F.lit("2024-12-31"))


def keyword_items(spark, d):
    """Parts with any of the words in name or type."""
    return table(spark, d, "part").where(R.any_keyword(["p_name", "p_type"], ["blue", "PROMO", "st.el"])).select("p_partkey", "p_name", "p_type")


def truncated_search(spark, d):
    """Twenty hits, and whether there were more."""
    return R.truncated(table(spark, d, "part").where(F.col("p_name").contains("blue")).select("p_partkey", "p_name"), ["p_partkey"], 20)


def null_safe_missing(spark, d):
    """Languages and kinds of documents that no document with an even number has, nulls being equal."""
    docs = table(spark, d, "documents").select("doc_id", "lang", (F.col("n_chars") / 500).cast("int").alias("size"))
    return R.null_safe_anti(docs.where("doc_id % 2 = 1").select("lang", "size").distinct(), docs.where("doc_id % 2 = 0"), ["lang", "size"])


def compound_events(spark, d):
    """Turns of conversations as spans of text, grouped where the gap is at most 30."""
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("id"), (F.col("turn") * 60).alias("start"), (F.col("turn") * 60 + F.length("text") % 50).alias("end")).groupBy("id", "start").agg(F.max("end").alias("end"))
    return E.compound_groups(turns).groupBy("id", "group").agg(F.count(F.lit(1)).alias("events"), F.min("start").alias("start")).select("id", F.col("group").cast("long").alias("part"), "events", F.col("start").cast("long").alias("start"))


def event_plan(spark, d):
    """What to do with proposals: insert, replay, update or inconsistent."""
    have = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("payload"), F.lit(0.5).alias("confidence"))
    new = table(spark, d, "customer").select((F.col("c_custkey") % 900).alias("key"), (F.col("c_custkey") / 1000).cast("int").alias("payload"), (F.col("c_custkey") % 10 / 10).alias("confidence"))
    return E.planned(have, new, "key", "payload")


def repointed_edges(spark, d):
    """Edges after entities under 200 were merged by tens."""
    edges = table(spark, d, "lineitem").select((F.col("l_partkey") % 500).alias("subject"), F.col("l_suppkey").alias("object"))
    merged = spark.range(200).select("id", (F.col("id") - F.col("id") % 10).alias("survivor"))
    return repointed(edges, merged, ["subject", "object"])


def missing_targets(spark, d):
    """Labels whose target, of a kind that depends on the id, doesn't exist."""
    labels = table(spark, d, "labels").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "page").otherwise("conversation").alias("kind"))
    pages, conv = table(spark, d, "pages").select(F.col("page_id").alias("doc_id")), table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"))
    return labels.where("kind = 'page'").join(pages, "doc_id", "left_anti").unionByName(labels.where("kind = 'conversation'").join(conv, "doc_id", "left_anti"))


def numbered_words(spark, d):
    """Words of names with their place, from 1."""
    return table(spark, d, "part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("place", "word")).select("p_partkey", (F.col("place") + 1).cast("long").alias("place"), "word")


def first_contact(spark, d):
    """Of each customer the first supplier of the same nation or number: minima by either key, not a join of all."""
    supplier = table(spark, d, "supplier")
    near = supplier.groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.min("s_suppkey").alias("near"))
    same = supplier.select(F.col("s_suppkey").alias("c_custkey"), F.col("s_suppkey").alias("same"))
    return table(spark, d, "customer").select("c_custkey", "c_nationkey").join(near, "c_nationkey", "left").join(same, "c_custkey", "left").select("c_custkey", F.least("near", "same").alias("contact"))


def bodies_by_first_meeting(spark, d):
    """The ten bodies that met first."""
    m = meetings(spark, d).groupBy("body").agg(F.count(F.lit(1)).alias("meetings"), F.min("meeting_date").alias("first"))
    return m.orderBy("first", "body").limit(10)


def component_correlations(spark, d):
    """Correlation of the first component with each other one."""
    e = table(spark, d, "embeddings").select(F.col("embedding")[0].cast("double").alias("first"), F.posexplode("embedding").alias("component", "value"))
    return e.where("component > 0").groupBy("component").agg(F.round(F.corr("first", F.col("value").cast("double")), 5).alias("correlation"))


def processing_currency(spark, d):
    """Documents by what their receipts prove: a receipt must be of this very text, and of its last version."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "n_chars", "source")
    receipts = table(spark, d, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    eligible = F.when(F.trim("text") == "", "missing_text").when(F.col("source") == "src0", "unsupported").when(F.col("doc_id") % 10 == 3, "eligible_stale").otherwise("eligible_current")
    state = (
        F.when(F.col("eligible") == "eligible_stale", "source_stale")
        .when(F.col("eligible") != "eligible_current", "not_eligible")
        .when(F.col("quality").isNull(), "unproven_current: no receipt")
        .when(F.col("n_chars") % 7 == 0, "unproven_current: drift")
        .when(F.col("toxic") == 1, "failed_current")
        .otherwise("current_proven")
    )
    return docs.withColumn("eligible", eligible).join(receipts, "doc_id", "left").groupBy("eligible", state.alias("state")).agg(F.count(F.lit(1)).alias("documents"))


def blocked_groups(spark, d):
    """Meetings without a status by body: how many are, and aren't, mentioned by lines of type R."""
    open_ = meetings(spark, d).where("status is null").select("meeting_id", "body")
    held = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("meeting_id")).distinct().withColumn("relevant", F.lit(True))
    j = open_.join(held, "meeting_id", "left")
    return j.groupBy("body").agg(F.count(F.lit(1)).alias("unparented"), F.count_if(F.col("relevant")).alias("relevant"), F.count_if(F.col("relevant").isNull()).alias("unrelated"))


def weighted_quotas(spark, d):
    """Seats of a sample of 200 by source, weighted by the share of labelled documents, one at least, capped by what there is; the rest to the largest."""
    docs, labels = table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels").select("doc_id").distinct().withColumn("w", F.lit(1))
    cells = docs.join(labels, "doc_id", "left").groupBy("source").agg(F.count(F.lit(1)).alias("available"), F.count("w").alias("weight"))
    every = Window.partitionBy()  # one row a source
    base = cells.withColumn("quota", F.least(F.col("available"), F.greatest(F.lit(1), F.floor(200 * F.col("weight") / F.sum("weight").over(every)))))
    spare = F.col("available") - F.col("quota")
    before = F.coalesce(F.sum(spare).over(Window.orderBy(F.desc("available"), "source").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.greatest(F.lit(0), 200 - F.sum("quota").over(every))
    return base.withColumn("quota_all", F.col("quota") + F.least(spare, F.greatest(F.lit(0), left - before))).select("source", "available", "weight", F.col("quota_all").cast("long").alias("quota"))


def audit_sample(spark, d):
    """Five rows of each class, all of the rare ones, and then twenty more of all, by hash."""
    docs = table(spark, d, "documents").select("doc_id", F.concat_ws("/", "lang", "source").alias("class"))
    w = Window.partitionBy("class")
    ranked = docs.withColumn("h", hash_rank("7", F.col("doc_id"))).withColumn("of", F.count(F.lit(1)).over(w)).withColumn("rank", F.row_number().over(w.orderBy("h", "doc_id")))
    ranked = ranked.withColumn("why", F.when(F.col("of") <= 8, "rare").when(F.col("rank") <= 5, "class"))
    rest = ranked.where("why is null").orderBy("h", "doc_id").limit(20).withColumn("why", F.lit("fill"))
    return ranked.where("why is not null").unionByName(rest).select("doc_id", "class", "why")


def discovered_names(spark, d):
    """Pairs of words that begin in upper case, once a document: documents, sources, and at most three places, unless known."""
    docs = table(spark, d, "documents")
    pairs = F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"([A-Z][a-z]+ [A-Z][a-z]+)"), F.lit(1)))
    seen = docs.select("doc_id", "source", F.explode(pairs).alias("name"))
    known = table(spark, d, "nation").select(F.col("n_name").alias("name"))
    places = F.array_join(F.slice(F.array_sort(F.collect_set("doc_id")), 1, 3), ",")
    return seen.join(known, "name", "left_anti").groupBy("name").agg(F.count(F.lit(1)).alias("documents"), F.count_distinct("source").alias("sources"), places.alias("places"))


def merged_texts(spark, d):
    """Title and text put together, unless the text repeats the title."""
    p = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("title"), F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit(" "), "p_type")).when(F.col("p_partkey") % 3 == 1, F.col("p_type")).otherwise("").alias("text"))
    repeats = (F.trim("text") == "") | F.startswith(F.trim("text"), F.left(F.trim("title"), F.lit(80)))
    return p.select("p_partkey", F.when(repeats, F.col("title")).otherwise(F.concat_ws("\n", "title", "text")).alias("whole"))


def hearings(spark, d):
    """Meetings to come by the first class that their kind and body have."""
    kind = F.lower(F.col("meeting_type"))
    label = F.coalesce(*(F.when(F.contains(kind, F.lit(k)), F.lit(v)) for k, v in (("urgent", "urgent hearing"), ("high", "hearing"), ("medium", "study session"))))
    m = meetings(spark, d).where(F.col("meeting_date") > AS_OF).where(F.col("body").rlike("[13579]$"))
    return m.select("body", "meeting_date", label.alias("label")).where("label is not null").distinct()


def audience(spark, d):
    """Active subscribers of a topic, and always the owners."""
    active = table(spark, d, "events").where("event_type = 'signup'").select("user_id").join(table(spark, d, "events").where("event_type = 'click'").select("user_id"), "user_id", "left_semi")
    return active.union(spark.range(1, 6).select(F.col("id").alias("user_id"))).distinct()


def abstention_review(spark, d):
    """Meetings of bodies of a prefix with those who were present but abstained, by meeting."""
    votes = member_votes(spark, d).where("vote = 'abstain'").withColumnRenamed("motion_id", "meeting_id")
    there = attendance(spark, d).where("present").select("meeting_id", "member_id")
    m = meetings(spark, d).where(F.col("body").startswith("NATION_1")).select("meeting_id", "body", "meeting_date")
    listed = votes.join(there, ["meeting_id", "member_id"], "left_semi").join(m, "meeting_id").groupBy("meeting_id", "body", "meeting_date")
    return listed.agg(F.array_join(F.transform(F.array_sort(F.collect_list("member_id")), lambda i: i.cast("string")), ",").alias("members"))


def member_profiles(spark, d):
    """Of every member the latest vote, totals, and how often with the majority of the others is left to member_vote_stats."""
    v = member_votes(spark, d).join(meetings(spark, d).select(F.col("meeting_id").alias("motion_id"), "meeting_date", "body"), "motion_id")
    return v.groupBy("member_id").agg(
        F.count(F.lit(1)).alias("votes"), F.count_distinct("body").alias("bodies"), F.min("meeting_date").alias("since"), F.max(F.struct("meeting_date", "motion_id", "vote")).alias("last")
    ).select("member_id", "votes", "bodies", "since", F.col("last.meeting_date").alias("last_date"), F.col("last.motion_id").alias("last_motion"), F.col("last.vote").alias("last_vote"))


def case_votes(spark, d):
    """Votes stored by case number in upper case: the last item of a case wins."""
    o = table(spark, d, "orders").select(F.concat(F.lit(" z-"), (F.col("o_custkey") % 300).cast("string"), F.lit(" ")).alias("raw"), "o_orderkey", "o_orderstatus")
    return o.groupBy(F.upper(F.trim("raw")).alias("case_number")).agg(F.max_by("o_orderstatus", "o_orderkey").alias("outcome"), F.max("o_orderkey").alias("item"), F.count(F.lit(1)).alias("items"))


def retention(spark, d):
    """Pages by family of host: bytes, and how many are older than so many days, cumulatively."""
    day = F.date_add(F.to_date(F.lit("2024-01-01")), -(F.col("page_id") % 120).cast("int"))
    p = table(spark, d, "pages").select(F.regexp_extract("url", r"^[a-z]+://([^/]+)", 1).alias("host"), F.length("html").alias("size"), F.datediff(F.to_date(F.lit("2024-01-01")), day).alias("age"))
    return p.groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.sum("size").alias("chars"), *(F.count_if(F.col("age") > n).alias(f"over_{n}") for n in (7, 30, 90)))


def largest_pages(spark, d):
    return table(spark, d, "pages").select("page_id", "url", F.length("html").cast("long").alias("chars")).orderBy(F.desc("chars"), "page_id").limit(20)


def dated_metadata(spark, d):
    """Rows within a range of dates; those whose date can't be read are dropped."""
    raw = F.when(F.col("o_orderkey") % 5 == 0, F.lit("n/a")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    o = table(spark, d, "orders").select("o_orderkey", F.try_to_date(raw, "yyyy-MM-dd").alias("day"))
    return o.where(F.col("day").between("1996-01-01", "1996-12-31")).select("o_orderkey", F.date_format("day", "yyyy-MM-dd").alias("day"))


def stuck_meetings(spark, d):
    """Meetings in progress whose last attempt is more than a day before the last one of all, or that have none."""
    tried = table(spark, d, "events").groupBy(F.col("user_id").alias("meeting_id")).agg(F.max("ts").alias("tried"))
    last = tried.agg(F.max("tried").alias("now"))
    m = table(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("meeting_id"))
    j = m.join(tried, "meeting_id", "left").crossJoin(F.broadcast(last))  # one row
    return j.where(F.col("tried").isNull() | (F.col("tried") <= F.col("now") - F.expr("INTERVAL 24 HOURS"))).select("meeting_id", F.coalesce(F.date_format("tried", "yyyy-MM-dd HH:mm"), F.lit("never")).alias("tried"))


def upcoming(spark, d):
    """Meetings by body in the month after the report's date."""
    m = meetings(spark, d).where((F.col("meeting_date") > "1998-07-01") & (F.col("meeting_date") <= AS_OF))
    return m.groupBy("body").agg(F.count(F.lit(1)).alias("meetings"), F.min("meeting_date").alias("next"))


def phase_runs(spark, d):
    """Of each day, local to seven hours west, whether a phase ran already when it was asked for again."""
    day = F.date_format(F.col("ts") - F.expr("INTERVAL 7 HOURS"), "yyyy-MM-dd")
    e = table(spark, d, "events").select("event_type", day.alias("day"), "event_id", "ts")
    w = Window.partitionBy("event_type", "day").orderBy("ts", "event_id")
    return e.select("event_type", "day", (F.row_number().over(w) == 1).alias("runs")).groupBy("event_type", "day").agg(F.count_if("runs").alias("runs"), F.count_if(~F.col("runs")).alias("skipped"))


def parent_gate(spark, d):
    """Child rows that may be written, and those held back since their parent isn't there yet."""
    parents = table(spark, d, "part").where("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("l_partkey"), F.lit(True).alias("there"))
    j = table(spark, d, "lineitem").select("l_partkey", "l_linestatus").join(parents, "l_partkey", "left")
    return j.groupBy("l_linestatus", F.when(F.col("there"), "write").otherwise("hold").alias("gate")).agg(F.count(F.lit(1)).alias("rows"))


def replaced_meetings(spark, d):
    """Items after meetings of a body were replaced: theirs are the new ones, unless the new set is empty."""
    old = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("meeting_id"), F.col("l_linenumber").alias("item"), F.lit("old").alias("version"))
    new = old.where("meeting_id % 10 = 1 and item <= 2").withColumn("version", F.lit("new"))
    kept = old.join(new.select("meeting_id").distinct(), "meeting_id", "left_anti")
    return kept.unionByName(new).groupBy("version").agg(F.count_distinct("meeting_id").alias("meetings"), F.count(F.lit(1)).alias("items"))


def case_events(spark, d):
    """Events appended to cases: those not there yet, once each."""
    have = table(spark, d, "orders").where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("case_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.col("o_orderstatus").alias("action"))
    new = table(spark, d, "orders").where("o_orderkey % 3 <> 0").select(F.col("o_custkey").alias("case_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.col("o_orderstatus").alias("action"))
    return new.distinct().join(have, ["case_id", "day", "action"], "left_anti").groupBy("case_id").agg(F.count(F.lit(1)).alias("appended"), F.max("day").alias("last_day"))


def topic_reports(spark, d):
    """The latest vector of each label, and how many it has."""
    e = table(spark, d, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("reports"), F.max("vec_id").alias("latest"))
    return e.select("label", "reports", "latest")


def tag_counts(spark, d):
    """Users by what they did, and how many did all of it."""
    tags = table(spark, d, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), "+").alias("tags"))
    return tags.groupBy("tags").agg(F.count(F.lit(1)).alias("subscribers"))


def inventory(spark, d):
    """Rows, keys and ranges of the tables: one report a row."""
    def report(name, df, key, day=None):
        at = F.date_format(F.col(day), "yyyy-MM-dd") if day else F.lit(None).cast("string")
        return df.agg(F.lit(name).alias("report"), F.count(F.lit(1)).alias("rows"), F.count_distinct(key).alias("keys"), F.min(at).alias("first"), F.max(at).alias("last"))

    frames = [("meetings", "orders", "o_orderkey", "o_orderdate"), ("items", "lineitem", "l_orderkey", None), ("members", "supplier", "s_suppkey", None), ("bodies", "nation", "n_nationkey", None), ("entities", "part", "p_name", None), ("views", "events", "user_id", "ts"), ("documents", "documents", "doc_id", None)]
    reports = [report(name, table(spark, d, t), key, day) for name, t, key, day in frames]
    out = reports[0]
    for r in reports[1:]:
        out = out.unionByName(r)
    return out


def _minutes_texts(spark, d):
    """Minutes of each meeting: three members of the body present, one absent, and a motion, in one of three forms."""
    who = F.array(*map(F.lit, ("Ann Lee", "Bob Stone", "Cy Marsh", "Dee Fox", "Eve Oak")))
    m = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    name = lambda k: F.element_at(who, ((F.col("id") + k) % 5 + 1).cast("int"))
    form = F.col("id") % 3
    present = F.when(form == 0, F.concat(F.lit("Members Present: "), F.concat_ws(", ", name(0), name(1), name(2)))).otherwise(F.concat(F.lit("Board Members Present\n"), name(0), F.lit(", Chair\nCouncilmember "), name(1), F.lit("\n"), name(2)))
    absent = F.concat(F.lit("\nMembers Absent: "), name(3), F.lit("\nStaff Present: Hal Roe\n"))
    moved = F.concat(F.lit("Mr. "), name(1), F.when(form == 1, " moved to ").otherwise(" made a motion to "), F.lit("approve item 4. The motion was seconded by Ms. "), name(2), F.lit(". "))
    end = F.when(form == 0, F.lit("Motion passed unanimously.")).when(form == 1, F.concat(F.lit("Motion carried 2-1, Councilmember "), F.split_part(name(2), F.lit(" "), F.lit(2)), F.lit(" dissenting."))).otherwise("Motion failed 1-2.")
    return m.select("id", F.concat(F.lit("MINUTES\n"), present, absent, moved, end).alias("text"))


def minutes_members(spark, d):
    return members_of(_minutes_texts(spark, d), "id", "text")


def minutes_motions(spark, d):
    names = lambda c: F.concat_ws(",", c)
    return motions_of(_minutes_texts(spark, d), "id", "text").select("id", "motion", "mover", "seconder", "action", "result", "unanimous", names("yes").alias("yes"), names("no").alias("no"))


_WHO = "who AS (SELECT ['Ann Lee', 'Bob Stone', 'Cy Marsh', 'Dee Fox', 'Eve Oak'] AS w), m AS (SELECT o_orderkey AS id, w[o_orderkey % 5 + 1] AS a, w[(o_orderkey + 1) % 5 + 1] AS b, w[(o_orderkey + 2) % 5 + 1] AS c, w[(o_orderkey + 3) % 5 + 1] AS x FROM orders, who)"

PLANS = {
    "best_mentions": (best_mentions, "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice::FLOAT DESC, l_linenumber, l_partkey, l_suppkey) = 1"),
    "item_spans": (item_spans, """WITH s AS (SELECT DISTINCT user_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS start FROM events)
  SELECT user_id, start, coalesce(lead(start) OVER (PARTITION BY user_id ORDER BY start), '2024-12-31') AS span_end FROM s"""),
    "keyword_items": (keyword_items, "SELECT p_partkey, p_name, p_type FROM part WHERE contains(lower(p_name || ' ' || p_type), 'blue') OR contains(lower(p_name || ' ' || p_type), 'promo') OR contains(lower(p_name || ' ' || p_type), 'st.el')"),
    "truncated_search": (truncated_search, "SELECT p_partkey, p_name, count(*) OVER () > 20 AS has_more FROM part WHERE contains(p_name, 'blue') ORDER BY p_partkey LIMIT 20"),
    "null_safe_missing": (null_safe_missing, """WITH k AS (SELECT doc_id, lang, (n_chars // 500)::INT AS size FROM documents)
  SELECT DISTINCT lang, size FROM k WHERE doc_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM k o WHERE o.doc_id % 2 = 0 AND o.lang IS NOT DISTINCT FROM k.lang AND o.size IS NOT DISTINCT FROM k.size)"""),
    "compound_events": (compound_events, """WITH t AS (SELECT conv_id AS id, turn * 60 AS start, max(turn * 60 + length(text) % 50) AS e FROM conversations GROUP BY 1, 2),
  g AS (SELECT *, coalesce(start - lag(e) OVER (PARTITION BY id ORDER BY start) > 30, true)::INT AS b FROM t), r AS (SELECT *, sum(b) OVER (PARTITION BY id ORDER BY start) AS part FROM g)
  SELECT id, part::BIGINT AS part, count(*) AS events, min(start)::BIGINT AS start FROM r GROUP BY id, part"""),
    "event_plan": (event_plan, """WITH p AS (SELECT c_custkey % 900 AS key, count(DISTINCT c_custkey // 1000) AS n, max(((c_custkey % 10) / 10.0)::FLOAT) AS confidence FROM customer GROUP BY 1)
  SELECT key, CASE WHEN n > 1 THEN 'inconsistent' WHEN s_suppkey IS NULL THEN 'insert' WHEN confidence > 0.5::FLOAT THEN 'update' ELSE 'replay' END AS action FROM p LEFT JOIN supplier ON s_suppkey = key"""),
    "repointed_edges": (repointed_edges, """WITH e AS (SELECT l_partkey % 500 AS a, l_suppkey AS b FROM lineitem), r AS (SELECT CASE WHEN a < 200 THEN a - a % 10 ELSE a END AS subject, CASE WHEN b < 200 THEN b - b % 10 ELSE b END AS object FROM e)
  SELECT DISTINCT subject, object FROM r WHERE subject <> object"""),
    "missing_targets": (missing_targets, """SELECT doc_id, 'page' AS kind FROM labels WHERE doc_id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM pages WHERE page_id = doc_id)
  UNION ALL SELECT doc_id, 'conversation' FROM labels WHERE doc_id % 2 <> 0 AND NOT EXISTS (SELECT 1 FROM conversations WHERE conv_id = doc_id)"""),
    "numbered_words": (numbered_words, "SELECT p_partkey, generate_subscripts(string_split(p_name, ' '), 1)::BIGINT AS place, unnest(string_split(p_name, ' ')) AS word FROM part"),
    "first_contact": (first_contact, """SELECT c_custkey, least(near, s_suppkey) AS contact FROM customer LEFT JOIN (SELECT s_nationkey AS k, min(s_suppkey) AS near FROM supplier GROUP BY 1) ON k = c_nationkey LEFT JOIN supplier ON s_suppkey = c_custkey"""),
    "bodies_by_first_meeting": (bodies_by_first_meeting, with_views("meetings") + "SELECT body, count(*) AS meetings, min(meeting_date) AS first FROM meetings GROUP BY 1 ORDER BY min(meeting_date), body LIMIT 10"),
    "component_correlations": (component_correlations, """SELECT component::INT AS component, round(corr(value::DOUBLE, first::DOUBLE), 5) AS correlation
  FROM (SELECT embedding[1] AS first, unnest(embedding) AS value, generate_subscripts(embedding, 1) - 1 AS component FROM embeddings) WHERE component > 0 GROUP BY 1"""),
    "processing_currency": (processing_currency, """WITH r AS (SELECT doc_id, max(toxic) AS toxic, min(quality) AS quality FROM labels GROUP BY 1),
  e AS (SELECT *, CASE WHEN trim(coalesce(text, ''), ' ') = '' THEN 'missing_text' WHEN source = 'src0' THEN 'unsupported' WHEN doc_id % 10 = 3 THEN 'eligible_stale' ELSE 'eligible_current' END AS eligible FROM documents LEFT JOIN r USING (doc_id))
  SELECT eligible, CASE WHEN eligible = 'eligible_stale' THEN 'source_stale' WHEN eligible <> 'eligible_current' THEN 'not_eligible' WHEN quality IS NULL THEN 'unproven_current: no receipt'
    WHEN n_chars % 7 = 0 THEN 'unproven_current: drift' WHEN toxic = 1 THEN 'failed_current' ELSE 'current_proven' END AS state, count(*) AS documents FROM e GROUP BY 1, 2"""),
    "blocked_groups": (blocked_groups, with_views("meetings") + """SELECT body, count(*) AS unparented, count(*) FILTER (r) AS relevant, count(*) FILTER (NOT r) AS unrelated
  FROM (SELECT body, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = meeting_id AND l_returnflag = 'R') AS r FROM meetings WHERE status IS NULL) GROUP BY 1"""),
    "weighted_quotas": (weighted_quotas, """WITH c AS (SELECT source, count(*) AS available, count(l.doc_id) AS weight FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY 1),
  q AS (SELECT *, least(available, greatest(1, floor(200 * weight / sum(weight) OVER ())))::BIGINT AS quota FROM c),
  b AS (SELECT *, coalesce(sum(available - quota) OVER (ORDER BY available DESC, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, greatest(0, 200 - sum(quota) OVER ()) AS spare FROM q)
  SELECT source, available, weight, (quota + least(available - quota, greatest(0, spare - before)))::BIGINT AS quota FROM b"""),
    "audit_sample": (audit_sample, r"""WITH r AS (SELECT doc_id, concat_ws('/', lang, source) AS class, sha256('7'::BLOB || '\x00'::BLOB || doc_id::VARCHAR::BLOB) AS h FROM documents),
  k AS (SELECT *, count(*) OVER (PARTITION BY class) AS n, row_number() OVER (PARTITION BY class ORDER BY h, doc_id) AS rank FROM r), y AS (SELECT *, CASE WHEN n <= 8 THEN 'rare' WHEN rank <= 5 THEN 'class' END AS why FROM k)
  SELECT doc_id, class, why FROM y WHERE why IS NOT NULL UNION ALL (SELECT doc_id, class, 'fill' FROM y WHERE why IS NULL ORDER BY h, doc_id LIMIT 20)"""),
    "discovered_names": (discovered_names, """WITH s AS (SELECT doc_id, source, unnest(list_distinct(regexp_extract_all(coalesce(text, ''), '([A-Z][a-z]+ [A-Z][a-z]+)', 1))) AS name FROM documents)
  SELECT name, count(*) AS documents, count(DISTINCT source) AS sources, array_to_string(list_sort(list(DISTINCT doc_id))[1:3], ',') AS places FROM s WHERE name NOT IN (SELECT n_name FROM nation) GROUP BY 1"""),
    "merged_texts": (merged_texts, """WITH t AS (SELECT p_partkey, p_name AS title, CASE p_partkey % 3 WHEN 0 THEN p_name || ' ' || p_type WHEN 1 THEN p_type ELSE '' END AS text FROM part)
  SELECT p_partkey, CASE WHEN text = '' OR starts_with(text, left(title, 80)) THEN title ELSE title || chr(10) || text END AS whole FROM t"""),
    "hearings": (hearings, with_views("meetings", more=f"""h AS (SELECT DISTINCT body, meeting_date, CASE WHEN meeting_type ILIKE '%urgent%' THEN 'urgent hearing' WHEN meeting_type ILIKE '%high%' THEN 'hearing' WHEN meeting_type ILIKE '%medium%' THEN 'study session' END AS label
  FROM meetings WHERE meeting_date > '{AS_OF}' AND regexp_matches(body, '[13579]$'))""") + "SELECT * FROM h WHERE label IS NOT NULL"),
    "audience": (audience, "SELECT DISTINCT user_id FROM events WHERE event_type = 'signup' AND user_id IN (SELECT user_id FROM events WHERE event_type = 'click') UNION SELECT range FROM range(1, 6)"),
    "abstention_review": (abstention_review, with_views("member_votes", "attendance", "meetings") + """SELECT meeting_id, body, meeting_date, string_agg(member_id::VARCHAR, ',' ORDER BY member_id) AS members
  FROM (SELECT motion_id AS meeting_id, member_id FROM member_votes WHERE vote = 'abstain') JOIN (SELECT * FROM attendance WHERE present) USING (meeting_id, member_id) JOIN meetings USING (meeting_id) WHERE starts_with(body, 'NATION_1') GROUP BY 1, 2, 3"""),
    "member_profiles": (member_profiles, with_views("member_votes", "meetings") + """SELECT member_id, count(*) AS votes, count(DISTINCT body) AS bodies, min(meeting_date) AS since, max(meeting_date) AS last_date,
  last(motion_id ORDER BY meeting_date, motion_id) AS last_motion, last(vote ORDER BY meeting_date, motion_id) AS last_vote FROM member_votes JOIN meetings ON meeting_id = motion_id GROUP BY 1"""),
    "case_votes": (case_votes, "SELECT 'Z-' || (o_custkey % 300) AS case_number, last(o_orderstatus ORDER BY o_orderkey) AS outcome, max(o_orderkey) AS item, count(*) AS items FROM orders GROUP BY 1"),
    "retention": (retention, """SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, count(*) AS pages, sum(length(html))::BIGINT AS chars, count(*) FILTER (page_id % 120 > 7) AS over_7,
  count(*) FILTER (page_id % 120 > 30) AS over_30, count(*) FILTER (page_id % 120 > 90) AS over_90 FROM pages GROUP BY 1"""),
    "largest_pages": (largest_pages, "SELECT page_id, url, length(html)::BIGINT AS chars FROM pages ORDER BY chars DESC, page_id LIMIT 20"),
    "dated_metadata": (dated_metadata, "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderdate::DATE BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'"),
    "stuck_meetings": (stuck_meetings, """WITH t AS (SELECT user_id, max(ts) AS tried FROM events GROUP BY 1) SELECT o_orderkey AS meeting_id, coalesce(strftime(tried, '%Y-%m-%d %H:%M'), 'never') AS tried
  FROM orders LEFT JOIN t ON user_id = o_orderkey WHERE o_orderstatus = 'O' AND (tried IS NULL OR tried <= (SELECT max(ts) FROM events) - INTERVAL 24 HOURS)"""),
    "upcoming": (upcoming, with_views("meetings") + f"SELECT body, count(*) AS meetings, min(meeting_date) AS next FROM meetings WHERE meeting_date > '1998-07-01' AND meeting_date <= '{AS_OF}' GROUP BY 1"),
    "phase_runs": (phase_runs, "SELECT event_type, strftime(ts - INTERVAL 7 HOURS, '%Y-%m-%d') AS day, 1::BIGINT AS runs, count(*) - 1 AS skipped FROM events GROUP BY 1, 2"),
    "parent_gate": (parent_gate, "SELECT l_linestatus, CASE WHEN p_partkey IS NULL THEN 'hold' ELSE 'write' END AS gate, count(*) AS rows FROM lineitem LEFT JOIN (SELECT p_partkey FROM part WHERE p_partkey % 4 <> 0) ON p_partkey = l_partkey GROUP BY 1, 2"),
    "replaced_meetings": (replaced_meetings, """WITH n AS (SELECT l_orderkey FROM lineitem WHERE l_orderkey % 10 = 1 AND l_linenumber <= 2), o AS (SELECT l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM n))
  SELECT 'new' AS version, count(DISTINCT l_orderkey) AS meetings, count(*) AS items FROM n UNION ALL SELECT 'old', count(DISTINCT l_orderkey), count(*) FROM o"""),
    "case_events": (case_events, """WITH h AS (SELECT DISTINCT o_custkey, o_orderdate::DATE AS day, o_orderstatus FROM orders WHERE o_orderkey % 3 = 0), n AS (SELECT DISTINCT o_custkey, o_orderdate::DATE AS day, o_orderstatus FROM orders WHERE o_orderkey % 3 <> 0)
  SELECT o_custkey AS case_id, count(*) AS appended, strftime(max(day), '%Y-%m-%d') AS last_day FROM (SELECT * FROM n EXCEPT SELECT * FROM h) GROUP BY 1"""),
    "topic_reports": (topic_reports, "SELECT label, count(*) AS reports, max(vec_id) AS latest FROM embeddings GROUP BY 1"),
    "tag_counts": (tag_counts, "SELECT tags, count(*) AS subscribers FROM (SELECT user_id, string_agg(DISTINCT event_type, '+' ORDER BY event_type) AS tags FROM events GROUP BY 1) GROUP BY 1"),
    "inventory": (inventory, """SELECT 'meetings' AS report, count(*) AS rows, count(DISTINCT o_orderkey) AS keys, strftime(min(o_orderdate), '%Y-%m-%d') AS first, strftime(max(o_orderdate), '%Y-%m-%d') AS last FROM orders
  UNION ALL SELECT 'items', count(*), count(DISTINCT l_orderkey), NULL, NULL FROM lineitem UNION ALL SELECT 'members', count(*), count(DISTINCT s_suppkey), NULL, NULL FROM supplier
  UNION ALL SELECT 'bodies', count(*), count(DISTINCT n_nationkey), NULL, NULL FROM nation UNION ALL SELECT 'entities', count(*), count(DISTINCT p_name), NULL, NULL FROM part
  UNION ALL SELECT 'views', count(*), count(DISTINCT user_id), strftime(min(ts), '%Y-%m-%d'), strftime(max(ts), '%Y-%m-%d') FROM events UNION ALL SELECT 'documents', count(*), count(DISTINCT doc_id), NULL, NULL FROM documents"""),
    "minutes_members": (minutes_members, f"""WITH {_WHO}, u AS (SELECT id, a AS name, CASE WHEN id % 3 > 0 THEN 'Chair' END AS office, true AS present FROM m UNION ALL SELECT id, b, CASE WHEN id % 3 > 0 THEN 'Councilmember' END, true FROM m
  UNION ALL SELECT id, c, NULL, true FROM m UNION ALL SELECT id, x, NULL, false FROM m) SELECT id, name, lower(name) AS normalized_name, office, present FROM u"""),
    "minutes_motions": (minutes_motions, f"""WITH {_WHO} SELECT id, 1::INT AS motion, b AS mover, c AS seconder, 'approve item 4' AS action, CASE id % 3 WHEN 2 THEN 'failed' ELSE 'approved' END AS result, id % 3 = 0 AS unanimous,
  CASE id % 3 WHEN 0 THEN a || ',' || b || ',' || c WHEN 1 THEN a || ',' || b ELSE '' END AS yes, CASE id % 3 WHEN 1 THEN c ELSE '' END AS no FROM m"""),
}
