"""Event extraction, attribution, page views and windows over time."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import events as E
from ..operators.relational import runs, span_join
from ..sources.civic import meetings, table, with_views
from .text import _phrases


def _minutes(spark, d):
    """A line of minutes for each meeting, some of them guarded."""
    m = _phrases(meetings(spark, d))
    guard = F.when(F.col("meeting_id") % 6 == 0, "Item might be approved later. ").otherwise("")
    case = F.when(F.col("meeting_id") % 4 == 0, F.concat(F.lit(" in case Z-"), F.lpad((F.col("meeting_id") % 1000).cast("string"), 3, "0"))).otherwise("")
    return m.withColumn("minutes", F.concat(guard, "action", case, F.lit(".")))


def extracted_events(spark, d):
    return E.extract_events(_minutes(spark, d), "meeting_id", "minutes").select("id", "start", "end", "verb", "kind", "outcome", "case_number")


def event_outcomes(spark, d):
    """Outcomes by event type; an outcome's base takes in its qualified forms."""
    e = E.extract_events(_minutes(spark, d), "meeting_id", "minutes")
    return e.groupBy("kind", F.regexp_extract("outcome", "^([a-z]+)", 1).alias("base")).agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("case_number").isNotNull()).alias("with_case"))


def event_attribution(spark, d):
    """Events to the agenda item whose span of text holds them: views between a user's errors."""
    e = table(spark, d, "events")
    starts = e.where("event_type = 'signup'").groupBy("user_id", "ts").agg(F.min("event_id").alias("session"))
    views = e.where("event_type = 'view'").select("event_id", "user_id", "ts")
    return span_join(views, starts, "user_id", "ts", "ts", "session").select("event_id", "user_id", F.col("span_session").alias("session"))


def event_runs(spark, d):
    """Runs of a user's events that follow each other within six hours."""
    e = table(spark, d, "events").groupBy("user_id", "ts").agg(F.count(F.lit(1)).alias("n"))
    at = F.col("ts").cast("timestamp")
    gap = F.unix_micros(at) - F.unix_micros(F.lag(at).over(Window.partitionBy("user_id").orderBy("ts"))) > 6 * 3600 * 1_000_000
    r = runs(e, ["user_id"], "ts", gap)
    return r.groupBy("user_id", "run").agg(F.sum("n").alias("events")).groupBy("user_id").agg(F.count(F.lit(1)).alias("runs"), F.max("events").alias("longest"))


def trending(spark, d):
    """The five users most viewed in the day before the last event."""
    e = table(spark, d, "events").where("event_type = 'view'")
    last = e.agg(F.max("ts").alias("last"))
    return e.crossJoin(F.broadcast(last)).where(F.col("ts") > F.col("last") - F.expr("INTERVAL 24 HOURS")).groupBy("user_id").agg(F.count(F.lit(1)).alias("views")).orderBy(F.desc("views"), "user_id").limit(5)


def view_counts(spark, d):
    return table(spark, d, "events").where("event_type = 'view'").groupBy("user_id").agg(F.count(F.lit(1)).alias("views"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last_view"))


def daily_windows(spark, d):
    """Tumbling days by event type."""
    return table(spark, d, "events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 2).alias("amount")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "events", "amount")


def sliding_windows(spark, d):
    """Views in windows of a day that begin every six hours."""
    e = table(spark, d, "events").where("event_type = 'view'")
    w = e.groupBy(F.window("ts", "24 hours", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("views"))
    return w.select(F.date_format("w.start", "yyyy-MM-dd HH").alias("start"), "views")


def rate_limited(spark, d):
    """Events of a user and type that are at least the third within ten hours."""
    e = table(spark, d, "events").withColumn("second", F.unix_seconds(F.col("ts").cast("timestamp")))
    w = Window.partitionBy("user_id", "event_type").orderBy("second").rangeBetween(-36000, 0)
    return e.withColumn("recent", F.count(F.lit(1)).over(w)).where("recent >= 3").groupBy("event_type").agg(F.count(F.lit(1)).alias("limited"))


def unviewed(spark, d):
    """Suppliers whom nobody viewed or clicked."""
    e = table(spark, d, "events").where(F.col("event_type").isin("view", "click")).select(F.col("user_id").alias("s_suppkey"))
    return table(spark, d, "supplier").join(e, "s_suppkey", "left_anti").select("s_suppkey", "s_name")


def event_properties(spark, d):
    """Properties in JSON, malformed ones being empty."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, d, "events").groupBy((k % 10).alias("k")).agg(F.count(F.lit(1)).alias("events"), F.round(F.avg("value"), 4).alias("mean_value"))


def conversation_turns(spark, d):
    """First and last turn of each conversation, and how often the role changes."""
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", F.length("text").cast("long").alias("chars")).distinct()
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "chars")
    t = c.withColumn("change", (F.col("role") != F.lag("role").over(w)).cast("int"))
    return t.groupBy("conv_id").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.coalesce(F.sum("change"), F.lit(0)).alias("changes"), F.sum("chars").alias("chars"))


def linked_participants(spark, d):
    """Names in meetings linked to entities."""
    m = meetings(spark, d).select(F.col("meeting_id").alias("id"), F.array(F.concat(F.lit("cold "), F.element_at(F.array(*map(F.lit, ("bolt", "gear", "rod"))), (F.col("meeting_id") % 3 + 1).cast("int")))).alias("names"))
    e = table(spark, d, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("entity_id"))
    return E.participants(m, "names", e).select("id", "name", "entity_id", F.round(F.col("confidence").cast("double"), 3).alias("confidence"))


_ACT = """x AS (SELECT meeting_id, CASE WHEN meeting_id % 6 = 0 THEN 'Item might be approved later. ' ELSE '' END AS guard,
  CASE status WHEN 'complete' THEN 'approved' WHEN 'failed' THEN 'denied' ELSE 'continued' END AS v0, status = 'complete' AND meeting_id % 11 = 0 AS amended,
  CASE WHEN meeting_id % 4 = 0 THEN 'Z-' || lpad((meeting_id % 1000)::VARCHAR, 3, '0') END AS case_number FROM meetings),
 ev AS (SELECT meeting_id AS id, (length(guard) + length('Motion was '))::INT AS start, CASE WHEN amended THEN 'approved as amended' ELSE v0 END AS verb,
  CASE v0 WHEN 'approved' THEN 'decision.approval' WHEN 'denied' THEN 'decision.denial' ELSE 'decision.continuation' END AS kind,
  CASE WHEN amended THEN 'approved_as_amended' ELSE v0 END AS outcome, case_number FROM x)"""

PLANS = {
    "extracted_events": (extracted_events, with_views("meetings", more=_ACT) + "SELECT id, start, start + length(verb)::INT AS \"end\", verb, kind, outcome, case_number FROM ev"),
    "event_outcomes": (event_outcomes, with_views("meetings", more=_ACT) + "SELECT kind, regexp_extract(outcome, '^([a-z]+)', 1) AS base, count(*) AS events, count(case_number) AS with_case FROM ev GROUP BY 1, 2"),
    "event_attribution": (event_attribution, """WITH s AS (SELECT user_id, ts, min(event_id) AS session FROM events WHERE event_type = 'signup' GROUP BY 1, 2)
  SELECT e.event_id, e.user_id, s.session FROM events e ASOF LEFT JOIN s ON e.user_id = s.user_id AND e.ts >= s.ts WHERE e.event_type = 'view'"""),
    "event_runs": (event_runs, """WITH e AS (SELECT user_id, ts, count(*) AS n FROM events GROUP BY 1, 2),
  g AS (SELECT *, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) > 21600000000, true)::INT AS b FROM e),
  r AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM g)
  SELECT user_id, count(*) AS runs, max(events)::BIGINT AS longest FROM (SELECT user_id, run, sum(n) AS events FROM r GROUP BY 1, 2) GROUP BY 1"""),
    "trending": (trending, """SELECT user_id, count(*) AS views FROM events WHERE event_type = 'view' AND ts > (SELECT max(ts) FROM events WHERE event_type = 'view') - INTERVAL 24 HOURS
  GROUP BY 1 ORDER BY views DESC, user_id LIMIT 5"""),
    "view_counts": (view_counts, "SELECT user_id, count(*) AS views, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_view FROM events WHERE event_type = 'view' GROUP BY 1"),
    "daily_windows": (daily_windows, "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS events, round(sum(value), 2) AS amount FROM events GROUP BY 1, 2"),
    "sliding_windows": (sliding_windows, """SELECT strftime(time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '2000-01-01') - k * INTERVAL 6 HOURS, '%Y-%m-%d %H') AS start, count(*) AS views
  FROM events, range(4) t(k) WHERE event_type = 'view' GROUP BY 1"""),
    "rate_limited": (rate_limited, """SELECT event_type, count(*) AS limited FROM (SELECT event_type, count(*) OVER (PARTITION BY user_id, event_type ORDER BY floor(epoch(ts))::BIGINT RANGE BETWEEN 36000 PRECEDING AND CURRENT ROW) AS recent FROM events) WHERE recent >= 3 GROUP BY 1"""),
    "unviewed": (unviewed, "SELECT s_suppkey, s_name FROM supplier WHERE NOT EXISTS (SELECT 1 FROM events WHERE user_id = s_suppkey AND event_type IN ('view', 'click'))"),
    "event_properties": (event_properties, "SELECT (props->>'$.k')::INT % 10 AS k, count(*) AS events, round(avg(value), 4) AS mean_value FROM events GROUP BY 1"),
    "conversation_turns": (conversation_turns, """WITH c AS (SELECT DISTINCT conv_id, turn, role, length(text) AS chars FROM conversations),
  t AS (SELECT *, (role <> lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, chars))::INT AS change FROM c)
  SELECT conv_id, min(turn) AS first_turn, max(turn) AS last_turn, coalesce(sum(change), 0)::BIGINT AS changes, sum(chars)::BIGINT AS chars FROM t GROUP BY 1"""),
    "linked_participants": (linked_participants, None),
}
