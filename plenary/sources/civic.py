"""Civic frames over the driver's tables, and the same views as SQL.

meetings are orders (the body is the customer's nation), motions are orders
with their line items as votes, members are suppliers, entities are parts and
their mentions line items, page views are events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.votes import normalize_vote


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def meetings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """meeting_id, body (code), body_id, jurisdiction_id, meeting_date (ISO string), status, meeting_type, price."""
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    return (
        orders.join(customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("o_orderkey").alias("meeting_id"),
            F.col("n_name").alias("body"),
            F.col("n_nationkey").cast("long").alias("body_id"),
            F.col("n_regionkey").cast("long").alias("jurisdiction_id"),
            F.date_format("o_orderdate", "yyyy-MM-dd").alias("meeting_date"),
            F.when(F.col("o_orderstatus") == "F", "complete").when(F.col("o_orderstatus") == "P", "failed").alias("status"),
            F.col("o_orderpriority").alias("meeting_type"),
            F.col("o_totalprice").alias("price"),
        )
    )


def member_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """motion_id, member_id, vote: one row a motion and member, the greatest normalised vote of several."""
    raw = F.when(F.col("l_returnflag") == "A", "aye").when(F.col("l_returnflag") == "R", "Nay").otherwise("abstained")
    votes = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("motion_id"), F.col("l_suppkey").alias("member_id"), normalize_vote(raw).alias("vote"))
    return votes.groupBy("motion_id", "member_id").agg(F.max("vote").alias("vote"))


def attendance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """meeting_id, member_id, present."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy(F.col("l_orderkey").alias("meeting_id"), F.col("l_suppkey").alias("member_id")).agg(F.max(F.col("l_linestatus") == "F").alias("present"))


def agenda_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """meeting_id, item_number (string), title, part_id, line price; rows may repeat a number."""
    lines, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return lines.join(part.select("p_partkey", "p_name", "p_type"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("meeting_id"),
        F.col("l_linenumber").cast("string").alias("item_number"),
        F.concat_ws(" ", "p_name", "p_type").alias("title"),
        F.col("l_partkey").alias("part_id"),
        F.col("l_extendedprice").alias("price"),
    )


#: The same views for the oracle, as common table expressions.
SQL = {
    "meetings": """meetings AS (
  SELECT o_orderkey AS meeting_id, n_name AS body, n_nationkey::BIGINT AS body_id, n_regionkey::BIGINT AS jurisdiction_id,
         strftime(o_orderdate, '%Y-%m-%d') AS meeting_date,
         CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'P' THEN 'failed' END AS status,
         o_orderpriority AS meeting_type, o_totalprice AS price
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)""",
    "member_votes": """member_votes AS (
  SELECT l_orderkey AS motion_id, l_suppkey AS member_id,
         max(CASE l_returnflag WHEN 'A' THEN 'yes' WHEN 'R' THEN 'no' ELSE 'abstain' END) AS vote
  FROM lineitem GROUP BY 1, 2)""",
    "attendance": """attendance AS (
  SELECT l_orderkey AS meeting_id, l_suppkey AS member_id, bool_or(l_linestatus = 'F') AS present FROM lineitem GROUP BY 1, 2)""",
    "agenda_items": """agenda_items AS (
  SELECT l_orderkey AS meeting_id, l_linenumber::VARCHAR AS item_number, p_name || ' ' || p_type AS title,
         l_partkey AS part_id, l_extendedprice AS price
  FROM lineitem JOIN part ON l_partkey = p_partkey)""",
    "motions": """motions AS (
  SELECT motion_id, count(*) FILTER (vote = 'yes') AS yes, count(*) FILTER (vote = 'no') AS no,
         count(*) FILTER (vote = 'abstain') AS abstain, count(*) AS total,
         CASE WHEN count(*) FILTER (vote IN ('yes', 'no')) = 0 THEN NULL
              WHEN count(*) FILTER (vote = 'yes') > count(*) FILTER (vote = 'no') THEN 'yes'
              WHEN count(*) FILTER (vote = 'yes') < count(*) FILTER (vote = 'no') THEN 'no' ELSE 'tie' END AS majority,
         count(*) FILTER (vote = 'yes') > 0 AND count(*) FILTER (vote = 'no') > 0 AS is_split
  FROM member_votes GROUP BY motion_id)""",
}


def with_views(*names: str, more: str = "") -> str:
    return "WITH " + ", ".join([SQL[n] for n in names] + ([more] if more else [])) + "\n"
