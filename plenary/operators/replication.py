"""Replication over plain tables: upsert, reconcile, diff, dangling references."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """``target`` with rows of ``source`` put in or replaced, over the columns both have; others of target stay null for new rows."""
    shared = [c for c in target.columns if c in source.columns]
    kept = target.join(source.select(*keys), keys, "left_anti")
    return kept.select(*target.columns).unionByName(source.select(*shared), allowMissingColumns=True).select(*target.columns)


def secondary_conflicts(target: DataFrame, source: DataFrame, key: str, unique: str) -> DataFrame:
    """Rows of ``target`` that hold a unique value which ``source`` gives to another key."""
    new = source.select(F.col(unique), F.col(key).alias("_new"))
    return target.join(new, unique).where(F.col(key) != F.col("_new")).drop("_new")


def reconcile(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """key and action: delete what the source lacks, insert what the target lacks."""
    gone = target.select(key).join(source.select(key), key, "left_anti").withColumn("action", F.lit("delete"))
    new = source.select(key).join(target.select(key), key, "left_anti").withColumn("action", F.lit("insert"))
    return gone.unionByName(new)


def row_hash(columns: list[str]):
    """A hash of a row that tells null from any text."""
    return F.md5(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).cast("binary"))


def multiset_diff(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Rows by hash whose number differs between two frames."""
    x, y = (df.groupBy(row_hash(columns).alias("hash")).agg(F.count(F.lit(1)).alias(n)) for df, n in ((a, "left_n"), (b, "right_n")))
    j = x.join(y, "hash", "full_outer").select("hash", F.coalesce("left_n", F.lit(0)).alias("left_n"), F.coalesce("right_n", F.lit(0)).alias("right_n"))
    return j.where("left_n <> right_n")


def field_mismatches(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, and the columns in which rows of both frames differ, nulls being equal."""
    other = b.select(F.col(key), *(F.col(c).alias(f"_{c}") for c in columns))
    names = F.filter(F.array(*(F.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), F.lit(c)) for c in columns)), lambda c: c.isNotNull())
    return a.join(other, key).select(key, F.array_join(names, ",").alias("fields")).where("fields <> ''")


def dangling(child: DataFrame, references: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """reference, value and rows: values of child columns that no parent has. Nulls don't dangle."""
    parts = []
    for column, parent, key in references:
        lost = child.where(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)).distinct(), column, "left_anti")
        parts.append(lost.groupBy(F.lit(column).alias("reference"), F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("rows")))
    return reduce(DataFrame.unionByName, parts)


def latest_receipts(receipts: DataFrame, key: str, at: str, digest: str) -> DataFrame:
    """key, digest, state: the latest receipt of each identity; equal ones are replays, unequal ones at one time conflict."""
    w = Window.partitionBy(key)
    one = receipts.select(key, at, digest).distinct()
    top = one.withColumn("_last", F.max(at).over(w)).withColumn("_all", F.count(F.lit(1)).over(w))
    now = top.where(F.col(at) == F.col("_last")).groupBy(key).agg(F.count_distinct(digest).alias("n"), F.min(digest).alias(digest), F.max("_all").alias("_all"))
    return now.select(key, digest, F.when(F.col("n") > 1, "conflict").otherwise("current").alias("state"), (F.col("_all") - F.col("n")).alias("superseded"))
