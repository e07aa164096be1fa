"""Relational rewrites: what SQL engines take but Spark plans badly or leaves undefined."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def or_join(left: DataFrame, right: DataFrame, left_key: str, conditions: list[tuple[str, str]], right_key: str, how: str = "left") -> DataFrame:
    """Join on ``l1 = r1 OR l2 = r2 ...`` as a union of equi-joins, so it isn't a nested loop.

    A pair that several conditions match comes once. ``left_key`` and
    ``right_key`` identify rows.
    """
    pairs = [left.select(left_key, F.col(a).alias("_k")).join(right.select(right_key, F.col(b).alias("_k")), "_k").select(left_key, right_key) for a, b in conditions]
    linked = reduce(DataFrame.union, pairs).distinct()
    return left.join(linked, left_key, how).join(right, right_key, "left" if how == "left" else "inner")


def distinct_on(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key in a stated order, which should settle ties."""
    return top_per_group(df, keys, 1, *order)


def top_per_group(df: DataFrame, keys: list[str], k: int, *order: Column | str) -> DataFrame:
    """The first ``k`` rows of each key; Spark prunes each partition to ``k`` a key before the shuffle."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") <= k).drop("_rank")


def keep_best(df: DataFrame, keys: list[str], score: str, *ties: str) -> DataFrame:
    """The row of each key with the greatest score, then the smallest of the tie columns.

    Row-wise it is ``distinct_on``; scores are compared as floats of 32 bits.
    """
    return distinct_on(df, keys, F.col(score).cast("float").desc_nulls_last(), *ties)


def span_join(points: DataFrame, starts: DataFrame, key: str, at: str, start: str, *carry: str) -> DataFrame:
    """For each point the span of its key that contains it, where spans run from one start to the next.

    An as-of join by one sorted window: no range join, and one shuffle by key.
    A point before the first start gets nulls. Rows of ``points`` keep their columns.
    """
    none = [F.lit(None).cast(starts.schema[c].dataType).alias(f"_{c}") for c in (start, *carry)]
    marks = starts.select(key, F.col(start).alias("_at"), F.lit(0).alias("_kind"), *(F.col(c).alias(f"_{c}") for c in (start, *carry)))
    rows = points.select(key, F.col(at).alias("_at"), F.lit(1).alias("_kind"), *none, *(F.col(c) for c in points.columns if c != key))
    every = rows.unionByName(marks, allowMissingColumns=True)
    before = Window.partitionBy(key).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    found = [F.last(F.when(F.col("_kind") == 0, F.struct(*(F.col(f"_{c}") for c in (start, *carry)))), ignorenulls=True).over(before).alias("_span")]
    return every.select("*", *found).where("_kind = 1").select(*points.columns, *(F.col(f"_span._{c}").alias(f"span_{c}") for c in (start, *carry)))


def spans(starts: DataFrame, key: str, start: str, end: Column) -> DataFrame:
    """Each start with the end of its span: the next start of its key, or else ``end``."""
    return starts.withColumn("span_end", F.coalesce(F.lead(start).over(Window.partitionBy(key).orderBy(start)), end))


def runs(df: DataFrame, keys: list[str], order: str, begins: Column) -> DataFrame:
    """Number runs of successive rows; ``begins`` says where a new one begins."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_new", F.coalesce(begins, F.lit(True)).cast("int")).withColumn("run", F.sum("_new").over(w)).drop("_new")


def ranked(df: DataFrame, key: str, number: str, block: int = 4096) -> DataFrame:
    """Each row's rank, from 1, among its key's, by a whole number that a key has once.

    Rows are sorted in blocks of the number and only blocks by key, so no task sorts a whole key.
    """
    blocks = df.withColumn("_block", F.expr(f"`{number}` div {block}"))
    sizes = blocks.groupBy(key, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select(key, "_block", (F.sum("_n").over(Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))
    nth = F.row_number().over(Window.partitionBy(key, "_block").orderBy(number))
    return blocks.withColumn("_nth", nth).join(before, [key, "_block"]).withColumn("rank", F.col("_nth") + F.col("_before")).drop("_block", "_nth", "_before")


def page(df: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """One page of a total order, with the number of rows and pages."""
    total = df.agg(F.count(F.lit(1)).alias("total_count"))
    shown = df.orderBy(*order).offset(max(0, number - 1) * size).limit(size)
    return shown.crossJoin(F.broadcast(total)).withColumn("total_pages", F.ceil(F.col("total_count") / size))  # total is one row


def truncated(df: DataFrame, order: list, limit: int) -> DataFrame:
    """The first ``limit`` rows, each saying whether there were more."""
    w = Window.orderBy(*order)
    more = df.orderBy(*order).limit(limit + 1)
    return more.withColumn("_n", F.row_number().over(w)).withColumn("has_more", F.max("_n").over(Window.partitionBy()) > limit).where(F.col("_n") <= limit).drop("_n")


def symmetric_counts(a: DataFrame, b: DataFrame, keys: list[str], name: str = "n") -> DataFrame:
    """Difference of counts by key in two frames, keys of one side included."""
    x, y = (df.groupBy(*keys).agg(F.count(F.lit(1)).alias(n)) for df, n in ((a, "left_n"), (b, "right_n")))
    both = x.join(y, keys, "full_outer")
    return both.select(*keys, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("left_n", "right_n"))).withColumn("difference", F.col("left_n") - F.col("right_n"))


def any_keyword(columns: list[str], words: list[str]) -> Column:
    """Whether any word occurs in any column, whatever the case."""
    pattern = "|".join("\\Q" + w.lower() + "\\E" for w in words)
    return F.lower(F.concat_ws(" ", *columns)).rlike(pattern)


def null_safe_anti(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``left`` without an equal key in ``right``, where nulls equal nulls."""
    other = right.select(*(F.col(k).alias(f"_{k}") for k in keys)).distinct()
    return left.join(other, reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys)), "left_anti")
