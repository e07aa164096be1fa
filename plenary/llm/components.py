"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Rounds after which something must be wrong: they grow with the logarithm of the edges.
MOST_ROUNDS = 60


def components(edges: DataFrame, tables: Scratch | None = None, name: str = "components") -> DataFrame:
    """id and component (smallest id reachable) of every end of ``edges`` (a, b); ids aren't null.

    Each round points ends at the smallest of their neighbours, by grouped
    minima that combine on the map side and joins that AQE can split, so a
    node with very many neighbours isn't one task's work. Every round is
    written to the shared folder and the one before it dropped; the last one is
    the table ``name`` of ``tables``. No edges give no rows.
    """
    tables = tables or Scratch(edges.sparkSession)
    current = tables.write(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-start")
    state, before = None, f"{name}-start"
    for number in range(MOST_ROUNDS):
        both = current.union(current.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = tables.write(large, f"{name}-large")
        tables.drop(before)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least).distinct()
        before = f"{name}-{number}"
        current = tables.write(small, before)
        tables.drop(f"{name}-large")
        now = tuple(current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    tables.paths[name] = tables.paths.pop(before)
    roots = current.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
