"""Entity resolution: blocked pairs, components of matches, survivors and merges."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def blocked_pairs(df: DataFrame, key: str, blocks: Column, *carry: str) -> DataFrame:
    """Pairs (left key < right key) that share any element of ``blocks``, once each, with carried columns of both.

    An equi-join on exploded blocks, not a comparison of all with all; ``blocks``
    should leave out elements that very many rows share.
    """
    spread = df.select(key, *carry, F.explode(F.array_distinct(blocks)).alias("_block"))
    other = spread.select(F.col(key).alias(f"other_{key}"), *(F.col(c).alias(f"other_{c}") for c in carry), "_block")
    return spread.join(other, "_block").where(F.col(key) < F.col(f"other_{key}")).drop("_block").distinct()


def components(edges: DataFrame, nodes: DataFrame, rounds: int = 25, save=None) -> DataFrame:
    """id and component (smallest id reachable) of ``nodes`` (id), by hooking to neighbours' minima and pointer jumping.

    Edges are (a, b). ``save`` cuts the lineage after a round; by default a
    reliable checkpoint in the folder of spark.checkpoint.dir. A local master
    without that setting gets a folder of its own.
    """
    save = save or (lambda df: df.checkpoint())
    context = nodes.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        shared = nodes.sparkSession.conf.get("spark.checkpoint.dir", None)
        if shared is None and context.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the cluster shares")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="plenary-checkpoints-"))
    both = save(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = save(nodes.select(F.col("id"), F.col("id").alias("component")))
    for _ in range(rounds):
        near = both.join(label, both.b == label.id).groupBy("a").agg(F.min("component").alias("near"))
        hooked = label.join(near, label.id == near.a, "left").select("id", F.least("component", F.coalesce("near", "component")).alias("component"))
        up = hooked.select(F.col("id").alias("_p"), F.col("component").alias("_up"))
        new = save(hooked.join(up, hooked.component == up["_p"]).select("id", F.least("component", "_up").alias("component")))
        changed = new.join(label.withColumnRenamed("component", "_was"), "id").where("component <> _was").head(1)
        label = new
        if not changed:
            return label
    raise RuntimeError("components did not settle")


def survivors(entities: DataFrame, label: DataFrame, count: str) -> DataFrame:
    """id and survivor: of each component the entity with most mentions, then the smallest id."""
    w = Window.partitionBy("component").orderBy(F.desc(count), "id")
    return entities.join(label, "id").select("id", F.first("id").over(w).alias("survivor"))


def repointed(edges: DataFrame, merged: DataFrame, columns: list[str]) -> DataFrame:
    """``edges`` with ends moved to survivors; rows that become equal are one, loops go."""
    out = edges
    for c in columns:
        m = merged.select(F.col("id").alias(c), F.col("survivor").alias("_to"))
        out = out.join(m, c, "left").withColumn(c, F.coalesce("_to", c)).drop("_to")
    return out.where(F.col(columns[0]) != F.col(columns[1])).distinct()
