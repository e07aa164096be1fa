"""Exact dedup by deterministic block naming (native).

Each normalised text is cut into fixed-size blocks. Distinct blocks are sorted
and get integer names; then names of adjacent blocks are paired, the distinct
pairs sorted and named in turn, until one name is left of each document. Two
documents have the same (number of blocks, name) exactly when their normalised
texts are equal.

Blocks are sorted by a 64-bit digest, over the cluster, without a total sort of
the texts. The distinct contents of each digest are counted over all blocks; if
a digest ever stands for two contents, the naming starts again with another
seed, so names are free of collisions. Texts are shuffled once, after map-side
combining of equal blocks: a block that fills a third of the corpus costs a row
a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import ASCII_SPACE, Scratch, documents

BLOCK_CHARS = 4096


def normalised(text: Column) -> Column:
    """``text`` without ASCII white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), ASCII_SPACE, "")


def _digest(block: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), block)


def _named(keys: DataFrame, columns: list[str], bucket: Column) -> DataFrame:
    """Integer names of distinct rows, in sorted order within each of 65,536 buckets."""
    order = Window.partitionBy("bucket").orderBy(*columns)
    return (
        keys.withColumn("bucket", F.shiftright(bucket, 48) + F.lit(32768))
        .withColumn("name", F.shiftleft(F.col("bucket"), 40) + F.row_number().over(order))
        .drop("bucket")
    )


def identities(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", block_chars: int = BLOCK_CHARS, digest=_digest, max_seeds: int = 8, tables: Scratch | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_chars, text_sha256, n_blocks, name.

    Equal (n_blocks, name) means equal normalised text. Null or empty texts have
    no blocks and name 0. Repeated ids stay separate rows.
    """
    tables = tables or Scratch(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.length(text).cast("long").alias("n_chars"), normalised(F.col(text_col)).alias("norm"))
    blocks = F.regexp_extract_all("norm", F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0))
    for seed in range(max_seeds):
        base = tables.write(
            texts.select(
                F.monotonically_increasing_id().alias("row"),
                "doc_id",
                "n_chars",
                F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"),
                F.transform(blocks, lambda b: digest(b, seed)).alias("digests"),
            ),
            "dedup-base",
        )
        distinct = texts.select(F.explode(blocks).alias("block")).select(digest(F.col("block"), seed).alias("digest"), "block").distinct()
        contents = tables.write(distinct.groupBy("digest").agg(F.count(F.lit(1)).alias("contents")), "dedup-contents")
        if not contents.where("contents > 1").head(1):
            break
        tables.drop("dedup-base", "dedup-contents")
    else:
        raise ValueError(f"no seed of {max_seeds} tells all blocks apart")

    names = _named(contents.select("digest"), ["digest"], F.col("digest"))
    level = tables.write(
        base.select("row", F.posexplode("digests").alias("pos", "digest"), F.size("digests").alias("left")).join(names, "digest").select("row", F.col("pos").cast("long"), "left", "name"),
        "dedup-level",
    )
    tables.drop("dedup-contents")
    finished = level.where("left = 1").select("row", "name")
    widest = level.agg(F.max("left")).first()[0] or 0
    level = level.where("left > 1")
    while widest > 1:
        half = lambda n: (n + 1).cast("long") / 2
        pairs = level.groupBy("row", F.floor(F.col("pos") / 2).alias("pos"), F.floor(half(F.col("left"))).cast("int").alias("left")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"),
        )
        names = _named(pairs.select("a", "b").distinct(), ["a", "b"], F.xxhash64("a", "b"))
        level = tables.write(pairs.join(names, ["a", "b"]).select("row", "pos", "left", "name"), "dedup-level")
        finished = finished.unionByName(level.where("left = 1").select("row", "name"))
        level = level.where("left > 1")
        widest = (widest + 1) // 2
    return base.join(finished, "row", "left").select("doc_id", "n_chars", "text_sha256", F.size("digests").alias("n_blocks"), F.coalesce("name", F.lit(0)).alias("name"))


def exact_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Which row of equal normalised texts stays: most code points, then smallest id.

    Returns one row per row of ``docs``: doc_id, keep_id, group_size, kept,
    text_sha256. Null texts count as empty and form one group with the empty
    ones. A null id stays only where the longest texts of its group have no
    other id. Rows that repeat an id within a group share its decision. Texts
    are read whole, however long; an empty table gives an empty one; only the
    two named columns are read.
    """
    tables = Scratch(docs.sparkSession)
    with tables:
        ids = tables.write(identities(docs, text_col, id_col, block_chars, tables=tables), "dedup-ids")
        tables.drop("dedup-base", "dedup-level")
    # The smallest id is the largest negated one; of structs, max takes the first field first.
    best = ids.groupBy("n_blocks", "name").agg(F.max(F.struct("n_chars", (-F.col("doc_id")).alias("neg"))).alias("best"), F.count(F.lit(1)).alias("group_size"))
    return (
        ids.join(best, ["n_blocks", "name"])
        .withColumn("keep_id", -F.col("best.neg"))
        .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    )


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


OP2_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents),
g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""

QUERIES = {"op2_exact_dedup": op2_exact_dedup}
ORACLES = {"op2_exact_dedup": OP2_SQL}
