"""Sampling, allocation, metrics and quality gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.votes import share
from ..sources.civic import table

SEED = "1998"


def hash_rank(seed: str, key: Column) -> Column:
    """A repeatable random order: SHA-256 of seed, a zero byte, and the key."""
    return F.sha2(F.concat(F.lit(seed).cast("binary"), F.lit(bytearray(b"\0")), key.cast("string").cast("binary")), 256)


def stratified(df: DataFrame, strata: list[str], key: str, k: int, seed: str = SEED) -> DataFrame:
    """``k`` rows of each stratum, by hash."""
    w = Window.partitionBy(*strata).orderBy(hash_rank(seed, F.col(key)), key)
    return df.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def allocated(cells: DataFrame, size: str, whole: int, name: str = "quota") -> DataFrame:
    """Seats by cell: one each, the rest by largest remainder of size, ties by the cells' order of all columns.

    ``cells`` is one row a cell.
    """
    keys = [c for c in cells.columns if c != size]
    every = Window.partitionBy()
    left = F.greatest(F.lit(0), F.lit(whole) - F.count(F.lit(1)).over(every))
    exact = left * F.col(size) / F.sum(size).over(every)
    base = cells.withColumn("_exact", exact).withColumn("_floor", F.floor("_exact")).withColumn("_left", left)
    rank = F.row_number().over(Window.partitionBy().orderBy(F.desc(F.round(F.col("_exact") - F.col("_floor"), 9)), *keys))
    return base.withColumn("_rank", rank).withColumn("_sum", F.sum("_floor").over(every)).withColumn(name, (1 + F.col("_floor") + F.when(F.col("_rank") <= F.col("_left") - F.col("_sum"), 1).otherwise(0)).cast("long")).select(*keys, size, name)


def confusion(df: DataFrame, truth: str, guess: str, by: list[str]) -> DataFrame:
    """Counts, precision, recall and F1 of a binary guess by group; undefined ones are null."""
    t, g = F.col(truth) == 1, F.col(guess) == 1
    counts = df.groupBy(*by).agg(F.count_if(t & g).alias("tp"), F.count_if(~t & g).alias("fp"), F.count_if(t & ~g).alias("fn"), F.count_if(~t & ~g).alias("tn"))
    return counts.select("*", share(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), share(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), share(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


def stratified_sample(spark, d):
    return stratified(table(spark, d, "documents").select("doc_id", "lang", "source"), ["lang", "source"], "doc_id", 3)


def hamilton_allocation(spark, d):
    cells = table(spark, d, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("documents"))
    return allocated(cells, "documents", 300)


def label_metrics(spark, d):
    """How well toxicity stands for poor quality, by language."""
    l = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id").withColumn("poor", 1 - F.col("quality"))  # noqa: E741
    return confusion(l, "poor", "toxic", ["lang"])


def ensemble_metrics(spark, d):
    """Three weak guesses of poor quality: mean, weighted mean and majority."""
    docs = table(spark, d, "documents").select("doc_id", "lang", (F.col("n_chars") < 400).cast("int").alias("a"), (F.col("doc_id") % 5 == 0).cast("int").alias("b"))
    l = table(spark, d, "labels").join(docs, "doc_id").withColumn("poor", 1 - F.col("quality")).withColumn("c", F.col("toxic"))  # noqa: E741
    mean, weighted = (F.col("a") + F.col("b") + F.col("c")) / 3, 0.5 * F.col("a") + 0.2 * F.col("b") + 0.3 * F.col("c")
    ways = F.explode(F.array(F.struct(F.lit("mean").alias("way"), (mean >= 0.5).cast("int").alias("guess")), F.struct(F.lit("weighted").alias("way"), (weighted >= 0.5).cast("int").alias("guess")), F.struct(F.lit("any").alias("way"), F.greatest("a", "b", "c").alias("guess"))))
    return confusion(l.select("poor", ways.alias("w")).select("poor", "w.way", "w.guess"), "poor", "guess", ["way"])


def train_split(spark, d):
    """80/10/10 by hash, stratified by construction; the split of an id never changes."""
    bucket = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10
    part = F.when(bucket < 8, "train").when(bucket == 8, "valid").otherwise("test")
    return table(spark, d, "labels").groupBy(part.alias("part"), "quality", "toxic").agg(F.count(F.lit(1)).alias("rows"))


def quality_gate(spark, d):
    """Criteria with a tri-state status: pass, fail, or pending where there is nothing to judge."""
    docs = table(spark, d, "documents")
    agg = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("text").isNull() | (F.col("text") == "")).alias("empty"), F.count_if(F.length("text") != F.col("n_chars")).alias("miscounted"))
    status = F.when(F.col("rows") < 150, "pending").when(F.col("empty") + F.col("miscounted") == 0, "pass").otherwise("fail")
    return agg.withColumn("status", status)


def selection_digest(spark, d):
    """A digest of the ordered ids of each language."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda i: i.cast("string")), ",")
    return table(spark, d, "documents").groupBy("lang").agg(F.sha2(F.concat(F.lit("["), ids, F.lit("]")).cast("binary"), 256).alias("digest"), F.count(F.lit(1)).alias("documents"))


def embedding_screen(spark, d):
    """The hundred vectors nearest in cosine to vector 0."""
    e = table(spark, d, "embeddings")
    q = e.where("vec_id = 0").select(F.col("embedding").alias("q")).limit(1)  # one row
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    cosine = F.try_divide(dot(F.col("embedding"), F.col("q")), F.sqrt(dot(F.col("embedding"), F.col("embedding"))) * F.sqrt(dot(F.col("q"), F.col("q"))))
    return e.crossJoin(F.broadcast(q)).select("vec_id", "label", F.round(cosine, 5).alias("cosine")).orderBy(F.desc("cosine"), "vec_id").limit(100)


def mean_vectors(spark, d):
    """Mean of every component by label, a row each."""
    parts = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("component", "value"))
    return parts.groupBy("label", "component").agg(F.count(F.lit(1)).alias("vectors"), F.round(F.avg(F.col("value").cast("double")), 5).alias("mean"))


def medians(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.round(F.median("n_chars"), 2).alias("median_chars"), F.max("n_chars").alias("longest"))


def story_scores(spark, d):
    """Meetings scored as stories: amount, urgency, controversy; the best fifty."""
    o = table(spark, d, "orders")
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("l_returnflag") == "R").alias("opposed"))
    score = F.when(F.col("o_totalprice") > 400000, 30).when(F.col("o_totalprice") > 200000, 15).otherwise(0) + F.when(F.col("o_orderpriority").startswith("1"), 20).otherwise(0) + 5 * F.least("opposed", F.lit(4)) + F.least("items", F.lit(5))
    dismissed = o.where("o_orderkey % 9 = 0").select("o_orderkey")
    return o.join(lines, "o_orderkey").join(dismissed, "o_orderkey", "left_anti").select("o_orderkey", score.cast("long").alias("score"), "o_totalprice").orderBy(F.desc("score"), F.desc("o_totalprice"), "o_orderkey").limit(50)


_CONF = """count(*) FILTER (t = 1 AND g = 1) AS tp, count(*) FILTER (t <> 1 AND g = 1) AS fp, count(*) FILTER (t = 1 AND g <> 1) AS fn, count(*) FILTER (t <> 1 AND g <> 1) AS tn"""
_PRF = "CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 4) END AS precision, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 4) END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN round(2 * tp / (2 * tp + fp + fn), 4) END AS f1"

PLANS = {
    "stratified_sample": (stratified_sample, """SELECT doc_id, lang, source, rank FROM (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY sha256('1998'::BLOB || '\\x00'::BLOB || doc_id::VARCHAR::BLOB), doc_id) AS rank FROM documents) WHERE rank <= 3"""),
    "hamilton_allocation": (hamilton_allocation, """WITH c AS (SELECT lang, source, count(*) AS documents FROM documents GROUP BY 1, 2),
  e AS (SELECT *, greatest(0, 300 - count(*) OVER ()) AS l, greatest(0, 300 - count(*) OVER ()) * documents / sum(documents) OVER () AS x FROM c),
  r AS (SELECT *, sum(floor(x)) OVER () AS s, row_number() OVER (ORDER BY round(x - floor(x), 9) DESC, lang, source) AS k FROM e)
  SELECT lang, source, documents, (1 + floor(x) + CASE WHEN k <= l - s THEN 1 ELSE 0 END)::BIGINT AS quota FROM r"""),
    "label_metrics": (label_metrics, f"SELECT *, {_PRF} FROM (SELECT lang, {_CONF} FROM (SELECT lang, 1 - quality AS t, toxic AS g FROM labels JOIN documents USING (doc_id)) GROUP BY 1)"),
    "ensemble_metrics": (ensemble_metrics, f"""WITH x AS (SELECT 1 - quality AS t, (n_chars < 400)::INT AS a, (doc_id % 5 = 0)::INT AS b, toxic AS c FROM labels JOIN documents USING (doc_id)),
  w AS (SELECT 'mean' AS way, t, ((a + b + c) / 3 >= 0.5)::INT AS g FROM x UNION ALL SELECT 'weighted', t, (0.5 * a + 0.2 * b + 0.3 * c >= 0.5)::INT FROM x UNION ALL SELECT 'any', t, greatest(a, b, c) FROM x)
  SELECT *, {_PRF} FROM (SELECT way, {_CONF} FROM w GROUP BY 1)"""),
    "train_split": (train_split, None),
    "quality_gate": (quality_gate, """SELECT *, CASE WHEN rows < 150 THEN 'pending' WHEN empty + miscounted = 0 THEN 'pass' ELSE 'fail' END AS status FROM (
  SELECT lang, count(*) AS rows, count(*) FILTER (text IS NULL OR text = '') AS empty, count(*) FILTER (length(text) <> n_chars) AS miscounted FROM documents GROUP BY 1)"""),
    "selection_digest": (selection_digest, "SELECT lang, sha256('[' || string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) || ']') AS digest, count(*) AS documents FROM documents GROUP BY 1"),
    "embedding_screen": (embedding_screen, """SELECT vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 5) AS cosine
  FROM embeddings ORDER BY cosine DESC, vec_id LIMIT 100"""),
    "mean_vectors": (mean_vectors, """SELECT label, component::INT AS component, count(*) AS vectors, round(avg(value::DOUBLE), 5) AS mean
  FROM (SELECT label, unnest(embedding) AS value, generate_subscripts(embedding, 1) - 1 AS component FROM embeddings) GROUP BY 1, 2"""),
    "medians": (medians, "SELECT source, round(median(n_chars), 2) AS median_chars, max(n_chars) AS longest FROM documents GROUP BY 1"),
    "story_scores": (story_scores, """SELECT o_orderkey, (CASE WHEN o_totalprice > 400000 THEN 30 WHEN o_totalprice > 200000 THEN 15 ELSE 0 END + CASE WHEN o_orderpriority LIKE '1%' THEN 20 ELSE 0 END
  + 5 * least(opposed, 4) + least(items, 5))::BIGINT AS score, o_totalprice FROM orders JOIN (SELECT l_orderkey, count(*) AS items, count(*) FILTER (l_returnflag = 'R') AS opposed FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
  WHERE o_orderkey % 9 <> 0 ORDER BY score DESC, o_totalprice DESC, o_orderkey LIMIT 50"""),
}
