"""Document fingerprints by homomorphic multiset hashing (native).

A text is a multiset of paragraphs. Every paragraph is hashed to a wide vector
of integers, and a fingerprint is the sum of the vectors modulo powers of two.
So the order of paragraphs doesn't matter, and a paragraph is inserted or
deleted by adding or subtracting its vector (``plus``, ``minus``).

A vector has three parts: ``IDENTITY`` lanes, seeded hashes of the whole
paragraph modulo 2**56, which settle equality; the number of phrases, modulo
2**40; and ``16 * WORDS`` long words, each of three counters modulo 2**20, which
hold how often each bit is set in hashes of the paragraph's phrases. A spare bit
above each counter keeps sums and differences from reaching its neighbour. The
counters give likeness: as signed sums they estimate the cosine of two multisets
of phrases. Phrases are cut within paragraphs, at punctuation and after words
that end in certain letters, so an edit changes the phrases around it only.

With 2**20 phrases or more in a text or a sum (some ten megabytes), a counter is
taken for the value nearest to half of the phrases; likeness is then right as
long as no bit's count is 2**19 away from that. Equality isn't bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents

IDENTITY = 8
#: 64-bit hashes of a phrase; each gives 16 long words of three counters, 48 signs.
WORDS = 4
COUNTERS = 16 * WORDS
#: Where phrases end: punctuation, line feeds, and spaces after words that end in one of these letters. No match goes beyond a line feed.
PHRASE = r"\n|[.,;:!?|]+[^\S\n]*|(?<=[dgklmsuvz])[^\S\n]+"
#: Where the counters of a long word begin, the bits that are added to them, and the spare bits above them.
AT = (0, 21, 42)
SPREAD, SPARE = sum(1 << at for at in AT), sum(1 << at + 20 for at in AT)
COUNTER_MOD = sum(((1 << 20) - 1) << at for at in AT)
IDENTITY_MOD, COUNT_MOD = (1 << 56) - 1, (1 << 40) - 1


def _sum(values: Column, mask: int) -> Column:
    """Sum modulo a power of two, masked at each step, so that it never overflows."""
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: (a + x).bitwiseAND(F.lit(mask)))


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _hashes(strings: Column, seed: int) -> Column:
    return F.transform(strings, lambda x: F.xxhash64(F.lit(seed), x))


def _identity(paragraphs: Column, seed: int) -> Column:
    return _sum(F.transform(_hashes(paragraphs, seed), lambda h: h.bitwiseAND(F.lit(IDENTITY_MOD))), IDENTITY_MOD)


def _counter(hashes: Column, shift: int) -> Column:
    """Three counters of the bits at ``shift`` and 21 and 42 above it."""
    return F.aggregate(hashes, F.lit(0).cast("long"), lambda a, h: (a + F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(SPREAD))).bitwiseAND(F.lit(COUNTER_MOD)))


def vector(text: Column) -> Column:
    """The fingerprint of ``text`` (not null) as an array of long; empty paragraphs and phrases count nothing."""

    def of_paragraphs(paragraphs: Column) -> Column:
        return F.array(*(_identity(paragraphs, seed) for seed in range(IDENTITY)))

    def counters(hashes: Column) -> Column:
        return F.array(*(_counter(hashes, shift) for shift in range(16)))

    def of_phrases(phrases: Column) -> Column:
        count = F.array(F.size(phrases).cast("long").bitwiseAND(F.lit(COUNT_MOD)))
        return F.concat(count, *(_let(_hashes(phrases, IDENTITY + word), counters) for word in range(WORDS)))

    paragraphs = F.filter(F.split(text, "\n"), lambda p: p != "")
    phrases = F.filter(F.split(text, PHRASE), lambda p: p != "")
    return F.concat(_let(paragraphs, of_paragraphs), _let(phrases, of_phrases))


_MASKS = [IDENTITY_MOD] * IDENTITY + [COUNT_MOD] + [COUNTER_MOD] * COUNTERS
#: Set before a subtraction, so that no counter borrows from the next.
_SPARES = [0] * (IDENTITY + 1) + [SPARE] * COUNTERS


def plus(a: Column, b: Column) -> Column:
    """Fingerprint of the two multisets together."""
    masks = F.array(*map(F.lit, _MASKS))
    return F.zip_with(F.zip_with(a, b, lambda x, y: x + y), masks, lambda x, m: x.bitwiseAND(m))


def minus(a: Column, b: Column) -> Column:
    """Fingerprint of ``a`` without the paragraphs of ``b``."""
    masks, spares = F.array(*map(F.lit, _MASKS)), F.array(*(F.lit(s).cast("long") for s in _SPARES))
    return F.zip_with(F.zip_with(F.zip_with(a, spares, lambda x, s: x.bitwiseOR(s)), b, lambda x, y: x - y), masks, lambda x, m: x.bitwiseAND(m))


def _signed(fingerprint: Column) -> Column:
    """Signed sums of the counters: bits set less bits not set."""
    words = F.slice(fingerprint, IDENTITY + 2, COUNTERS)
    n, whole = F.element_at(fingerprint, IDENTITY + 1), float(1 << 20)
    split = F.flatten(F.transform(words, lambda w: F.array(*(F.shiftright(w, at).bitwiseAND(F.lit((1 << 20) - 1)) for at in AT))))
    nearest = lambda c: F.when(n < whole, c.cast("double")).otherwise(c + whole * F.round((n / 2 - c) / whole))
    return F.transform(split, lambda c: 2 * nearest(c) - n)


def likeness(a: Column, b: Column) -> Column:
    """Estimated cosine of the phrases of two fingerprints, from 0 to 1; 1 for equal fingerprints, 0 if only one is empty."""
    dot = lambda v: F.aggregate(v, F.lit(0.0), lambda s, e: s + e["0"] * e["1"])
    own = lambda v, i: F.aggregate(v, F.lit(0.0), lambda s, e: s + e[i] * e[i])
    cosine = _let(F.arrays_zip(_signed(a), _signed(b)), lambda v: F.try_divide(dot(v), F.sqrt(own(v, "0") * own(v, "1"))))
    return F.when(a == b, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(cosine, F.lit(0.0)))))


def text_of(fingerprint: Column) -> Column:
    """A fingerprint as a string of hexadecimal numbers."""
    return F.concat_ws("-", F.transform(fingerprint, lambda x: F.lower(F.hex(x))))


def fingerprint(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id and fingerprint (array of long) of every row.

    A null text counts as empty; texts are read whole, however long. Rows that
    repeat an id or a text give a row each; an empty table gives an empty one.
    Only the two named columns are read.
    """
    return docs.select(F.col(id_col).alias("doc_id"), vector(F.coalesce(F.col(text_col), F.lit(""))).alias("fingerprint"))


#: Ranges of ids that neighbours are found in: so many, and more where these would have more rows than this.
RANGES, RANGE_ROWS = 2048, 50_000


def with_next(docs: DataFrame, id_col: str, value_cols: list[str], ranges: int | None = None) -> DataFrame:
    """``docs`` with ``next_<col>``: values of the row with the next smaller id, after the last those of the first.

    Ids are dealt to ranges by approximate quantiles. The first row of each
    range is also sent, marked, to the range before it in the descending order,
    so that every row finds its neighbour within its range, and values are
    shuffled once. Null ids come last; rows that repeat an id come in the order
    of their values, in one task. A single row is its own neighbour; an empty
    table gives an empty one.
    """
    if ranges is None:
        ranges = max(RANGES, -(-docs.select(id_col).count() // RANGE_ROWS))
    from pyspark.ml.feature import Bucketizer

    spark = docs.sparkSession
    bounds = sorted({float(b) for b in docs.select(F.percentile_approx(F.col(id_col), [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0] or []})
    if not bounds:
        bounds = [0.0]
    key = F.coalesce(F.col(id_col).cast("double"), F.lit(float("-inf")))
    cut = Bucketizer(splits=[float("-inf"), *bounds, float("inf")], inputCol="_key", outputCol="_range", handleInvalid="keep")
    ranged = lambda df: cut.transform(df.withColumn("_key", key)).withColumn("_range", F.when(F.col(id_col).isNull(), F.lit(-1)).otherwise(F.col("_range").cast("int"))).drop("_key")
    heads = ranged(docs.select(id_col)).groupBy("_range").agg(F.max(id_col).alias("_head")).collect()  # one row a range
    order = sorted(heads, key=lambda r: -r["_range"])
    # the head of each range follows the last row of the range before it; the first head follows the very last row
    follows = [(order[i]["_head"], order[i]["_range"], order[i - 1]["_range"]) for i in range(len(order))]
    ghosts = spark.createDataFrame(follows, "_head long, _own int, _before int") if follows else spark.createDataFrame([], "_head long, _own int, _before int")
    placed = ranged(docs.select(id_col, *value_cols)).join(F.broadcast(ghosts), F.col(id_col).eqNullSafe(F.col("_head")) & (F.col("_range") == F.col("_own")), "left")
    own, ghost = F.struct(F.col("_range").alias("range"), F.lit(False).alias("ghost")), F.struct(F.col("_before").alias("range"), F.lit(True).alias("ghost"))
    spread = placed.withColumn("_place", F.explode(F.when(F.col("_before").isNull(), F.array(own)).otherwise(F.array(own, ghost)))).select(id_col, *value_cols, "_place.range", "_place.ghost")
    window = Window.partitionBy("range").orderBy("ghost", F.desc_nulls_last(id_col), *value_cols)
    return spread.select("*", *(F.lead(c).over(window).alias(f"next_{c}") for c in value_cols)).where(~F.col("ghost")).drop("range", "ghost")


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(docs.withColumn("fp", vector(F.col("text"))), "doc_id", ["text", "fp"])
    n = F.length("text")
    rows = rows.withColumn("half", F.floor(n / 2).cast("int")).withColumn("n_chars", n.cast("long"))
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - F.col("half")), F.substring(F.col("next_text"), F.lit(1), F.col("half")))
    rows = rows.withColumn("edited", edited).withColumn("edited_fp", vector(F.col("edited")))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        text_of(F.col("fp")).alias("fingerprint"),
        text_of(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )


QUERIES = {"op5_document_fingerprints": op5_document_fingerprints}
ORACLES: dict[str, str] = {}
