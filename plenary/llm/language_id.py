"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of hashed 1-, 2- and 3-grams of code points by language make a matrix of
log-probabilities; it is broadcast (languages x 2**15 floats) and texts are
scored in numpy, many at a time: hashes of all positions at once, one gather a
language, and differences of running sums at the ends of texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import begin, documents, held_out, one_per_key, slices, smallest_hashes

#: Rows that a model is fitted on at most. More languages than MAX_LANGUAGES are refused: the matrix takes 128 KB of each.
TRAIN_ROWS, MAX_LANGUAGES = 20_000, 1000
BITS = 15
#: Characters that are scored at once; a longer text is scored in parts.
CHARS_AT_ONCE = 500_000
#: The score is a posterior at the evidence of so many characters, so that scores don't all become 1. The choice doesn't depend on it.
EVIDENCE = 64

_LETTER: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point, whether it is a letter (Unicode category L)."""
    if not _LETTER:
        import regex

        table = np.zeros(0x110000, dtype=bool)
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        for m in regex.finditer(r"\p{L}+", every):
            a, b = (x if x < 0xD800 else x + 0x800 for x in (m.start(), m.end()))
            table[a:b] = True
        _LETTER.append(table)
    return _LETTER[0]


def parts(texts: list[str | None]):
    """Lists of (text's number, part, own): lower-cased texts, each with a space at its end, about ``CHARS_AT_ONCE`` at once.

    A long text is cut; a part then has the next two characters too, so that
    the grams that begin at its own ``own`` characters are whole.
    """
    some, size = [], 0
    for number, text in enumerate(texts):
        lowered = (text or "").lower() + " "
        for at in range(0, len(lowered), CHARS_AT_ONCE):
            own = min(CHARS_AT_ONCE, len(lowered) - at)
            if some and size + own > CHARS_AT_ONCE:
                yield some
                some, size = [], 0
            some.append((number, lowered[at : at + own + 2], own))
            size += own
    if some:
        yield some


def grams(strings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes (3 x positions) of the n-grams that begin at each position, where each string begins, and which positions are letters.

    All but letters becomes one kind of space; grams that would run into the
    next string hash to 0, and no other does.
    """
    code = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    ends = np.cumsum([len(t) for t in strings])
    letter = letters()[code]
    code = np.where(letter, code, 32).astype(np.uint32)
    hashes = np.zeros((3, len(code)), dtype=np.int32)
    mixed = np.zeros(len(code), dtype=np.uint32)
    for n in range(3):
        shifted = np.zeros(len(code), dtype=np.uint32)
        shifted[: len(code) - n] = code[n:]
        mixed = (mixed ^ shifted) * np.uint32(0x9E3779B1)
        mixed ^= mixed >> np.uint32(15)
        hashes[n] = np.maximum(1, (mixed >> np.uint32(32 - BITS)).astype(np.int32))
        for back in range(1, n + 1):
            hashes[n][np.maximum(ends - back, 0)] = 0
    return hashes, np.concatenate([[0], ends[:-1]]).astype(np.int64), letter


@dataclass
class Model:
    languages: list[str]
    log_probability: np.ndarray  # languages x buckets
    log_prior: np.ndarray


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", train_rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most about ``train_rows`` of the rows with a language (those of smallest hashed id).

    Counts are summed on the cluster; the driver gets one vector a language. Of
    rows that repeat an id, null included, one teaches. Null and empty texts
    teach how frequent their language is.
    """
    rows = smallest_hashes(docs.where(F.col(lang_col).isNotNull()).select(id_col, F.col(text_col).cast("string").alias("_text"), F.col(lang_col).alias("_lang")), id_col, train_rows)
    rows = one_per_key(rows, id_col)

    def count(batches):
        import pyarrow as pa

        begin()
        totals: dict[str, np.ndarray] = {}
        for batch in slices(batches, 0):
            langs = batch.column(1).to_pylist()
            for lang in langs:
                totals.setdefault(lang, np.zeros((2, 1 << BITS), np.int64))[1, 0] += 1
            for some in parts(batch.column(0).to_pylist()):
                hashes, starts, _ = grams([part for _, part, _ in some])
                for (number, _, own), start in zip(some, starts.tolist(), strict=True):
                    totals[langs[number]][0] += np.bincount(hashes[:, start : start + own].ravel(), minlength=1 << BITS)
        kept = [(lang, int(b), int(t[0, b]), int(t[1, 0])) for lang, t in totals.items() for b in np.flatnonzero(t[0])]
        columns = list(zip(*kept, strict=True)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])], names=["lang", "bucket", "n", "rows"])

    counted = rows.select("_text", "_lang").mapInArrow(count, "lang string, bucket long, n long, rows long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"), F.sum("rows").alias("rows"))
    vectors = counted.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("counts"), F.max("rows").alias("rows")).orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(vectors) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    n = np.full((len(vectors), 1 << BITS), 0.5)
    for i, r in enumerate(vectors):
        for bucket, count_ in r["counts"]:
            n[i, bucket] += count_
    n[:, 0] = 0
    share = n / np.maximum(n.sum(axis=1, keepdims=True), 1)
    logs = np.log(share, out=np.zeros_like(share), where=share > 0)
    prior = np.array([float(r["rows"]) for r in vectors])
    return Model([r["lang"] for r in vectors], logs.astype(np.float32), np.log(prior / prior.sum()) if len(prior) else prior)


def score(model: Model, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and posterior of each text; ``und`` and 0 where there are no letters or nothing was learned.

    The language is the one most likely by prior and all grams, of equals the
    first by name.
    """
    if not model.languages:
        return ["und"] * len(texts), [0.0] * len(texts)
    joint, n_letters = np.repeat(model.log_prior[:, None], len(texts), axis=1), np.zeros(len(texts), np.int64)
    for some in parts(texts):
        hashes, starts, letter = grams([part for _, part, _ in some])
        numbers, ends = np.array([n for n, _, _ in some]), starts + np.array([own for _, _, own in some])
        before = np.concatenate([[0], np.cumsum(letter)])
        np.add.at(n_letters, numbers, before[ends] - before[starts])
        for i, row in enumerate(model.log_probability):
            running = np.concatenate([[0.0], np.cumsum(row[hashes].sum(axis=0, dtype=np.float64))])
            np.add.at(joint[i], numbers, running[ends] - running[starts])
    best = joint.argmax(axis=0)
    likely = (joint - joint.max(axis=0)) * (np.minimum(1, EVIDENCE / np.maximum(n_letters, 1)) / 3)
    posterior = np.exp(likely)
    posterior /= posterior.sum(axis=0)
    names = [model.languages[i] if n else "und" for i, n in zip(best.tolist(), n_letters.tolist(), strict=True)]
    return names, [float(posterior[i, j]) if n else 0.0 for j, (i, n) in enumerate(zip(best.tolist(), n_letters.tolist(), strict=True))]


def identify(docs: DataFrame, model: Model, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, lang_pred and score of every row; other columns of ``docs`` are ignored.

    Null, empty and letterless texts are ``und`` with score 0. Very long texts
    are read whole, part by part. Rows that repeat an id or a text give a row
    each; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        begin()
        for batch in slices(batches):
            names, scores = score(shared.value, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES = {"op7_language_id": op7_language_id}
ORACLES: dict[str, str] = {}
