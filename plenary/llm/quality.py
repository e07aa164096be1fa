"""Quality grades by ordinal cumulative-link regression on hashed text.

A grade is at most k when a latent score falls below the k-th of ordered
thresholds: P(grade <= k) = logistic(threshold_k - weights . features). All
grades share the weights, over hashed words and measures of form. The expected
grade and the probability of the upper grades serve selection.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, begin, documents, held_out, one_per_key, remembers, slices, smallest_hashes

#: Labelled rows that a model is fitted on at most (those of smallest hashed id).
TRAIN_ROWS = 12_000
BITS = 11
MEASURES = 14
WIDTH = (1 << BITS) + MEASURES
#: Words that a worker remembers at most, and the most characters of one: some 50 MB.
MEMO_ENTRIES, MEMO_CHARS = 300_000, 40
RIDGE, STEPS = 2.0, 150
#: A document stays if the upper half of the grades is at least this likely.
KEEP = 0.5


class _Buckets(dict):
    def __missing__(self, word: str) -> int:
        found = zlib.crc32(word.lower().encode("utf-8")) & ((1 << BITS) - 1)
        if len(word) <= MEMO_CHARS:
            if len(self) >= MEMO_ENTRIES:
                self.clear()
            self[word] = found
        return found


_BUCKETS = _Buckets()
remembers("buckets", _BUCKETS.clear)


def measures(text: str, words: list[str]) -> list[float]:
    """Measures of form, each about between 0 and 1."""
    n, chars = max(1, len(words)), max(1, len(text))
    lines = [x for x in text.split("\n") if x]
    different, lower = len(set(words)), text.lower()
    upper = sum(map(str.isupper, words)) / n
    count = lambda signs: sum(map(text.count, signs))
    return [
        min(1.0, math.log1p(len(words)) / 10),
        different / n,
        1.0 - len(set(lines)) / max(1, len(lines)),
        upper,
        min(1.0, sum(map(len, words)) / n / 20),
        min(1.0, 5 * count(".!?") / n),
        min(1.0, 5 * count(",;:") / n),
        min(1.0, 5 * count("#$%&*|<>{}[]=_~^") / n),
        min(1.0, 10 * count("0123456789") / chars),
        min(1.0, 5 * count("!") / n),
        min(1.0, len(lines) / n * 5),
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        1.0 if len(words) < 5 else 0.0,
        sum(map(lower.count, ("click", "http", "lorem", "license", "copyright"))) / n,
    ]


def features(texts: list[str | None]) -> np.ndarray:
    """Rows of features; hashed words by the log of their counts, scaled to length 1."""
    out = np.zeros((len(texts), WIDTH), dtype=np.float32)
    for row, text in zip(out, texts, strict=True):
        words = (text or "").split()
        if words:
            counts = np.bincount(np.fromiter(map(_BUCKETS.__getitem__, words), dtype=np.int64, count=len(words)), minlength=1 << BITS)
            logs = np.log1p(counts)
            row[: 1 << BITS] = logs / np.sqrt((logs**2).sum())
        row[1 << BITS :] = measures(text or "", words)
    return out


@dataclass
class Model:
    grades: list[float]
    weights: np.ndarray
    thresholds: np.ndarray  # ordered, one less than there are grades

    def below(self, x: np.ndarray) -> np.ndarray:
        """P(grade <= k) for all but the last k."""
        return 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - (x @ self.weights)[:, None], -30, 30)))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade, and probability of the upper half of the grades."""
        if len(self.grades) < 2:
            return np.full(len(x), self.grades[0] if self.grades else 0.0), np.full(len(x), 1.0)
        below = self.below(x)
        share = np.diff(np.column_stack([np.zeros(len(x)), below, np.ones(len(x))]), axis=1)
        return share @ np.array(self.grades), 1 - below[:, (len(self.grades) - 1) // 2]


def fit_arrays(x: np.ndarray, y: np.ndarray) -> Model:
    """Maximum likelihood with a ridge on the weights, by accelerated gradient steps.

    Thresholds are kept in order by being a first one plus exponentials.
    """
    grades = sorted(set(y.tolist()))
    if len(grades) < 2:
        return Model(grades, np.zeros(x.shape[1]), np.zeros(0))
    k = np.searchsorted(grades, y)
    cumulative = np.array([(k <= g).mean() for g in range(len(grades) - 1)])
    base = np.log(cumulative / (1 - cumulative))
    theta = np.concatenate([[base[0]], np.log(np.maximum(np.diff(base), 1e-3))])
    weights, n = np.zeros(x.shape[1]), len(x)

    def ordered(t):
        return np.cumsum(np.concatenate([[t[0]], np.exp(t[1:])]))

    state = [np.zeros_like(weights), np.zeros_like(theta)]
    rates = (2.0, 0.2)
    for _ in range(STEPS):
        cut = ordered(theta)
        margin = (x @ weights.astype(x.dtype)).astype(np.float64)  # x is large: no wider copy of it
        full = np.concatenate([[-np.inf], cut, [np.inf]])
        hi, lo = (1 / (1 + np.exp(-np.clip(full[k + d] - margin, -30, 30))) for d in (1, 0))
        hi, lo = np.where(k + 1 == len(full) - 1, 1.0, hi), np.where(k == 0, 0.0, lo)
        p = np.maximum(hi - lo, 1e-9)
        dhi, dlo = hi * (1 - hi) / p, lo * (1 - lo) / p
        gradient_w = (x.T @ (dlo - dhi).astype(x.dtype)) / n - RIDGE / n * weights
        by_cut = np.array([(dhi[k == g].sum() - dlo[k == g + 1].sum()) / n for g in range(len(cut))])
        gradient_t = np.array([by_cut.sum()] + [np.exp(theta[g]) * by_cut[g:].sum() for g in range(1, len(theta))])
        for i, (value, gradient) in enumerate(((weights, gradient_w), (theta, np.clip(gradient_t, -1, 1)))):
            state[i] = 0.9 * state[i] + rates[i] * gradient
            value += state[i]
        theta[1:] = np.clip(theta[1:], -5, 5)  # thresholds stay apart
    return Model(grades, weights, ordered(theta))


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality") -> Model:
    """Fit on at most about ``train_rows`` graded rows; null grades are ignored, of several for an id the least counts.

    Of rows that repeat an id, one teaches. The ids joined are bounded by ``train_rows`` and may be broadcast; the
    driver gets one packed row of features for each.
    """
    labels = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    chosen = smallest_hashes(labels, id_col, train_rows).groupBy(id_col).agg(F.min(label_col).cast("double").alias("grade_label"))
    rows = one_per_key(docs.select(id_col, F.col(text_col).cast("string").alias("_text")).join(F.broadcast(chosen), id_col), id_col).select(F.col(id_col).cast("long").alias("i"), F.col("_text").alias("text"), "grade_label")

    def pack(batches):
        import pyarrow as pa

        begin("buckets")
        for batch in slices(batches):
            x = features(batch.column(1).to_pylist()).astype(np.float16)
            sparse = [np.flatnonzero(r).astype(np.uint16) for r in x]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([s.tobytes() for s in sparse], pa.binary()), pa.array([r[s].tobytes() for r, s in zip(x, sparse, strict=True)], pa.binary()), batch.column(2)],
                names=["i", "at", "x", "y"],
            )

    tables = Scratch(docs.sparkSession)
    got = tables.write(rows.mapInArrow(pack, "i long, at binary, x binary, y double"), "quality-train").orderBy("i", "at", "x").toLocalIterator()
    index, values, y = [], [], []
    for r in got:
        index.append(np.frombuffer(r["at"], np.uint16))
        values.append(np.frombuffer(r["x"], np.float16))
        y.append(r["y"])
    tables.drop("quality-train")
    x = np.zeros((len(y), WIDTH), dtype=np.float32)
    for row, at, value in zip(x, index, values, strict=True):
        row[at] = value
    del index, values
    return fit_arrays(x, np.array(y))


def grade(docs: DataFrame, model: Model, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, expected_grade and tail_probability (of the upper half of the grades) of every row.

    Null and empty texts are graded by their measures alone, very long ones by
    all their words. Rows that repeat an id or a text give a row each; an empty
    table gives an empty one; only the two named columns are read. Without any
    labelled row all grades are 0 and all tail probabilities 1.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        begin("buckets")
        for batch in slices(batches):
            expected, tail = shared.value.predict(features(batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(expected, pa.float64()), pa.array(tail, pa.float64())], names=["doc_id", "expected_grade", "tail_probability"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, expected_grade double, tail_probability double")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs, labels.where(~held_out(F.col("doc_id"))))
    return grade(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "expected_grade", "tail_probability", (F.col("tail_probability") >= KEEP).alias("kept"))


QUERIES = {"op4_quality_classifier": op4_quality_classifier}
ORACLES: dict[str, str] = {}
