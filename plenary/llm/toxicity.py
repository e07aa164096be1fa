"""Toxicity scores from a weighted finite-state pattern grammar.

A text is read as a string of word classes. A lexical transducer maps words to
classes (insult, threat, target, negation, reported speech, quote mark, end of
a clause, other); insult arcs and their weights are learned from labelled rows.
Transducers for negation, reported speech, target and threat each track their
own scope; their composition, worked out once as a table, rewrites an insult
into a plain, negated, reported or targeted one. A clause scores the weights of
what it matched, times the factor of its reading; a text is scored by its worst
clause and by all of them, through a logistic function fitted on the same rows.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, begin, documents, held_out, one_per_key, slices, smallest_hashes

#: Labelled rows that a model is fitted on at most (those of smallest hashed id).
TRAIN_ROWS = 20_000
#: An insult arc needs so many different words after it in toxic texts, and such odds (natural log).
CONTEXTS, LOG_ODDS = 6, 3.0
#: Lengths of word beginnings that may be arcs, besides whole words.
STEMS = (4, 5, 6)
#: Tokens that a task remembers at most, and the most characters of one: some 60 MB.
MEMO_ENTRIES, MEMO_CHARS = 200_000, 40

OTHER, END, TARGET, NEGATION, REPORT, QUOTE, THREAT, INSULT = range(8)

#: Function words of the grammar, in English, French, German and Spanish.
CLASSES = {
    TARGET: "you your u he she they them him her those these tu vous te toi ton votre ils elles leur du dich dir euch ihr sie vosotros ustedes usted ellos ellas tú",
    NEGATION: "not no never isn't aren't wasn't don't doesn't cannot nobody nothing ne pas jamais aucun nicht kein keine nie nunca jamás tampoco",
    REPORT: "said says say saying claimed claims wrote writes called calls quoted reported alleged dit disait appelé sagte sagt nannte schrieb dijo dice llamó escribió",
    THREAT: "kill hurt beat destroy murder shoot stab burn tuer frapper brûler töten schlagen umbringen matar golpear quemar",
}
QUOTES, ENDS, EDGES = "\"“”«»„", ".!?;:|", "\"“”«»„.,!?;:|()[]{}<>*#$%&'`-_~"

#: Factors of an insult by its reading, and the weight of a threat at a target.
NEGATED, REPORTED, TARGETED, THREATENED = 0.4, 0.5, 1.25, 5.0


class Scope:
    """A transducer whose state is how many more symbols its scope lasts."""

    def __init__(self, opener: int, length: int, clause: bool = False):
        self.opener, self.length, self.clause = opener, length, clause

    def step(self, state: int, symbol: int) -> int:
        if symbol == self.opener:
            return self.length
        if symbol == END:
            return 0
        return state if self.clause else max(0, state - 1)


class Quoted:
    """A transducer whose state is whether a quotation is open; a clause's end closes it."""

    def step(self, state: int, symbol: int) -> int:
        return 1 - state if symbol == QUOTE else 0 if symbol == END else state


def compose() -> tuple[list[list[int]], list[list[tuple[float, float]]]]:
    """Next state, and (factor of an insult, weight added), by state and symbol of the composition."""
    parts = [Scope(NEGATION, 3), Scope(REPORT, 1, clause=True), Quoted(), Scope(TARGET, 4), Scope(THREAT, 4)]
    number, table, outputs, queue = {(0,) * 5: 0}, [], [], [(0,) * 5]
    for state in queue:
        nexts, gives = [], []
        for symbol in range(8):
            after = tuple(p.step(s, symbol) for p, s in zip(parts, state, strict=True))
            if after not in number:
                number[after] = len(queue)
                queue.append(after)
            nexts.append(number[after])
            negated, reported, quoted, target, threat = state
            factor = (NEGATED if negated else 1) * (REPORTED if reported or quoted else 1) * (TARGETED if target else 1)
            hit = symbol == TARGET and threat or symbol == THREAT and target
            gives.append((factor if symbol == INSULT else 0.0, THREATENED * factor if hit else 0.0))
        table.append(nexts)
        outputs.append(gives)
    return table, outputs


@dataclass
class Grammar:
    words: dict[str, float] = field(default_factory=dict)  # insult arcs: whole words
    stems: dict[str, float] = field(default_factory=dict)  # insult arcs: word beginnings
    coefficients: tuple[float, float, float] = (-4.0, 1.0, 0.0)


class Scorer:
    """Clause scores of texts under a grammar."""

    def __init__(self, grammar: Grammar):
        self.grammar = grammar
        self.classes = {w: c for c, words in CLASSES.items() for w in words.split()}
        self.table, self.outputs = compose()
        self.memo: dict[str, tuple[tuple[int, float], ...]] = {}

    def symbols(self, token: str) -> tuple[tuple[int, float], ...]:
        """Classes of a token between white space: opening quote, word, closing quote, end."""
        word = token.strip(EDGES).lower()
        out = [(QUOTE, 0.0)] if token[0] in QUOTES else []
        weight = self.grammar.words.get(word, 0.0)
        for n in STEMS:
            weight = max(weight, self.grammar.stems.get(word[:n], 0.0))
        if weight:
            out.append((INSULT, weight))
        elif word:
            out.append((self.classes.get(word, OTHER), 0.0))
        if len(token) > 1 and token.rstrip(ENDS)[-1:] in tuple(QUOTES):
            out.append((QUOTE, 0.0))
        if token[-1] in ENDS:
            out.append((END, 0.0))
        found = tuple(out)
        if len(token) <= MEMO_CHARS:
            if len(self.memo) >= MEMO_ENTRIES:
                self.memo = {}
            self.memo[token] = found
        return found

    def clauses(self, text: str | None) -> list[float]:
        """Scores of the clauses that match anything. Each line begins a new clause."""
        scores, get = [], self.memo.get
        for line in (text or "").split("\n"):
            tokens = [get(t) or self.symbols(t) for t in line.split()]
            if not any(s[0] >= THREAT for t in tokens for s in t):
                continue
            state, score = 0, 0.0
            for token in tokens:
                for symbol, weight in token:
                    factor, added = self.outputs[state][symbol]
                    score += factor * weight + added
                    state = self.table[state][symbol]
                    if symbol == END and score:
                        scores.append(score)
                        score = 0.0
            if score:
                scores.append(score)
        return scores

    def features(self, text: str | None) -> tuple[float, float]:
        clauses = self.clauses(text)
        return (max(clauses), float(np.log1p(sum(clauses)))) if clauses else (0.0, 0.0)

    def score(self, text: str | None) -> float:
        a, b, c = self.grammar.coefficients
        x, y = self.features(text)
        return float(1 / (1 + np.exp(-np.clip(a + b * x + c * y, -30, 30))))


def _arcs(text: str | None):
    """(arc, word after it) of a text: whole words, and beginnings marked with a star."""
    words = [w for t in (text or "").split() if (w := t.strip(EDGES).lower()) and w[0].isalpha()]
    for word, after in zip(words, [*words[1:], ""], strict=True):
        yield word, after
        for n in STEMS:
            if len(word) > n:
                yield word[:n] + "*", after


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 30) -> tuple[float, ...]:
    """Coefficients of a ridge-regularised logistic regression, by Newton steps; the slopes are kept positive."""
    design, beta = np.column_stack([np.ones(len(x)), x]), np.zeros(x.shape[1] + 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        h = design.T @ (design * (p * (1 - p) + 1e-6)[:, None]) + ridge * np.eye(len(beta))
        beta = beta + np.linalg.solve(h, design.T @ (y - p) - ridge * beta)
    return tuple(float(b) if i == 0 else max(0.0, float(b)) for i, b in enumerate(beta))


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic") -> Grammar:
    """Learn insult arcs and the final function from at most about ``train_rows`` labelled rows.

    Null labels and ids are ignored; an id labelled more than once is toxic if
    any label is; of rows that repeat an id, one teaches. So rows and ids are
    bounded by ``train_rows``, and the ids may be broadcast. Without toxic or
    without clean rows the grammar has no insult arcs. Null, empty and very long
    texts are read like any, whole.
    """
    labels = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    chosen = smallest_hashes(labels, id_col, train_rows).groupBy(id_col).agg((F.max(label_col) > 0).alias("toxic_label"))
    rows = one_per_key(docs.select(id_col, F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), id_col), id_col)
    with Scratch(docs.sparkSession) as tables:
        grammar = _learned(tables.write(rows.select("text", F.col("toxic_label").cast("int").alias("y")), "toxicity-train"))
        tables.drop("toxicity-train")
    return grammar


def _learned(rows: DataFrame) -> Grammar:
    """The grammar that labelled ``rows`` (text, y) teach."""

    def contexts(batches):
        import pyarrow as pa

        begin()
        for batch in slices(batches, 0):
            arcs = sorted({pair for text in batch.column(0).to_pylist() for pair in _arcs(text)})
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in arcs], pa.string()), pa.array([c for _, c in arcs], pa.string())], names=["arc", "after"])

    counted = rows.where("y = 1").select("text").mapInArrow(contexts, "arc string, after string").distinct().groupBy("arc").agg(F.count(F.lit(1)).alias("n"))
    candidates = [r["arc"] for r in counted.where(F.col("n") >= CONTEXTS).select("arc").collect()]
    shared = rows.sparkSession.sparkContext.broadcast(frozenset(candidates))

    def weigh(batches):
        import pyarrow as pa

        begin()
        counts: dict[str, list[int]] = defaultdict(lambda: [0, 0])  # candidates only
        for batch in slices(batches, 0):
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for arc in {a for a, _ in _arcs(text)} & shared.value:
                    counts[arc][y] += 1
        kept = list(counts.items())
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in kept], pa.string()), *(pa.array([v[i] for _, v in kept], pa.int64()) for i in (0, 1))], names=["arc", "clean", "toxic"])

    clean, toxic = rows.agg(F.count(F.when(F.col("y") == 0, 1)), F.count(F.when(F.col("y") == 1, 1))).first()
    if not clean or not toxic:
        return Grammar()
    sums = rows.mapInArrow(weigh, "arc string, clean long, toxic long").groupBy("arc").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
    odds = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("c") + 0.5) / (clean + 1))
    best = {r["arc"]: r["odds"] for r in sums.select("arc", odds.alias("odds")).where(F.col("odds") >= LOG_ODDS).orderBy("arc").collect()}
    grammar = Grammar({a: w for a, w in best.items() if a[-1] != "*"}, {a[:-1]: w for a, w in best.items() if a[-1] == "*"})
    shared_grammar = rows.sparkSession.sparkContext.broadcast(grammar)

    def features(batches):
        import pyarrow as pa

        begin()
        scorer = Scorer(shared_grammar.value)
        for batch in slices(batches, 0):
            found = [scorer.features(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.float64()), pa.array([y for _, y in found], pa.float64()), batch.column(1)], names=["worst", "total", "y"])

    points = rows.mapInArrow(features, "worst double, total double, y int").groupBy("worst", "total", "y").count().orderBy("worst", "total", "y").collect()
    data = np.array([r[:3] for r in points for _ in range(r["count"])])
    grammar.coefficients = _logistic(data[:, :2], data[:, 2])
    return grammar


def toxicity(docs: DataFrame, grammar: Grammar, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, score, worst_clause and clauses (how many match) of every row.

    Null and empty texts match nothing and have the lowest score. Texts of any
    length are read whole. Rows that repeat an id or a text give a row each; an
    empty table gives an empty one. Only the two named columns are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(grammar)

    def run(batches):
        import pyarrow as pa

        begin()
        scorer = Scorer(shared.value)
        for batch in slices(batches):
            found = [scorer.clauses(t) for t in batch.column(1).to_pylist()]
            a, b, c = scorer.grammar.coefficients
            worst = np.array([max(x, default=0.0) for x in found])
            total = np.log1p([sum(x) for x in found]) if found else np.zeros(0)
            score = 1 / (1 + np.exp(-np.clip(a + b * worst + c * total, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array(worst), pa.array([len(x) for x in found], pa.int32())], names=["doc_id", "score", "worst_clause", "clauses"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, score double, worst_clause double, clauses int")


def without_toxic(docs: DataFrame, grammar: Grammar, threshold: float | None = None, text_col: str = "text") -> DataFrame:
    """``docs``, all columns, without the rows that score ``threshold`` or more.

    Null and empty texts are scored like any. Rows are judged one by one, so
    repeated ones stay or go together. Columns keep their names and places.
    """
    shared, limit, at = docs.sparkSession.sparkContext.broadcast(grammar), THRESHOLD if threshold is None else threshold, docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        begin()
        scorer = Scorer(shared.value)
        for batch in slices(batches, at):
            texts = batch.column(at).to_pylist()
            yield batch.filter(pa.array([scorer.score(t) < limit for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def trained(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Grammar:
    """The grammar learned from all labelled rows that aren't held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return fit(docs, labels.where(~held_out(F.col("doc_id"))))


#: A text is taken for toxic from this score.
THRESHOLD = 0.3


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity(docs, trained(spark, docs, sf_dir)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


QUERIES = {"op6_toxicity": op6_toxicity}
ORACLES: dict[str, str] = {}
