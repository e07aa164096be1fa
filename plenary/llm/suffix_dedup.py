"""Repeated passages by sparse suffix arrays.

Only suffixes at content-selected positions are kept: a word position is
selected if the hash of the ``GRAM`` words there is the smallest among
``WINDOW`` successive ones (a minimiser). Any passage of ``PASSAGE`` words has a
selected position in every copy, and the same one. A suffix whose gram is seen
once only can't repeat and is dropped.

A stretch is what lies from a selected position to the end of the first gram
that makes ``PASSAGE`` words; stretches that occur twice are repeated passages,
and cover the inside of long copies. Selected positions near the edges of what
they cover, or outside, and those inside that share a gram with one of these,
are sorted by gram and what follows, and compared with their neighbours in
sorted order, which have the longest common continuation; matches are extended
to the left. Sorted by gram and what comes before, the
same is done the other way. The longest reach to either side bounds what a
position can have; where one match has both, it is settled. Elsewhere (one
occurrence has the longest reach to the left, another to the right) all
windows of ``PASSAGE`` words about the gram are compared. So a word is reported
exactly if it lies in a window of ``PASSAGE`` words that occurs elsewhere.

Sorting is a range partitioning by gram and content, so a gram that a third of
all documents hold is dealt over many tasks. The edges of partitions are
compared in a second, small pass. Rows are told apart by id and text, so rows
that share an id and differ in text all count.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, begin, documents, slices
from .ngram_jaccard import _MIX, _WORDS

#: A passage repeats from this many words; grams and windows cover any such passage.
PASSAGE = 50
GRAM = 16
WINDOW = PASSAGE - GRAM + 1
#: Words that a window has beside its gram.
BESIDE = PASSAGE - GRAM


def _grams(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a text, and of the grams that begin at each."""
    split = (text or b"").split()
    words = np.fromiter(map(_WORDS.__getitem__, split), dtype=np.uint64, count=len(split))
    if len(words) < GRAM:
        return words, words[:0]
    # doubling: hashes of 2, 4, 8, 16 words
    hashed, width, i = words, 1, 0
    while width < GRAM:
        hashed = (hashed[:-width] * np.uint64(_MIX[i])) ^ hashed[width:]
        hashed = (hashed ^ (hashed >> np.uint64(31))) * np.uint64(_MIX[i + 1])
        width, i = 2 * width, i + 2
    return words, hashed ^ (hashed >> np.uint64(29))


def minimisers(hashed: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions whose hash is the smallest of a window; a short text has one window. Of equals the last counts."""
    if not len(hashed):
        return np.zeros(0, np.int64)
    if len(hashed) <= window:
        return np.array([len(hashed) - 1 - int(np.argmin(hashed[::-1]))], dtype=np.int64)
    views = np.lib.stride_tricks.sliding_window_view(hashed, window)
    at = []
    for first in range(0, len(views), 20_000):  # bounds what a very long text needs
        some = views[first : first + 20_000]
        at.append(np.arange(first, first + len(some)) + window - 1 - np.argmin(some[:, ::-1], axis=1))
    return np.unique(np.concatenate(at))


def _stretches(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the stretches that begin at each selected position, and their ends; 0 where the text ends before."""
    powers = np.cumprod(np.full(len(words), _MIX[0], dtype=np.uint64)) if len(words) else words
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers, dtype=np.uint64)])
    inverse = np.cumprod(np.full(len(words), pow(_MIX[0], -1, 1 << 64), dtype=np.uint64)) if len(words) else words
    out, ends, last = np.zeros(len(at), np.uint64), np.zeros(len(at), np.int64), np.searchsorted(at, at + BESIDE)
    some = last < len(at)
    first, ends[some] = at[some], at[last[some]] + GRAM
    hashed = (sums[ends[some]] - sums[first]) * inverse[first] + (ends[some] - first).astype(np.uint64)
    out[some] = (hashed ^ (hashed >> np.uint64(32))) * np.uint64(_MIX[1]) | np.uint64(1)
    return out, ends


def _rows(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """doc_id, copy (tells texts of one id apart) and text of the rows with an id."""
    text = F.col(text_col).cast("binary")
    return docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("copy"), text.alias("text"))


def anchors(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, copy, and arrays of the selected positions of every row, their grams, stretches and these' ends; null ids are left out."""

    def run(batches):
        import pyarrow as pa

        begin("words")
        for batch in slices(batches, 2):
            columns = [[] for _ in range(4)]
            for text in batch.column(2).to_pylist():
                words, hashed = _grams(text)
                at = minimisers(hashed)
                stretches, stops = _stretches(words, at)
                for column, value in zip(columns, (at.astype(np.int32), hashed[at].view(np.int64), stretches.view(np.int64), stops.astype(np.int32)), strict=True):
                    column.append(value)
            ends = pa.array(np.cumsum([0] + [len(p) for p in columns[0]]).astype(np.int32))
            flat = [np.concatenate(x) for x in columns]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.ListArray.from_arrays(ends, pa.array(f)) for f in flat)], names=["doc_id", "copy", "positions", "grams", "stretches", "stops"])

    return _rows(docs, text_col, id_col).mapInArrow(run, "doc_id long, copy long, positions array<int>, grams array<long>, stretches array<long>, stops array<int>")


_COVERED = {"starts": "int", "stops": "int", "open": "int", "grams": "long", "inside": "int", "inside_grams": "long"}


def _covered(listed: DataFrame) -> DataFrame:
    """doc_id, copy, what repeated stretches cover (starts, stops), and the held positions that it doesn't settle (open)
    and those that it does (inside), with their grams.

    A position is settled if all windows about its gram lie in what is covered.
    """

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch, columns = whole.slice(at, 2000), [[] for _ in range(6)]
                for grams, stretches in zip(*(batch.column(c).to_pylist() for c in (2, 3)), strict=True):
                    starts, stops = [], []
                    for s in sorted((s["position"], s["stop"]) for s in stretches):
                        if starts and s[0] <= stops[-1]:
                            stops[-1] = max(stops[-1], s[1])
                        else:
                            starts.append(s[0])
                            stops.append(s[1])
                    p = np.array([g["position"] for g in grams], np.int64)
                    k = np.searchsorted(starts, p, side="right") - 1
                    inside = (k >= 0) & (np.array([0, *starts])[k + 1] <= p - BESIDE) & (np.array([0, *stops])[k + 1] >= p + PASSAGE) if starts else np.zeros(len(p), bool)
                    keys = np.array([g["key"] for g in grams], np.int64)
                    for column, value in zip(columns, (starts, stops, p[~inside], keys[~inside], p[inside], keys[inside]), strict=True):
                        column.append(value)
                types = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.list_(t)) for c, t in zip(columns, types, strict=True))], names=["doc_id", "copy", *_COVERED])

    return listed.select("doc_id", "copy", "grams", "stretches").mapInArrow(run, "doc_id long, copy long, " + ", ".join(f"{c} array<{t}>" for c, t in _COVERED.items()))


def _wanted(covered: DataFrame, tables: Scratch) -> DataFrame:
    """doc_id, copy, positions, grams: what is to be compared, open positions and all that share a gram with one.

    A settled position has nothing to learn, but another text may repeat a part
    of what covers it that is too short for a stretch, and meets it only here.
    """
    sought = tables.write(covered.select(F.explode("grams").alias("gram")).distinct(), "sought")  # as with repeated
    inside = covered.select("doc_id", "copy", F.explode(F.arrays_zip("inside", "inside_grams")).alias("i")).select("doc_id", "copy", F.col("i.inside").alias("position"), F.col("i.inside_grams").alias("gram"))
    met = inside.join(sought, "gram").groupBy("doc_id", "copy").agg(F.collect_list(F.struct("position", "gram")).alias("met"))
    both = covered.select("doc_id", "copy", "open", "grams").join(met, ["doc_id", "copy"], "left").where("size(open) > 0 or met is not null")
    more = lambda held, name: F.concat(held, F.coalesce(F.col(f"met.{name}"), F.array().cast(both.schema[held].dataType))).alias(f"{name}s")
    return both.select("doc_id", "copy", more("open", "position"), more("grams", "gram"))


_KEY = ["gram", "doc_id", "copy", "position"]
_KEY_SCHEMA = "gram long, doc_id long, copy long, position int"


def _contexts(texts: DataFrame) -> DataFrame:
    """Of each wanted position: the words after its gram and those before it, in reading order away from it.

    32 bits of a word's hash are kept, of ``BESIDE`` words on either side: all
    that a window about the gram has.
    """

    def run(batches):
        import pyarrow as pa

        begin("words")
        for batch in slices(batches, 2):
            rows = [[] for _ in range(6)]
            for doc, copy, text, wanted, grams in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words, _ = _grams(text)
                short = (words >> np.uint64(32)).astype(">u4")
                for p, gram in zip(wanted, grams, strict=True):
                    values = (gram, doc, copy, p, short[p + GRAM : p + PASSAGE].tobytes(), short[max(0, p - BESIDE) : p][::-1].tobytes())
                    for column, value in zip(rows, values, strict=True):
                        column.append(value)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names=[*_KEY, "after", "before"])

    return texts.mapInArrow(run, f"{_KEY_SCHEMA}, after binary, before binary")


def _common(x: bytes, y: bytes) -> int:
    """Words that two contexts begin with in common."""
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n // 4
    a, b = np.frombuffer(x[:n], np.uint8), np.frombuffer(y[:n], np.uint8)
    return int(np.argmax(a != b)) // 4


def _met(x: tuple, y: tuple) -> tuple[int, int, int, int]:
    """Of two occurrences (..., near, far): the common reach to the near and far side, and both again if they make a passage."""
    near, far = _common(x[0], y[0]), _common(x[1], y[1])
    return (near, far, near, far) if near + far >= BESIDE else (near, far, 0, 0)


def _compared(contexts: DataFrame, near: str, far: str, tables: Scratch) -> DataFrame:
    """By key: ``reach_<near>``, the longest common reach to that side with any occurrence of the gram, and of the
    passages found with neighbours the longest reach to either side, ``<near>_<near>`` and ``<near>_<far>``.

    Sorted by (gram, near, far), the longest is with a neighbour. The first and
    last row of each partition meet their outer neighbours afterwards.
    """
    n = int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["gram", near, far, "doc_id", "copy", "position"]
    ordered = contexts.select(*_KEY, near, far).repartitionByRange(n, *order).sortWithinPartitions(*order)
    names = [f"reach_{near}", f"{near}_{near}", f"{near}_{far}"]
    best = lambda a, b: [max(x, y) for x, y in zip(a, (b[0], b[2], b[3]), strict=True)]

    def run(batches):
        import pyarrow as pa

        types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        out = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[*_KEY, *names, "edge_near", "edge_far"])
        last, first = None, True  # key, contexts, best so far
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                rows = []
                for *key, x, y in zip(*(c.to_pylist() for c in whole.slice(at, 2000).columns), strict=True):
                    mine = [0, 0, 0]
                    if last is not None:
                        if last[0][0] == key[0]:
                            met = _met(last[1], (x, y))
                            mine, last[2][:] = best(mine, met), best(last[2], met)
                        rows.append((*last[0], *last[2], *(last[1] if first else (None, None))))
                        first = False
                    last = (key, (x, y), mine)
                if rows:
                    yield out(rows)
        if last is not None:
            yield out([(*last[0], *last[2], *last[1])])

    schema = f"{_KEY_SCHEMA}, " + ", ".join(f"{c} int" for c in names)
    found = tables.write(ordered.mapInArrow(run, f"{schema}, edge_near binary, edge_far binary"), f"compared-{near}")

    def again(batches):
        import pyarrow as pa

        last, rows = None, []
        for batch in batches:
            for *key, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                mine = [0, 0, 0]
                if last is not None and last[0][0] == key[0]:
                    met = _met(last[1], (x, y))
                    mine, last[2][:] = best(mine, met), best(last[2], met)
                last = (key, (x, y), mine)
                rows.append(last)
        if rows:
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*((*k, *b) for k, _, b in rows), strict=True), types, strict=True)], names=[*_KEY, *names])

    # at most two rows a partition are edges
    edges = found.where("edge_near is not null").select(*_KEY, F.col("edge_near").alias(near), F.col("edge_far").alias(far)).coalesce(1).sortWithinPartitions(*order)
    outer = tables.write(edges.mapInArrow(again, schema), f"edges-{near}")
    both = found.drop("edge_near", "edge_far").join(outer.select(*_KEY, *(F.col(c).alias(f"outer_{c}") for c in names)), _KEY, "left")
    return both.select(*_KEY, *(F.greatest(c, F.coalesce(f"outer_{c}", F.lit(0))).alias(c) for c in names))


def _windows(contexts: DataFrame) -> DataFrame:
    """Hashes of the windows about each gram that its reaches (reach_before, reach_after) let repeat; left is how many words precede the gram."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch, rows = whole.slice(at, 1000), [[] for _ in range(5)]
                for gram, doc, copy, p, after, before, right, left in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    for d in range(max(0, BESIDE - right), min(BESIDE, left) + 1):
                        key = xxhash.xxh3_64_intdigest(before[: 4 * d] + after[: 4 * (BESIDE - d)], (gram ^ d * _MIX[2]) & (1 << 64) - 1) - (1 << 63)
                        for column, value in zip(rows, (key, doc, copy, p, d), strict=True):
                            column.append(value)
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names=["key", "doc_id", "copy", "position", "left"])

    return contexts.select(*_KEY, "after", "before", "reach_after", "reach_before").mapInArrow(run, "key long, doc_id long, copy long, position int, left int")


def repeated_passages(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, copy, start_word, end_word (exclusive) of the passages of each document that occur elsewhere too.

    A word belongs to a passage if it is in a window of ``PASSAGE`` words that
    occurs at another place, in another document or in the same one; passages
    are maximal runs of such words. Words are runs without ASCII white space,
    compared exactly. Nothing is removed: what to cut is the caller's choice.

    Null texts and ids, and texts of fewer words, have none; long texts are read
    whole. Of rows that share an id, all different texts count, told apart by
    ``copy``, a hash of the text; rows that repeat id and text are one row. An
    empty table gives an empty one. Only the two named columns are read.
    """
    with Scratch(docs.sparkSession) as tables:
        base = tables.write(anchors(docs, text_col, id_col).dropDuplicates(["doc_id", "copy"]), "anchors")
        grams = F.zip_with("positions", "grams", lambda p, k: F.struct(p.alias("position"), k.alias("key"), F.lit(0).alias("stop")))
        stretches = F.zip_with("positions", F.arrays_zip("stretches", "stops"), lambda p, k: F.struct(p.alias("position"), k["stretches"].alias("key"), k["stops"].alias("stop")))
        keys = base.select("doc_id", "copy", F.explode(F.concat(grams, F.filter(stretches, lambda s: s["key"] != 0))).alias("k")).select("doc_id", "copy", "k.*")
        # written, so that a key that very many rows hold can be split in the join
        repeated = tables.write(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "repeated")
        held = keys.join(repeated, "key")
        listed = held.groupBy("doc_id", "copy").agg(
            F.collect_list(F.when(F.col("stop") == 0, F.struct("position", "key"))).alias("grams"), F.collect_list(F.when(F.col("stop") > 0, F.struct("position", "stop"))).alias("stretches")
        )
        covered = tables.write(_covered(listed), "covered")
        tables.drop("anchors", "repeated")
        texts = _rows(docs, text_col, id_col).join(_wanted(covered, tables), ["doc_id", "copy"]).dropDuplicates(["doc_id", "copy"]).select("doc_id", "copy", "text", "positions", "grams")
        contexts = tables.write(_contexts(texts), "contexts")
        tables.drop("sought")
        right, left = _compared(contexts, "after", "before", tables), _compared(contexts, "before", "after", tables)
        reach = right.join(left, _KEY).where(F.col("reach_after") + F.col("reach_before") >= BESIDE)
        reach = tables.write(reach.withColumn("to_left", F.greatest("after_before", "before_before")).withColumn("to_right", F.greatest("after_after", "before_after")), "reach")
        tables.drop("compared-after", "compared-before", "edges-after", "edges-before")
        # one occurrence reaches farthest to the left, another to the right: all windows between are looked at
        unsettled = reach.where((F.col("to_left") < F.col("reach_before")) | (F.col("to_right") < F.col("reach_after"))).select("gram").distinct()
        windows = _windows(contexts.join(reach.join(unsettled, "gram").select(*_KEY, "reach_after", "reach_before"), _KEY))
        windows = tables.write(windows, "windows")
        twice = tables.write(windows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "twice")
        there = windows.join(twice, "key").groupBy("doc_id", "copy", "position").agg(F.max("left").alias("l"), F.min("left").alias("r"))
        span = lambda l, r: (F.col("position") - l).alias("start_word"), lambda l, r: (F.col("position") + GRAM + r).alias("end_word")
        row = ["doc_id", "copy"]
        settled = reach.where(F.col("to_left") + F.col("to_right") >= BESIDE).select(*row, *(f(F.col("to_left"), F.col("to_right")) for f in span))
        between = there.select(*row, *(f(F.col("l"), BESIDE - F.col("r")) for f in span))
        inside = covered.select(*row, F.explode(F.arrays_zip("starts", "stops")).alias("s")).select(*row, F.col("s.starts").alias("start_word"), F.col("s.stops").alias("end_word"))
        spans = tables.write(settled.union(between).union(inside), "spans")
        tables.drop("contexts", "reach", "windows", "twice", "covered")
        order = Window.partitionBy(*row).orderBy("start_word", "end_word")
        seen = F.max("end_word").over(order.rowsBetween(Window.unboundedPreceding, -1))
        runs = spans.withColumn("new", F.coalesce(F.col("start_word") > seen, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(order))
        return runs.groupBy(*row, "run").agg(F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word")).drop("run")


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_passages(documents(spark, sf_dir))
    return found.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"))


QUERIES = {"op3_suffix_array_dedup": op3_suffix_array_dedup}
ORACLES: dict[str, str] = {}
