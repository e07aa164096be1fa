"""Best-fit packing of tokenised documents into fixed-length sequences.

A packing depends on lengths only, and there are at most ``capacity`` different
lengths. So the plan is made on a histogram: large items (over a third of the
capacity) are matched, at most two to a bin, the largest with the largest that
still fits; smaller ones go, largest first, to the bins with the smallest gap
that holds them. Bins with equal contents are handled together, as a pattern
with a count, so the work and the size of the plan follow the number of
lengths, not of documents. The cluster then deals pieces to the plan's slots by
their rank among the pieces of their length; ranks come from counts per bucket,
so a length that a third of all pieces share is no single task's work.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import Merges, byte_alphabet
from .common import begin, documents, materialize, remembers, slices

CAPACITY = 2048
#: Chunks, in each of two generations, and words that a worker remembers at most, and the most bytes of one: some 60 MB.
MEMO_ENTRIES, MEMO_BYTES = 100_000, 48
#: Buckets over which ranks within a length are counted.
BUCKETS = 1024


class ChunkIds:
    """Ids of texts, as little-endian 32-bit bytes, by way of remembered chunks.

    The tokenizer drops white space before anything spans it, so the ids of a
    text are those of its chunks between ASCII white space in a row. New chunks
    of ASCII and composed Latin letters, which normalising leaves as they are
    and lower case leaves as long, are cut into words together, and words not
    met before are merged many at a time. Any other chunk is left to the library.
    """

    #: What the library is asked about: other characters, and the beginning of a special token.
    OTHER = re.compile(r"[^ !-~À-ÖØ-öø-įı-ɏ]|<\|")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.young: dict[bytes, bytes] = {b"": b""}
        self.old: dict[bytes, bytes] = {}
        self.words: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, alphabet = spec["model"], byte_alphabet()
        suffix = model.get("end_of_word_suffix") or ""
        split = [x for x in (spec["pre_tokenizer"] or {}).get("pretokenizers", []) if x["type"] == "Split" and x["invert"] and x["behavior"] == "Removed"]
        plain = len(split) == 1 and not any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        if plain and [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and all(c + x in model["vocab"] for c in alphabet for x in ("", suffix)):
            import regex

            self.cut = regex.compile(split[0]["pattern"]["Regex"]).findall
            self.merges = Merges(model["merges"], model["vocab"])
            self.inner, self.last = np.zeros(256, np.int64), np.zeros(256, np.int64)
            for char, byte in alphabet.items():
                self.inner[byte], self.last[byte] = model["vocab"][char], model["vocab"][char + suffix]
        else:
            self.merges = None

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _start(self, letters: np.ndarray) -> np.ndarray:
        ids = self.inner[letters]
        ids[:, -1] = self.last[letters[:, -1]]
        return ids

    def learn(self, chunks: list[bytes]) -> dict[bytes, bytes]:
        """Ids of chunks that aren't remembered."""
        if not chunks:
            return {}
        joined, found = b" ".join(chunks).decode("utf-8"), {}
        if self.merges is None or self.OTHER.search(joined):
            kept, texts = [], []
            for chunk, text in zip(chunks, joined.split(" "), strict=True):
                if self.merges is None or self.OTHER.search(text):
                    found[chunk] = self.encode(text)
                else:
                    kept.append(chunk)
                    texts.append(text)
            chunks, joined = kept, " ".join(texts)
        if not chunks:
            return found
        words = self.cut(joined.lower())
        new = list(set(words).difference(self.words))
        if len(self.words) + len(new) > MEMO_ENTRIES:
            self.words, new = {}, list(set(words))
        self.words.update(zip(new, self.merges.many([w.encode("utf-8") for w in new], self._start), strict=True))
        # chunks end where so many characters of words have gone by
        ids = list(map(self.words.__getitem__, words))
        texts = joined.split(" ")
        last = np.searchsorted(np.cumsum(np.fromiter(map(len, words), np.int64, len(words))), np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts))))
        ends = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))[last].tolist()
        flat = b"".join(ids)
        found.update((chunk, flat[a:b]) for chunk, a, b in zip(chunks, [0, *ends], ends, strict=False))
        return found

    def texts(self, texts, at_once: int = 6_000_000):
        """Ids of each of ``texts`` (a list or an Arrow array of bytes or null) in turn.

        About ``at_once`` bytes of text are cut into chunks at a time; equal
        chunks are looked up once, and the ids of all gathered from these.
        """
        import pyarrow as pa
        import pyarrow.compute as pc

        given = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.binary()), b"")
        for part in slices([pa.RecordBatch.from_arrays([given], ["text"])], 0, max(1, len(given)), at_once):
            split = pc.ascii_split_whitespace(part.column(0).view(pa.string()))
            coded = split.flatten().dictionary_encode()
            chunks, young, old = coded.dictionary.view(pa.binary()).to_numpy(zero_copy_only=False).tolist(), self.young, self.old
            new = set(chunks).difference(young)
            for chunk in new.intersection(old):
                young[chunk] = old[chunk]
            new.difference_update(old)
            young.update(self.learn(list(new)))
            # ids as bytes of one buffer, in the order of the chunks
            taken = pa.array(list(map(young.__getitem__, chunks)), pa.large_binary()).take(coded.indices)
            offsets, flat = taken.buffers()[1:]
            ends = np.cumsum(pc.list_value_length(split).to_numpy())
            ends = np.frombuffer(offsets, np.int64)[ends].tolist()
            flat = memoryview(flat or b"")
            for a, b in zip([0, *ends], ends, strict=False):
                yield bytes(flat[a:b])
            for chunk in [x for x in new if len(x) > MEMO_BYTES]:
                del young[chunk]
            if len(young) > MEMO_ENTRIES:
                self.young, self.old = {b"": b""}, young


#: One of each tokenizer file in a worker, whatever tasks it runs.
_CHUNK_IDS: dict[str, ChunkIds] = {}
remembers("chunks", _CHUNK_IDS.clear)


def chunk_ids(path: str) -> ChunkIds:
    if path not in _CHUNK_IDS:
        _CHUNK_IDS[path] = ChunkIds(path)
    return _CHUNK_IDS[path]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, separator: int = 0, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every row of ``docs``.

    A document's ids end with ``separator``; a null or empty text has that one
    id only. Only a document longer than ``capacity`` is cut; a very long text
    is encoded whole. Rows that repeat an id or a text give pieces each; an
    empty table gives none. Only the two named columns are read.
    """
    end, step = np.array([separator], dtype="<u4").tobytes(), 4 * capacity

    def cut(batches):
        import pyarrow as pa

        begin("chunks")
        memo = chunk_ids(tokenizer)
        for batch in slices(batches, rows=2000, size=8 << 20):
            columns = [[] for _ in range(4)]
            doc_ids = batch.column(0).to_pylist()
            for doc_id, ids in zip(doc_ids, memo.texts(batch.column(1)), strict=True):
                ids += end
                for piece, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    for column, value in zip(columns, (doc_id, piece, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(value)
            doc, piece, length, crc = columns
            start = [p * capacity for p in piece]
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("binary")).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple[int, ...]]]:
    """Patterns (number of bins, lengths in the bin) that hold all items of the histogram.

    Deterministic: it depends on the histogram only.
    """
    left = {n: c for n, c in histogram.items() if c > 0}
    if any(not 0 < n <= capacity for n in left):
        raise ValueError("lengths must be from 1 to the capacity")
    third = capacity // 3
    by_gap: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)
    large = sorted((n for n in left if n > third), reverse=True)
    for a in large:
        # the largest partner that fits; the list is short, so a scan will do
        for b in (n for n in large if n <= min(a, capacity - a)):
            pairs = left[a] // 2 if a == b else min(left[a], left[b])
            if pairs:
                left[a] -= pairs
                left[b] -= pairs
                by_gap[capacity - a - b].append((pairs, (a, b)))
        if left[a]:
            by_gap[capacity - a].append((left[a], (a,)))
            left[a] = 0
    for n in sorted((n for n in left if n <= third), reverse=True):
        count = left[n]
        for gap in range(n, capacity + 1):
            while count and by_gap.get(gap):
                bins, held = by_gap[gap].pop()
                each = gap // n
                full = min(bins, count // each)
                if full:
                    by_gap[gap - each * n].append((full, held + (n,) * each))
                    count -= full * each
                if bins - full:
                    some = min(each, count)
                    if some:
                        by_gap[gap - some * n].append((1, held + (n,) * some))
                        count -= some
                    if bins - full - bool(some):
                        by_gap[gap].append((bins - full - bool(some), held))
                    if not count:
                        break
            if not count:
                break
        each = capacity // n
        if count // each:
            by_gap[capacity - each * n].append((count // each, (n,) * each))
        if count % each:
            by_gap[capacity - count % each * n].append((1, (n,) * (count % each)))
    return sorted((x for group in by_gap.values() for x in group if x[0]), key=lambda x: (x[1], x[0]), reverse=True)


def _slots(patterns: list[tuple[int, tuple[int, ...]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: first rank, first bin and offset of each run of slots."""
    taken: dict[int, int] = defaultdict(int)
    runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    first = 0
    for bins, held in patterns:
        offset = 0
        for n in held:
            runs[n].append((taken[n], first, offset))
            taken[n] += bins
            offset += n
        first += bins
    return {n: tuple(np.array(x, dtype=np.int64) for x in zip(*r, strict=True)) for n, r in runs.items()}


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``items`` (doc_id, piece, length, ...) with sequence_id and offset.

    ``items`` should be a written table: it is read three times. The driver sees
    at most ``capacity`` counts. Rows that repeat another are packed like any row.
    """
    spark = items.sparkSession
    bucket = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(BUCKETS)).cast("int")
    counts = materialize(items.groupBy("length", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n")), "pack-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = spark.sparkContext.broadcast(_slots(plan(histogram, capacity)))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).drop("n")
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")
    ranked = items.withColumn("bucket", bucket).withColumn("within", F.row_number().over(within) - 1).join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("within")).drop("bucket", "before", "within")

    def deal(batches):
        import pyarrow as pa

        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                start, first, place = slots.value[int(length[at[0]])]
                run = np.searchsorted(start, rank[at], side="right") - 1
                sequence[at], offset[at] = first[run] + rank[at] - start[run], place[run]
            out = batch.drop_columns(["rank"])
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(sequence), pa.array(offset)], names=[*out.schema.names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.drop("rank").schema) + ", sequence_id long, offset long"
    return ranked.mapInArrow(deal, schema)


def best_fit_pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pack all rows of ``docs`` (doc_id, text); one row per piece.

    Null and empty texts are pieces of one id. An empty table gives no rows.
    """
    return pack(materialize(pieces(docs, tokenizer or tokenizer_path(), capacity), "pack-pieces"), capacity)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_pack(documents(spark, sf_dir)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


QUERIES = {"op8_best_fit_packing": op8_best_fit_packing}
ORACLES: dict[str, str] = {}
