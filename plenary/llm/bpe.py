"""Byte-level BPE encoding and decoding by way of a transducer lexicon.

The frequent words of the corpus are compiled, with their ids as outputs, into
a minimal acyclic automaton that shares suffixes: arcs carry how many words lie
before theirs, so the sum along a path numbers the word and finds its ids. The
file goes to executors with ``addFile``; workers of an executor map it into
memory, so they share one copy of its pages. A word that it lacks is merged
exactly, pair by pair in order of rank. The lexicon decides speed only: ids are
the same with any lexicon, an empty one too.

Both run on many words at once: those of a batch that aren't remembered are
walked through the automaton byte by byte together, and those it lacks are
merged together, words of one length side by side. Ids are decoded in the same
pass, from the array that is returned.

Counting covers all texts. Each task sums up its part by its most frequent
words, the sums meet in an aggregate, and only the ``LEXICON_WORDS`` best reach
the driver; the automaton's size is bounded by that and by ``WORD_BYTES``.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import re
from array import array
from collections import Counter, defaultdict
from operator import itemgetter

import numpy as np
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import begin, documents, remembers, shared_dir, slices

LEXICON_WORDS, WORD_BYTES = 65_536, 40
#: Words that a task reports of its texts, and how many it counts before it drops the rarest.
REPORTED, COUNTED = 32_768, 300_000
#: Pieces of text that a worker remembers at most, in each of two generations, and the most characters of one.
MEMO_ENTRIES, MEMO_CHARS = 400_000, 40
#: Characters of text, and rows, that are encoded at once.
AT_ONCE, ROWS_AT_ONCE = 4_000_000, 1000
#: Words up to this many bytes are merged side by side, longer ones each with a heap.
SCAN_BYTES = 48


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in vocabulary files, as a map back to bytes.

    Printable Latin-1 characters stand for themselves; the other bytes, in
    order, take the code points from 256.
    """
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


def _by_length(words: list[bytes]):
    """(length, places) of the words, by their length; empty words are left out."""
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    for places in np.split(order, cuts) if len(order) else ():
        if lengths[places[0]]:
            yield int(lengths[places[0]]), places


class PairTable:
    """Ranks of pairs of ids, looked up many at once: a hash table with linear probing."""

    def __init__(self, ranks: dict[int, int], none: int):
        self.none, self.bits = none, max(4, (4 * len(ranks)).bit_length())
        self.keys, self.ranks = np.full(1 << self.bits, -1, dtype=np.int64), np.full(1 << self.bits, none, dtype=np.int64)
        keys, values = np.array(list(ranks), dtype=np.int64), np.array(list(ranks.values()), dtype=np.int64)
        at = self._slots(keys)
        while len(keys):
            free = self.keys[at] < 0
            slots, first = np.unique(at[free], return_index=True)
            took = np.flatnonzero(free)[first]
            self.keys[slots], self.ranks[slots] = keys[took], values[took]
            rest = np.ones(len(keys), bool)
            rest[took] = False
            keys, values, at = keys[rest], values[rest], (at[rest] + 1) & (len(self.keys) - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).view(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks; ``none`` where a pair doesn't merge."""
        keys = (left << 32 | right).ravel()
        at = self._slots(keys)
        held, found = self.keys[at], self.ranks[at]
        open_ = np.flatnonzero((held != keys) & (held >= 0))
        found[held != keys] = self.none
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
            held = self.keys[at[open_]]
            same = held == keys[open_]
            found[open_[same]] = self.ranks[at[open_[same]]]
            open_ = open_[~same & (held >= 0)]
        return found.reshape(left.shape)


class Merges:
    """Exact merging: the pair of lowest rank first, of equals the leftmost."""

    def __init__(self, merges: list, ids: dict[str, int]):
        self.ranks: dict[int, int] = {}  # by pair, as one number
        self.made: list[int] = []  # by rank
        for rank, pair in enumerate(merges):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks.setdefault(ids[a] << 32 | ids[b], rank)
            self.made.append(ids[a + b])
        self.pairs, self.made_array = PairTable(self.ranks, len(self.made)), np.array(self.made, dtype=np.int64)

    def many(self, words: list[bytes], start) -> list[bytes]:
        """Ids of each word as little-endian 32-bit bytes; ``start`` gives the ids of a matrix of bytes before any merge.

        Words of one length are the rows of a matrix. Each step merges the best
        pair of every row that has one, so rows that go on stay equally long.
        """
        out: list[bytes] = [b""] * len(words)
        for length, at in _by_length(words):
            places = at.tolist()
            if length > SCAN_BYTES:
                for place in places:
                    ids = start(np.frombuffer(words[place], np.uint8)[None, :])[0].tolist()
                    out[place] = array("I", self.one(ids)).tobytes()
                continue
            ids = start(np.frombuffer(b"".join([words[i] for i in places]), np.uint8).reshape(len(places), length))
            ranks, none = self.pairs(ids[:, :-1], ids[:, 1:]), len(self.made)
            while len(at):
                width = ids.shape[1]
                best = ranks.argmin(axis=1) if width > 1 else np.zeros(len(at), np.int64)
                rank = ranks[np.arange(len(at)), best] if width > 1 else np.full(len(at), none)
                done = rank >= none
                if done.any():
                    flat, step = ids[done].astype("<u4").tobytes(), 4 * width
                    for k, place in enumerate(at[done].tolist()):
                        out[place] = flat[step * k : step * (k + 1)]
                    goes = ~done
                    at, ids, ranks, best, rank = at[goes], ids[goes], ranks[goes], best[goes], rank[goes]
                    if not len(at):
                        break
                rows = np.arange(len(at))
                ids[rows, best] = self.made_array[rank]
                ids = ids[np.arange(width) != best[:, None] + 1].reshape(len(at), width - 1)
                ranks = ranks[np.arange(width - 1) != best[:, None]].reshape(len(at), width - 2)
                before, after = rows[best > 0], rows[best < width - 2]
                ranks[before, best[before] - 1] = self.pairs(ids[before, best[before] - 1], ids[before, best[before]])
                ranks[after, best[after]] = self.pairs(ids[after, best[after]], ids[after, best[after] + 1])
        return out

    def one(self, ids: list[int]) -> list[int]:
        """Merges one list of ids, with a heap."""
        rank_of, made = self.ranks.get, self.made
        none = len(made)
        n = len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i) for i in range(n - 1) if (r := rank_of(ids[i] << 32 | ids[i + 1], none)) < none]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j < 0 or rank_of(ids[i] << 32 | ids[j], none) != rank:
                continue  # one of the two was merged with another meanwhile
            ids[i], ids[j], after[i] = made[rank], -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right >= 0 and (r := rank_of(ids[left] << 32 | ids[right], none)) < none:
                    heapq.heappush(heap, (r, left))
        return [x for x in ids if x >= 0]


class Vocabulary:
    """Merges, ids and bytes of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, alphabet = spec["model"], byte_alphabet()
        if spec.get("normalizer") or model.get("byte_fallback") or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError("only plain byte-level BPE is supported")
        ids = model["vocab"]
        self.byte_ids = [0] * 256
        for char, byte in alphabet.items():
            self.byte_ids[byte] = ids[char]
        self.byte_array = np.array(self.byte_ids, dtype=np.int64)
        self.merges = Merges(model["merges"], ids)
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*ids.values(), *self.added.values()]) + 1
        self.bytes = [b""] * size
        for token, i in ids.items():
            self.bytes[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode("utf-8")
        for token, i in self.added.items():
            self.bytes[i] = token.encode("utf-8")
        # Contractions, then letters, digits or other marks with a space before them, then white space.
        self.words = regex.compile(r"'(?:[stmd]|re|ve|ll)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
        marks = sorted(map(regex.escape, self.added), key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(marks) + ")") if marks else None

    def merge_many(self, words: list[bytes]) -> list[bytes]:
        return self.merges.many(words, self.byte_array.__getitem__)

    def merge(self, word: bytes) -> list[int]:
        return self.merges.one([self.byte_ids[b] for b in word])


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """A minimal acyclic automaton over the words, with their ids, as the bytes of a file.

    Words are added in sorted order; whenever a branch is left, its nodes are
    replaced by equal ones that exist, from the end, so suffixes are shared.
    """
    words = sorted(w for w in entries if w)
    # a node: [final, labels, targets]; words below it, by number
    nodes: list[tuple[bool, bytes, tuple[int, ...]]] = []
    known: dict[tuple[bool, bytes, tuple[int, ...]], int] = {}
    path: list[list] = [[False, bytearray(), []]]  # open nodes along the last word

    def close(depth: int) -> None:
        while len(path) > depth:
            final, labels, targets = path.pop()
            key = (final, bytes(labels), tuple(targets))
            if key not in known:
                known[key] = len(nodes)
                nodes.append(key)
            if path:
                path[-1][2].append(known[key])

    last = b""
    for word in words:
        common = 0
        while common < min(len(word), len(last)) and word[common] == last[common]:
            common += 1
        close(common + 1)
        for byte in word[common:]:
            path[-1][1].append(byte)
            path.append([False, bytearray(), []])
        path[-1][0] = True
        last = word
    close(0)
    below = []  # targets have smaller numbers
    for final, _, targets in nodes:
        below.append(final + sum(below[t] for t in targets))
    keys, targets, skips = [], [], []
    for number, (final, node_labels, node_targets) in enumerate(nodes):
        skip = int(final)
        for label, target in zip(node_labels, node_targets, strict=True):
            keys.append(number << 8 | label)
            targets.append(target)
            skips.append(skip)
            skip += below[target]
    flat = [i for w in words for i in entries[w]]
    ends = np.cumsum([0] + [len(entries[w]) for w in words])
    sections = [np.array(x, dtype="<u4").tobytes() for x in (keys, targets, skips, [f for f, _, _ in nodes], ends, flat)]
    head = np.array([len(nodes), *map(len, sections)], dtype="<u8").tobytes()
    return head + b"".join(sections)


class Lexicon:
    """A compiled lexicon, mapped into memory: arcs sorted by node and label, each with its target and the words before it."""

    def __init__(self, buffer):
        head = np.frombuffer(buffer, dtype="<u8", count=7)
        self.root, at, parts = int(head[0]) - 1, 56, []
        for size in head[1:].tolist():
            parts.append(np.frombuffer(buffer, dtype="<u4", count=size // 4, offset=at))
            at += size
        self.keys, self.targets, self.skips, self.finals, self.ends, self.flat = parts

    @classmethod
    def mapped(cls, path: str) -> Lexicon:
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def many(self, words: list[bytes]) -> list[bytes | None]:
        """Ids of each word as little-endian 32-bit bytes; None for those that aren't words of the lexicon."""
        out: list[bytes | None] = [None] * len(words)
        if not len(self.keys):
            return out
        flat = self.flat.tobytes()
        for length, at in _by_length(words):
            if length > WORD_BYTES:
                continue
            letters = np.frombuffer(b"".join([words[i] for i in at.tolist()]), np.uint8).reshape(len(at), length)
            node, number = np.full(len(at), self.root, np.uint32), np.zeros(len(at), np.int64)
            for k in range(length):
                key = node << np.uint32(8) | letters[:, k]
                arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                goes = self.keys[arc] == key
                at, letters, arc, number = at[goes], letters[goes], arc[goes], number[goes]
                node, number = self.targets[arc], number + self.skips[arc]
            ends = self.finals[node] > 0
            number = number[ends]
            for place, a, b in zip(at[ends].tolist(), self.ends[number].tolist(), self.ends[number + 1].tolist(), strict=True):
                out[place] = flat[4 * a : 4 * b]
        return out

    def ids(self, word: bytes) -> bytes | None:
        return self.many([word])[0]


class Encoder:
    """Ids of texts: pieces are remembered; words of others are looked up in the lexicon, or else merged."""

    #: A space before white space or the end doesn't begin a word.
    LOOSE = re.compile(r" (?:\s|\Z)")

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None = None):
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.young: dict[str, bytes] = {}  # ids of pieces that follow a space, without it
        self.old: dict[str, bytes] = {}
        self.asked = self.answered = 0  # words looked up in the lexicon, and found there

    def words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of each different word."""
        new = list(dict.fromkeys(words))
        raw = [w.encode("utf-8") for w in new]
        found = self.lexicon.many(raw) if self.lexicon else [None] * len(raw)
        missing = [i for i, ids in enumerate(found) if ids is None]
        self.asked += len(raw)
        self.answered += len(raw) - len(missing)
        for i, ids in zip(missing, self.vocabulary.merge_many([raw[i] for i in missing]), strict=True):
            found[i] = ids
        return dict(zip(new, found, strict=True))

    def whole(self, texts: list[str]) -> list[bytes]:
        """Ids of strings that aren't cut at spaces first."""
        split = [self.vocabulary.words(t) for t in texts]
        known = self.words([w for words in split for w in words])
        return [b"".join(map(known.__getitem__, words)) for words in split]

    def learn(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of pieces that follow a space. All are cut into words at once, since a word begins at each of the spaces."""
        words = self.vocabulary.words(" " + " ".join(pieces)) if pieces else []
        known = self.words(words)
        ends = np.searchsorted(np.cumsum([len(w) for w in words]), np.cumsum([len(p) + 1 for p in pieces]), side="right").tolist()
        found, start = {}, 0
        for piece, end in zip(pieces, ends, strict=True):
            found[piece] = known[words[start]] if end == start + 1 else b"".join(map(known.__getitem__, words[start:end]))
            start = end
        return found

    def plain(self, texts: list[str]) -> list[bytes]:
        """Ids of texts without special tokens. A word always begins at a space before other than white space."""
        split, loose = [], []  # of each text: what is taken whole, and the pieces that follow a space each
        for text in texts:
            if self.LOOSE.search(text) is None:
                first, *pieces = text.split(" ")
                loose.append([first])
                split.append(pieces)
            else:
                whole, last = [], None
                for piece in text.split(" "):
                    if last is None:
                        last = piece
                    elif not piece or piece[0].isspace():
                        last += " " + piece
                    else:
                        whole.append(last)
                        last = " " + piece
                loose.append([*whole, last])
                split.append([])
        wholes = list({w for some in loose for w in some if w})
        bare = dict(zip(wholes, self.whole(wholes), strict=True)) | {"": b""}
        needed, young, old = set().union(*split), self.young, self.old
        new = needed.difference(young)
        for piece in new.intersection(old):
            young[piece] = old[piece]
        new.difference_update(old)
        found = self.learn(list(new))
        young.update(found)
        out = [b"".join([bare[w] for w in some] + [young[p] for p in pieces]) for some, pieces in zip(loose, split, strict=True)]
        for piece in [p for p in found if len(p) > MEMO_CHARS]:
            del young[piece]
        if len(young) > MEMO_ENTRIES:
            self.young, self.old = {}, young
        return out

    def texts(self, texts: list[str | None]):
        """Ids of each text in turn, as bytes; about ``AT_ONCE`` characters are handled together."""
        special, added, at = self.vocabulary.special, self.vocabulary.added, 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end] or "") <= AT_ONCE):
                size += len(texts[end] or "")
                end += 1
            parts = [[t] if special is None or not special.search(t) else special.split(t) for t in (t or "" for t in texts[at:end])]
            encoded = iter(self.plain([x for some in parts for x in some if x not in added]))
            for some in parts:
                yield b"".join([array("I", [added[x]]).tobytes() if x in added else next(encoded) for x in some])
            at = end

    def encode(self, text: str) -> bytes:
        return next(self.texts([text]))


_VOCABULARIES: dict[str, Vocabulary] = {}
_ENCODERS: dict[tuple[str, str | None], Encoder] = {}
remembers("pieces", _ENCODERS.clear)


def vocabulary(path: str) -> Vocabulary:
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(path)
    return _VOCABULARIES[path]


def encoder(path: str, lexicon: str | None) -> Encoder:
    """The encoder of this worker; ``lexicon`` is the name of an added file."""
    key = (path, lexicon)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(vocabulary(path), Lexicon.mapped(SparkFiles.get(lexicon)) if lexicon else None)
    return _ENCODERS[key]


def frequent_words(docs: DataFrame, tokenizer: str, text_col: str = "text", words: int = LEXICON_WORDS) -> list[bytes]:
    """The most frequent words of all texts, of at most ``WORD_BYTES`` bytes; at most ``words``."""

    def count(batches):
        import pyarrow as pa

        begin()
        split, seen = vocabulary(tokenizer).words, Counter()
        most = lambda n: sorted(seen.items(), key=itemgetter(1), reverse=True)[:n]
        for batch in slices(batches, 0, ROWS_AT_ONCE):
            for text in batch.column(0).to_pylist():
                seen.update((text or "").split(" "))
            if len(seen) > COUNTED:
                seen = Counter(dict(most(COUNTED // 2)))
        # all pieces are cut into words at once: a word begins at each of the spaces
        kept = [(p, n) for p, n in most(REPORTED) if p and not p[0].isspace()]
        words = split(" " + " ".join([p for p, _ in kept])) if kept else []
        piece = np.searchsorted(np.cumsum([len(p) + 1 for p, _ in kept]), np.cumsum([len(w) for w in words]) - 1, side="right")
        counts: dict[str, int] = defaultdict(int)
        for word, n in zip(words, np.array([n for _, n in kept], np.int64)[piece].tolist(), strict=True) if kept else ():
            counts[word] += n
        rows = [(w, n) for w, n in counts.items() if len(w.encode("utf-8")) <= WORD_BYTES]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], names=["word", "n"])

    counted = docs.select(text_col).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [r["word"].encode("utf-8") for r in counted.orderBy(F.desc("n"), "word").limit(words).collect()]


def publish_lexicon(spark: SparkSession, words: list[bytes], tokenizer: str) -> str | None:
    """Compile ``words`` and hand the file to all executors; its name, or None without words."""
    if not words:
        return None
    known = vocabulary(tokenizer)
    content = compile_lexicon({w: known.merge(w) for w in words})
    name = f"lexicon-{hashlib.sha256(content).hexdigest()[:24]}.bin"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = hadoop.Path(f"{shared_dir(spark)}/{name}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        out = fs.create(path, True)
        try:
            out.write(bytearray(content))
        finally:
            out.close()
    spark.sparkContext.addFile(str(path))
    return name


def _decoded(table: list[bytes], ids: np.ndarray) -> str:
    return b"".join(map(table.__getitem__, ids.tolist())).decode("utf-8", "replace")


def bpe_codec(docs: DataFrame, tokenizer: str, lexicon: str | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, ids (array of int) and decoded (the text of these ids) of every row, in one pass.

    A null or empty text has no ids and decodes to an empty text. Rows that
    repeat an id or a text give a row each; an empty table gives an empty one.
    Only the two named columns are read, so other columns and their names don't
    matter. A very long text is encoded whole; it needs some 40 bytes a
    character for a moment.
    """

    def code(batches):
        import pyarrow as pa

        begin("pieces")
        known, table = encoder(tokenizer, lexicon), vocabulary(tokenizer).bytes
        for batch in slices(batches, rows=ROWS_AT_ONCE):
            ids = [np.frombuffer(x, dtype="<i4") for x in known.texts(batch.column(1).to_pylist())]
            texts = pa.array([_decoded(table, x) for x in ids], pa.string())
            ends = np.cumsum([0] + [len(x) for x in ids]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids))), texts], names=["doc_id", "ids", "decoded"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(code, "doc_id long, ids array<int>, decoded string")


def bpe_encode(docs: DataFrame, tokenizer: str, lexicon: str | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id and ids (array of int) of every row; rows are treated as by ``bpe_codec``."""

    def encode(batches):
        import pyarrow as pa

        begin("pieces")
        known = encoder(tokenizer, lexicon)
        for batch in slices(batches, rows=ROWS_AT_ONCE):
            ids = list(known.texts(batch.column(1).to_pylist()))
            ends = np.cumsum([0] + [len(x) // 4 for x in ids]).astype(np.int32)
            flat = pa.array(np.frombuffer(b"".join(ids), dtype="<i4"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), flat)], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(encode, "doc_id long, ids array<int>")


def bpe_decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """``encoded`` (doc_id, ids) with the decoded text; null ids give an empty text, bytes that aren't UTF-8 become U+FFFD."""

    def decode(batches):
        import pyarrow as pa

        table = vocabulary(tokenizer).bytes
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                ids, ends = batch.column(1).values.to_numpy(), batch.column(1).offsets.to_numpy()
                texts = [_decoded(table, ids[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])

    ids = F.coalesce("ids", F.array().cast("array<int>")).alias("ids")
    return encoded.select("doc_id", ids).mapInArrow(decode, "doc_id long, ids array<int>, decoded string")


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, docs = public_tokenizers.path("byte_bpe_50k.json"), documents(spark, sf_dir)
    lexicon = publish_lexicon(spark, frequent_words(docs, path), path)
    return bpe_codec(docs, path, lexicon).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


QUERIES = {"op10_bpe_codec": op10_bpe_codec}
ORACLES: dict[str, str] = {}
