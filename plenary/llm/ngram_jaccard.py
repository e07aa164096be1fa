"""N-gram Jaccard join: a grouped prefix join over word shingles.

Documents with equal shingle sets are one class. Shingles are put in one global
order, rare ones first, and two sets can only reach the threshold if their
prefixes share a shingle. Classes with identical prefixes and size form a
group; shingles of prefixes give pairs of groups, which sizes and the places of
the shingle in either filter; pairs are expanded to members and verified on
whole sets.

Counting every shingle would shuffle the whole corpus as hashes. But any order
will do, as long as it is the same for all. So there are two passes. In the
first, shingles whose hash falls below ``ZONE`` of the hash space come first, by
how many classes hold them, the others after, by hash; the zone nearly always
covers a prefix, so only its shingles are counted, and where it falls short the
rest of the prefix is sent along. It leaves the documents whose prefixes meet
another's, a small part. Whole sets of these alone are ordered in the second
pass, with a wider zone, ``wide`` (all, unless shuffles must be smaller), which
makes groups and pairs.

For components, links between documents that are connected already are left
out. In ``STARS`` rounds, the groups of each shingle are paired with one
central document (of the group with the fewest shingles of its own); pairs that
sizes and places let through are expanded to the group's members: near copies
of one text, however many, cost a comparison each. Then all remaining pairs of
groups across components are filtered, also by sketches, which bound how alike
two sets can be, expanded and compared, so no link between components is lost. Every link lies inside a component, so links are
counted last, by comparing all members of each component, block by block.

Classes are numbered, so rows that repeat an id with different texts stay
apart until the end, where the rows of an id are one document.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, begin, documents, remembers, slices
from .components import components

WORDS, PERCENT = 4, 85
ZONE, WIDE = 0.2, 1.0
STARS = 2
#: 64-bit numbers in the sketch of a set, by which pairs are filtered.
LANES = 8
#: Shingles before one in its prefix, by which a pair of groups that met at one of them is known.
BEFORE = 6
#: Shingles of members of a component that are compared at once when links are counted.
BLOCK = 200_000
#: Words that a worker remembers at most, and the most bytes of one: some 60 MB.
MEMO_ENTRIES, MEMO_BYTES = 300_000, 48

_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)
#: Flips the order of unsigned numbers to that of signed ones.
_SIGN = np.uint64(1 << 63)


class _Words(dict):
    """64-bit hashes of words; forgets when full."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        found = xxhash.xxh3_64_intdigest(word)
        if len(word) <= MEMO_BYTES:
            if len(self) >= MEMO_ENTRIES:
                self.clear()
            self[word] = found
        return found


_WORDS = _Words()
remembers("words", _WORDS.clear)


def shingles(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text, as signed 64-bit numbers.

    Words are maximal runs without ASCII white space, with A-Z in lower case. A
    text of fewer words than a shingle has one shingle, all of it; one without
    words has none.
    """
    split = (text or b"").lower().split()
    if not split:
        return np.zeros(0, np.int64)
    ids = np.fromiter(map(_WORDS.__getitem__, split), dtype=np.uint64, count=len(split))
    width = min(words, len(ids))
    hashed = np.full(len(ids) - width + 1, width, dtype=np.uint64)
    for i in range(width):
        hashed = (hashed ^ ids[i : i + len(hashed)]) * np.uint64(_MIX[i % len(_MIX)])
        hashed ^= hashed >> np.uint64(29)
    hashed *= np.uint64(_MIX[0])
    hashed ^= hashed >> np.uint64(32)
    return np.sort(np.unique(hashed ^ _SIGN).view(np.int64)) if len(hashed) else hashed.view(np.int64)


def _prefix(n: int, percent: int) -> int:
    """How many shingles, the first in the order, two sets that link can't both have none of in common."""
    return n - -(-percent * n // 100) + 1


def _cut(zone: float) -> int:
    """Hashes below this are in the zone."""
    return int(zone * 2**64) - (1 << 63)


def signatures(docs: DataFrame, words: int, percent: int, text_col: str, id_col: str) -> DataFrame:
    """doc_id, n, signature of the set, zone (how many shingles in the zone) and tokens: these, or the prefix if it is longer."""
    cut = _cut(ZONE)

    def run(batches):
        import pyarrow as pa
        import xxhash

        begin("words")
        for batch in slices(batches):
            n, signature, zone, tokens = [], [], [], []
            for text in batch.column(1).to_pylist():
                found = shingles(text, words)
                below = int(np.searchsorted(found, cut))
                n.append(len(found))
                zone.append(below)
                signature.append(xxhash.xxh3_128_digest(found.tobytes()))
                tokens.append(found[: max(below, _prefix(len(found), percent)) if len(found) else 0])
            ends = np.cumsum([0] + [len(t) for t in tokens]).astype(np.int32)
            flat = np.concatenate(tokens) if tokens else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int32()), pa.array(signature, pa.binary()), pa.array(zone, pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                names=["doc_id", "n", "signature", "zone", "tokens"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary")).mapInArrow(run, "doc_id long, n int, signature binary, zone int, tokens array<long>")


def sketch(found: np.ndarray) -> np.ndarray:
    """A bit for each of 64 * ``LANES`` buckets of hashes: whether it holds an odd number of the set's shingles.

    Sketches of two sets differ in no more bits than the sets in shingles.
    """
    odd = (np.bincount(found & (64 * LANES - 1), minlength=64 * LANES) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view("<i8")


def _sets(docs: DataFrame, wanted: DataFrame, words: int, text_col: str, id_col: str) -> DataFrame:
    """id, sketch and whole set of the classes ``wanted`` (id, doc_id, signature), from the texts of those doc_ids."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        begin("words")
        for batch in slices(batches, 0):
            found = [shingles(t, words) for t in batch.column(0).to_pylist()]
            ends = np.cumsum([0] + [len(x) for x in found]).astype(np.int32)
            signature = pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in found], pa.binary())
            bits = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * LANES), pa.array(np.concatenate([sketch(x) for x in found])))
            yield pa.RecordBatch.from_arrays([signature, bits, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))], names=["signature", "bits", "tokens"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    return texts.select("text").mapInArrow(run, "signature binary, bits array<long>, tokens array<long>").join(wanted.select("signature", "id"), "signature").dropDuplicates(["signature"]).select("id", "bits", "tokens")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) that link."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            (xs, x_at), (ys, y_at) = ((c.values.to_numpy(), c.offsets.to_numpy()) for c in (batch.column(2), batch.column(3)))
            kept = []
            for i in range(batch.num_rows):
                x, y = xs[x_at[i] : x_at[i + 1]], ys[y_at[i] : y_at[i + 1]]
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    kept.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(kept, pa.int64())) for c in (0, 1)], names=["a", "b"])

    left, right = (sets.select(F.col("id").alias(c), F.col("tokens").alias(f"tokens_{c}")) for c in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "tokens_a", "tokens_b").mapInArrow(run, "a long, b long")


def _counted(label: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """id and n_links: with how many others of its component each id of ``label`` (id, component) links.

    Members are dealt to blocks by hash, and each pair of blocks is a group of
    its own, so a large component isn't one task's work.
    """

    def run(table):
        import pyarrow as pa

        lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        ids, block = table.column("id").to_numpy(), table.column("block").to_numpy()
        tokens = [t.values.to_numpy() for t in table.column("tokens")]
        sizes = np.array([len(t) for t in tokens])
        vocabulary, codes = np.unique(np.concatenate(tokens), return_inverse=True)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        n_links = np.zeros(len(ids), np.int64)
        held = np.zeros(len(vocabulary), np.int64)
        for i in range(len(ids)):
            mine = codes[starts[i] : starts[i] + sizes[i]]
            held[mine] = 1
            both = np.add.reduceat(held[codes], starts)
            held[mine] = 0
            fits = 100 * both >= percent * (sizes + sizes[i] - both)
            fits &= (ids != ids[i]) if lo == hi else (block != block[i])
            n_links[i] = fits.sum()
        return pa.table({"id": pa.array(ids, pa.int64()), "n_links": pa.array(n_links, pa.int64())})

    label = label.join(sets.select("id", F.size("tokens").alias("n")), "id")
    sizes = label.groupBy("component").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"))
    dealt = label.drop("n").join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    cells = dealt.join(sets, "id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select("component", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "id", "block", "tokens")
    return cells.groupBy("component", "lo", "hi").applyInArrow(run, "id long, n_links long").groupBy("id").agg(F.sum("n_links").alias("n_links"))


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """id, n, own and prefix of ``sets`` (id, n, zone, tokens): those shingles of each prefix that other sets have too.

    The first ``zone`` of the tokens are ordered by how many sets hold them, then
    by hash, the others after them by hash. ``own`` is how many of the former
    the set has alone: they come first and match nothing. prefix is an array of
    (pos, token), pos being the place in the order, from 1.
    """
    # inside the zone places come from counts; -1 stands there for all of them
    tokens = sets.select("id", "zone", F.posexplode("tokens").alias("at", "token")).select("id", F.when(F.col("at") < F.col("zone"), -1).otherwise(F.col("at") + 1).alias("pos"), "token")
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    held = tokens.join(shared, "token").groupBy("id").agg(
        F.array_sort(F.collect_list(F.when(F.col("pos") < 0, F.struct("df", "token")))).alias("inside"),
        F.array_sort(F.collect_list(F.when(F.col("pos") > 0, F.struct("pos", "token")))).alias("outside"),
    )
    held = held.join(sets.select("id", "n", "zone"), "id")
    size = F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100).cast("int") + 1
    inside = F.transform("inside", lambda s, i: F.struct((F.col("own") + i + 1).alias("pos"), s["token"].alias("token")))
    taken = F.slice(inside, F.lit(1), F.greatest(F.lit(0), size - F.col("own")))
    return held.withColumn("own", F.col("zone") - F.size("inside")).select("id", "n", "own", F.concat(taken, "outside").alias("prefix")).where(F.size("prefix") > 0)


def _busy(postings: DataFrame) -> DataFrame:
    """``postings`` of tokens that more than one row has."""
    return postings.join(postings.groupBy("token").agg(F.count(F.lit(1)).alias("lists")).where("lists > 1").select("token"), "token")


def _fits(percent: int):
    """Whether two sets may link, by their sizes and the places of a shingle they share.

    Two sets that link share ``percent / (100 + percent)`` of the sum of their
    sizes. Before the first shingle that they share, in the common order, they
    share none, so no more than what follows it in either can be shared. Each
    pair that links passes at its first shared shingle.
    """
    sizes = F.lit(100) * F.least("n", "other_n") >= F.lit(percent) * F.greatest("n", "other_n")
    most = F.lit(1) + F.least(F.col("n") - F.col("pos"), F.col("other_n") - F.col("other_pos"))
    return sizes & (F.lit(100 + percent) * most >= F.lit(percent) * (F.col("n") + F.col("other_n")))


def _near(differ: Column, n: Column, other_n: Column, percent: int) -> Column:
    """Whether sets of these sizes, whose sketches differ in ``differ`` bits or more, may link."""
    return F.lit(100 + percent) * (n + other_n - differ) >= F.lit(2 * percent) * (n + other_n)


def _posted(groups: DataFrame) -> DataFrame:
    """A row for each shingle of a group's prefix, of those that more than one group has."""
    kept = [c for c in groups.columns if c != "prefix"]
    return _busy(groups.select(F.explode("prefix").alias("s"), *kept).select("s.token", "s.pos", *kept))


def _starred(postings: DataFrame, placed: DataFrame, star: int, percent: int) -> DataFrame:
    """Pairs (a, b) of documents: members of the groups of each shingle, and its centre.

    From the second round on, groups are split by the components of ``placed``.
    What isn't in the component of its list's centre meets another member of
    that, drawn by hash, and a centre of its own.
    """
    parts = placed.groupBy("gid", "component").agg(F.min(F.struct("own", "id")).alias("least"))
    at = postings.drop("own").join(parts.select("gid", "component", "least.own", F.col("least.id").alias("rep")), "gid")
    centre = F.min(F.struct("own", "rep", "n", "pos", "component")).alias("c")
    centres = at.groupBy("token").agg(centre)
    if star:
        sided = at.join(centres.select("token", F.col("c.component").alias("centred")), "token")
        at = sided.where("component <> centred").drop("centred")
        drawn = sided.where("component = centred").groupBy("token").agg(F.min(F.struct(F.xxhash64("rep", "token", F.lit(star)).alias("h"), "rep", "n", "pos")).alias("c"))
        centres = at.groupBy("token").agg(centre).select("token", "c.rep", "c.n", "c.pos").union(drawn.select("token", "c.rep", "c.n", "c.pos"))
    else:
        centres = centres.select("token", "c.rep", "c.n", "c.pos")
    centres = centres.select("token", F.col("rep").alias("centre"), F.col("n").alias("other_n"), F.col("pos").alias("other_pos"))
    pairs = at.join(centres, "token").where(_fits(percent)).select("gid", "component", "centre").distinct()
    met = pairs.join(placed.select("gid", "component", "id"), ["gid", "component"]).where("id <> centre")
    return met.select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct()


def _across(at: DataFrame, percent: int) -> DataFrame:
    """Pairs (gid, other) of groups that may link across components; ``at`` has postings with each group's sizes, components and bits.

    A pair is left out where it met shortly before, ``BEFORE`` shingles at most,
    in both prefixes: at the first shingle that it shares it never is, and
    sizes and places let it through there if they do later.
    """
    lanes = range(LANES)
    at = at.withColumn("before", F.collect_list("token").over(Window.partitionBy("gid").orderBy("pos").rowsBetween(-BEFORE, -1)))
    mixed = at.groupBy("token").agg(F.min("low").alias("l"), F.max("high").alias("h")).where("l <> h").select("token")
    at = at.join(mixed, "token").withColumn("band", F.floor(F.log(F.col("n")) / np.log(100 / percent) + 1e-9) if percent < 100 else F.col("n"))
    other = at.select("token", F.col("band").alias("met"), F.col("pos").alias("other_pos"), F.col("before").alias("other_before"), F.col("gid").alias("other"), F.col("n").alias("other_n"), F.col("low").alias("other_low"), F.col("high").alias("other_high"), *(F.col(f"{name}_{i}").alias(f"other_{name}_{i}") for i in lanes for name in ("all", "any")))
    apart = (F.col("low") != F.col("other_low")) | (F.col("high") != F.col("other_high")) | (F.col("low") != F.col("high"))
    # a pair meets where its lower band reaches up: one band, as sizes a factor of percent apart can straddle one border
    reaching = at.withColumn("met", F.explode(F.array(F.col("band"), F.col("band") + 1)))
    once = (F.col("met") > F.col("band")) | (F.col("gid") < F.col("other"))
    only = [F.col(f"all_{i}").bitwiseAND(F.bitwise_not(f"other_any_{i}")).bitwiseOR(F.col(f"other_all_{i}").bitwiseAND(F.bitwise_not(f"any_{i}"))) for i in lanes]
    near = _near(sum(map(F.bit_count, only)), F.col("n"), F.col("other_n"), percent)
    return reaching.join(other, ["token", "met"]).where(once & _fits(percent) & apart & near & ~F.arrays_overlap("before", "other_before")).select("gid", "other")


def _remaining(postings: DataFrame, placed: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members, in different components, of all pairs of groups that sizes and places let through.

    Lists are split by bands of size, which only pairs of the same band or of
    neighbouring ones can link across. Of large families of texts that are
    alike, but not enough to link, sketches let few pairs through: first of
    groups, by the bits that all members of one have and none of the other,
    then of members.
    """
    lanes = range(LANES)
    bits = [f(F.col("bits")[i]).alias(f"{name}_{i}") for i in lanes for f, name in ((F.bit_and, "all"), (F.bit_or, "any"))]
    spans = placed.groupBy("gid").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max("n").alias("n"), F.max("own").alias("own"), *bits)
    pairs = _across(postings.drop("n", "own").join(spans, "gid"), percent).distinct()
    alike = F.lit(100 + percent) * (F.col("n") - F.col("own")) >= F.lit(2 * percent) * F.col("n")  # as _fits has it, for members of one group
    pairs = pairs.union(spans.where((F.col("low") != F.col("high")) & alike).select("gid", F.col("gid").alias("other")))
    one, two = (placed.select(F.col("gid").alias(g), F.col("id").alias(i), F.col("component").alias(f"component_{i}"), F.col("n").alias(f"n_{i}"), F.col("bits").alias(f"bits_{i}")) for g, i in (("gid", "x"), ("other", "y")))
    near = _near(sum(F.bit_count(F.col("bits_x")[i].bitwiseXOR(F.col("bits_y")[i])) for i in lanes), F.col("n_x"), F.col("n_y"), percent)
    met = pairs.join(one, "gid").join(two, "other").where((F.col("component_x") != F.col("component_y")) & ((F.col("gid") != F.col("other")) | (F.col("x") < F.col("y"))) & near)
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, text_col: str = "text", id_col: str = "doc_id", count_links: bool = True, wide: float = WIDE) -> DataFrame:
    """doc_id, n_shingles, component_id, and n_links, of every row of ``docs``.

    n_links is the number of other sets of shingles that a row's set links
    with; without ``count_links`` the column isn't there.

    Two rows link when 100 * intersection >= percent * union of their shingle
    sets; rows of one id are one document. component_id is the smallest doc_id
    reachable, itself included. Null and empty texts have no shingles and link
    with nothing. Rows with a null id are returned with a null component. Texts
    are read whole, however long. An empty table gives an empty one; only the
    two named columns are read.
    """
    with Scratch(docs.sparkSession) as tables:
        base = tables.write(signatures(docs, words, percent, text_col, id_col), "base")
        usable = base.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
        # a class has equal sets; its number is pinned by writing it
        classes = usable.groupBy("signature").agg(F.min("doc_id").alias("doc_id")).select("signature", "doc_id", F.monotonically_increasing_id().alias("id"))
        classes = tables.write(classes, "classes")
        first = usable.join(classes, ["signature", "doc_id"]).dropDuplicates(["signature", "doc_id"])
        # those whose prefixes meet another's in the order of the zone; only their whole sets are needed
        near = tables.write(_prefixes(first.select("id", "n", "zone", "tokens"), percent), "near")
        rows = tables.write(base.select("doc_id", "n", "signature"), "rows")
        tables.drop("base")
        active = _busy(near.select("id", F.explode("prefix").alias("s")).select("id", "s.token")).select("id").distinct()
        wanted = tables.write(classes.join(active, "id"), "wanted")
        tables.drop("near")
        sets = tables.write(_sets(docs, wanted, words, text_col, id_col), "sets")
        # among them, an order by how many of these sets hold a shingle
        sized = sets.select("id", F.size("tokens").alias("n"), (F.size("tokens") if wide >= 1 else F.size(F.filter("tokens", lambda t: t < _cut(wide)))).alias("zone"), "tokens")
        needed = F.greatest(F.col("zone"), F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100).cast("int") + 1)
        prefixes = tables.write(_prefixes(sized.withColumn("tokens", F.slice("tokens", F.lit(1), needed)), percent), "prefixes")
        tables.drop("wanted")
        groups = tables.write(prefixes.groupBy("n", "prefix").agg(F.min(F.struct("own", "id")).alias("least")).select("n", "prefix", "least.own", F.col("least.id").alias("gid")), "groups")
        members = tables.write(prefixes.select("id", "n", "own", "prefix").join(groups.select("n", "prefix", "gid"), ["n", "prefix"]).join(sets.select("id", "bits"), "id").select("id", "gid", "n", "own", "bits"), "members")
        tables.drop("prefixes")
        postings = tables.write(_posted(groups), "postings")
        tables.drop("groups")

        # round by round: pairs with the centre of each list
        placed, links, compared = members.withColumn("component", F.lit(0).cast("long")), None, None
        for star in range(STARS):
            pairs = _starred(postings, placed, star, percent)
            pairs = tables.write(pairs if compared is None else pairs.join(compared, ["a", "b"], "left_anti"), "pairs")
            compared = pairs if compared is None else compared.union(pairs)
            found = tables.write(_verified(pairs, sets, percent), "links")
            links = found if links is None else links.union(found)
            tables.drop("placed")
            placed = tables.write(members.join(components(links, tables, "round"), "id", "left").withColumn("component", F.coalesce("component", "id")), "placed")
            tables.drop("round")

        # the rest: pairs of groups across components, expanded to their members
        rest = tables.write(_remaining(postings, placed, percent).join(compared, ["a", "b"], "left_anti"), "rest")
        tables.drop("pairs", "placed", "members", "postings")
        links = links.union(tables.write(_verified(rest, sets, percent), "links"))
        tables.drop("rest")
        label = components(links, tables, "last")
        counts = tables.write(_counted(label, sets, percent), "counts") if count_links else None
        tables.drop("sets")
        same = _same_document(rows, classes, tables)
        if same is not None:
            label = components(links.union(same), tables, "same")
        placed = tables.write(classes.join(label, "id", "left").withColumn("component", F.coalesce("component", "id")), "classed")
        tables.drop("links", "last", "same", "twice", "classes")
        found = placed.join(placed.groupBy("component").agg(F.min("doc_id").alias("component_id")), "component")
        if count_links:
            found = found.join(counts, "id", "left")
        found = tables.write(found.select("signature", "component_id", *([F.coalesce("n_links", F.lit(0)).alias("n_links")] if count_links else [])), "found")
        tables.drop("classed", "counts")
        size = F.col("n").cast("long").alias("n_shingles")
        some = F.col("doc_id").isNotNull() & (F.col("n") > 0)
        linked = rows.where(some).join(found, "signature").select("doc_id", size, *found.columns[1:])
        alone = rows.where(~some).select("doc_id", size, F.col("doc_id").alias("component_id"), *([F.lit(0).cast("long").alias("n_links")] if count_links else []))
        if same is None:
            return linked.unionByName(alone)
        # a text without shingles is in the component of its document's others
        least = tables.write(linked.groupBy("doc_id").agg(F.min("component_id").alias("least")), "least")
        return linked.unionByName(alone.join(least, "doc_id", "left").withColumn("component_id", F.coalesce("least", "component_id")).drop("least"))


def _same_document(rows: DataFrame, classes: DataFrame, tables: Scratch) -> DataFrame | None:
    """Edges (a, b) between the classes of each id that has several; None if no id has."""
    some = rows.where(F.col("doc_id").isNotNull())
    twice = tables.write(some.groupBy("doc_id").agg(F.min("signature").alias("lo"), F.max("signature").alias("hi")).where("lo <> hi").select("doc_id"), "twice")
    if not twice.head(1):
        return None
    held = some.where("n > 0").join(twice, "doc_id", "left_semi").select("doc_id", "signature").distinct().join(classes.select("signature", "id"), "signature")
    least = held.groupBy("doc_id").agg(F.min("id").alias("a"))
    return held.join(least, "doc_id").where("a <> id").select("a", F.col("id").alias("b"))


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))


QUERIES = {"op1_ngram_jaccard_join": op1_ngram_jaccard_join}
ORACLES: dict[str, str] = {}
