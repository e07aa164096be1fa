"""The ten operators against brute force, on awkward rows and small tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plenary.llm import bpe, components, exact_dedup, fingerprints, language_id, ngram_jaccard, packing, pii, quality, suffix_dedup, toxicity
from plenary.llm.common import materialize

from . import frames

P = pytest.importorskip("public_tokenizers")
WS = " \t\n\x0b\x0c\r"


def strip(t):
    return (t or "").translate({ord(c): None for c in WS})


@pytest.fixture(scope="module")
def docs(spark):
    return materialize(frames.documents(spark), "docs")


def words(t):
    return (t or "").encode().lower().split()


def shingle_set(t):
    w = words(t)
    return frozenset(tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))) if w else frozenset()


def linked(texts):
    """Smallest id of each id's component, by comparing all pairs."""
    sets, parent = {i: shingle_set(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in texts:
        for b in texts:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in texts}


def test_jaccard_awkward(spark, docs):
    got = {(r.doc_id, r.component_id, r.n_shingles) for r in ngram_jaccard.jaccard_components(docs).collect()}
    texts = {r[0]: r[1] for r in frames.rows() if r[0] is not None}
    want = linked(texts)
    assert {(i, c) for i, c, _ in got if i is not None} == set(want.items())
    assert {(i, n) for i, _, n in got if i is not None} == {(i, len(shingle_set(t))) for i, t in texts.items()}
    assert ngram_jaccard.jaccard_components(frames.empty(spark)).count() == 0


def test_jaccard_near_copies(spark):
    """A family of near copies, edited at random, and documents that share a passage."""
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(500)]
    base, passage = [rng.choice(vocabulary) for _ in range(120)], [rng.choice(vocabulary) for _ in range(40)]
    texts = {}
    for i in range(80):
        w = list(base)
        for _ in range(rng.randrange(6)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        texts[i] = " ".join(w)
    for i in range(80, 140):
        texts[i] = " ".join([*passage, *(rng.choice(vocabulary) for _ in range(rng.randrange(40)))])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_jaccard.jaccard_components(df).collect()}
    assert got == linked(texts)


def test_components_of_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(31)) and all(got[i] == 100 for i in range(100, 160))


@pytest.mark.parametrize("block", [3, 4096])
def test_exact_dedup(spark, docs, block):
    got = collections.Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_dedup(docs, block_chars=block).collect())
    groups = collections.defaultdict(list)
    for r in frames.rows():
        groups[strip(r[1])].append(r)
    want = collections.Counter()
    for norm, members in groups.items():
        keep = min(members, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))[0]
        for r in members:
            want[(r[0], keep, len(members), r[0] == keep, hashlib.sha256(norm.encode()).hexdigest())] += 1
    assert got == want
    assert exact_dedup.exact_dedup(frames.empty(spark)).count() == 0


def test_exact_dedup_collisions_change_the_seed(spark):
    """A digest that collides under seed 0 is found out."""
    df = spark.createDataFrame([(1, "aa"), (2, "bb"), (3, "aa")], "doc_id long, text string")
    weak = lambda b, seed: F.lit(1).cast("long") if seed == 0 else F.xxhash64(F.lit(seed), b)
    got = {r.doc_id: (r.n_blocks, r.name) for r in exact_dedup.identities(df, digest=weak).collect()}
    assert got[1] == got[3] != got[2]
    with pytest.raises(ValueError):
        exact_dedup.identities(df, digest=lambda b, s: F.lit(1).cast("long"), max_seeds=1)


def test_fingerprints(spark):
    texts = {"abc": "a b\nc d\ne", "cab": "e\na b\nc d", "aa": "a\na", "a": "a", "ab": "a\nb", "c": "c", "abC": "a\nb\nc", "b": "b", "ac": "a\nc", "": ""}
    df = materialize(fingerprints.fingerprint(spark.createDataFrame(list(texts.items()), "doc_id string, text string")), "fp")
    fp = {r.doc_id: r.fingerprint for r in df.collect()}
    assert fp["abc"] == fp["cab"] and fp["aa"] != fp["a"] and len(set(map(tuple, fp.values()))) == len(fp) - 1
    pairs = df.select(F.col("doc_id").alias("x"), F.col("fingerprint").alias("f")).crossJoin(df.select(F.col("doc_id").alias("y"), F.col("fingerprint").alias("g")))
    got = {(r.x, r.y): r for r in pairs.select("x", "y", fingerprints.plus(F.col("f"), F.col("g")).alias("p"), fingerprints.minus(F.col("f"), F.col("g")).alias("m"), fingerprints.likeness(F.col("f"), F.col("g")).alias("near")).collect()}
    assert got["ab", "c"].p == fp["abC"] and got["abC", "b"].m == fp["ac"] and got["a", "a"].m == fp[""]
    assert (got["", ""].near, got["", "a"].near, got["abc", "cab"].near) == (1.0, 0.0, 1.0)
    assert 0.2 < got["ab", "a"].near < 1 and all(0 <= r.near <= 1 for r in got.values())


def test_next_document(spark):
    rows = [(5, "five"), (2, "two"), (9, "nine"), (2, "twin"), (None, "null")]
    for ranges in (2, 64):
        got = {(r.doc_id, r.text): r.next_text for r in fingerprints.with_next(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", ["text"], ranges).collect()}
        assert got == {(9, "nine"): "five", (5, "five"): "twin", (2, "twin"): "two", (2, "two"): "null", (None, "null"): "nine"}
    assert fingerprints.with_next(spark.createDataFrame([(1, "a")], "doc_id long, text string"), "doc_id", ["text"]).first().next_text == "a"
    assert fingerprints.with_next(frames.empty(spark), "doc_id", ["text"]).count() == 0


def test_pii_base_spans(spark, docs):
    extra = ["a@b", "a@b.c_d@e.f x@y@z.com @a.b", "😀 a@b.co 1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.00255", "4111 1111 1111 1111 4111-1111-1111-1111", "1 2 " * 3000, "+1 (058) 555-3468, +12 +1234567890. 1+1 (222) 333 4444.", "a" * 20000, "7" * 5000, "a@b" + ".c" * 9000]
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(extra)], "doc_id long, text string"))
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def luhn(d):
        return sum((int(c) * 2 - 9 * (int(c) > 4) if i % 2 else int(c)) for i, c in enumerate(reversed(d))) % 10 == 0

    found = pii.find(more, {}).select("doc_id", *(F.transform(f"base_{k}", lambda s: F.concat_ws(":", s["start"], s["end"])).alias(k) for k in pii.KINDS)).collect()
    texts = collections.defaultdict(list)
    for r in more.collect():
        texts[r.doc_id].append(r.text or "")
    for r in found:
        for kind, pattern in patterns.items():
            want = []
            for m in re.finditer(pattern, texts[r.doc_id][0]):
                d = re.sub("[^0-9]", "", m[0])
                if {"email": True, "ip": kind != "ip" or all(int(x) < 256 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]:
                    want.append(f"{m.start()}:{m.end()}")
            assert r[kind] == want, (kind, texts[r.doc_id][0][:80])


def test_pii_boosting_learns_and_compiles(spark):
    rng = random.Random(1)
    rows = [(float(rng.randrange(10)), float(rng.randrange(2))) for _ in range(400)]
    y = [int(a > 4 and b == 1) for a, b in rows]
    constant, trees = pii.boost(rows, y)
    margin = [constant + sum(pii.leaf(t, r) for t in trees) for r in rows]
    assert [int(m > 0) for m in margin] == y
    df = spark.createDataFrame(rows[:50], "a double, b double")
    got = df.select(sum((pii.compiled(t, [F.col("a"), F.col("b")]) for t in trees), F.lit(constant)).alias("m")).collect()
    assert np.allclose([r.m for r in got], margin[:50])


def test_redaction(spark, docs):
    got = {r.doc_id: r for r in pii.redact(docs, {}).where("doc_id = 10").collect()}
    assert got[10].text == "😀 mail [EMAIL] or [PHONE], card [CARD], ip [IP] 😀" and got[10].n_chars == len(got[10].text)
    assert pii.redact(docs, {}).columns == docs.columns and pii.redact(docs, {}).count() == docs.count()


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    got = packing.best_fit_pack(docs).collect()
    want = collections.Counter()
    for r in frames.rows():
        ids = tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [0]
        for p in range(0, len(ids), 2048):
            part = np.array(ids[p : p + 2048], "<u4").tobytes()
            want[(r[0], p // 2048, p, len(part) // 4, zlib.crc32(part))] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        held.sort()
        assert held[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(held, held[1:])) and sum(n for _, n in held) <= 2048
    assert packing.best_fit_pack(frames.empty(spark)).count() == 0


def test_packing_plan_holds_everything():
    rng = random.Random(5)
    for _ in range(20):
        histogram = {rng.randrange(1, 101): rng.randrange(1, 2000) for _ in range(rng.randrange(1, 60))}
        patterns = packing.plan(histogram, 100)
        placed = collections.Counter()
        for bins, held in patterns:
            assert bins > 0 and sum(held) <= 100
            for n in held:
                placed[n] += bins
        assert placed == collections.Counter(histogram)
        least = max(-(-sum(n * c for n, c in histogram.items()) // 100), sum(c for n, c in histogram.items() if n > 50))
        assert sum(b for b, _ in patterns) <= 1.25 * least + 1


def test_bpe_equals_the_library(spark, docs):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    lexicon = bpe.publish_lexicon(spark, bpe.frequent_words(docs, path, words=20), path)
    got = bpe.bpe_codec(docs, path, lexicon).collect()
    apart = bpe.bpe_decode(bpe.bpe_encode(docs, path, lexicon), path).collect()
    assert collections.Counter((r.doc_id, tuple(r.ids), r.decoded) for r in apart) == collections.Counter((r.doc_id, tuple(r.ids), r.decoded) for r in got)
    assert bpe.bpe_codec(frames.empty(spark), path).count() == 0
    want = collections.Counter()
    for r in frames.rows():
        ids = tokenizer.encode(r[1] or "", add_special_tokens=False).ids
        want[(r[0], tuple(ids), tokenizer.decode(ids, skip_special_tokens=False))] += 1
    assert collections.Counter((r.doc_id, tuple(r.ids), r.decoded) for r in got) == want


def test_lexicon_is_minimal_and_exact():
    entries = {w.encode(): [i, i + 1] for i, w in enumerate(["walking", "talking", "walked", "talked", "w", "é", "talk"])}
    blob = bpe.compile_lexicon(entries)
    path = "/tmp/plenary-test-lexicon.bin"
    with open(path, "wb") as f:
        f.write(blob)
    lexicon = bpe.Lexicon.mapped(path)
    assert all(np.frombuffer(lexicon.ids(w), "<u4").tolist() == i for w, i in entries.items())
    assert lexicon.ids(b"walk") is None and lexicon.ids(b"") is None and lexicon.ids(b"zz") is None
    with_shared, alone = len(bpe.compile_lexicon({b"ab" + s: [1] for s in (b"xyz", b"wxyz")})), len(bpe.compile_lexicon({b"ab" + s: [1] for s in (b"xyz", b"wabc")}))
    assert with_shared < alone


def test_heap_and_matrix_merge_alike():
    v = bpe.Vocabulary(P.path("byte_bpe_50k.json"))
    rng = random.Random(2)
    words = ["".join(rng.choice("etaoin shrdlu") for _ in range(rng.randrange(1, 60))).encode() for _ in range(400)]
    assert [np.frombuffer(x, "<u4").tolist() for x in v.merge_many(words)] == [v.merge(w) for w in words]
    assert v.merge_many([b"", b"a"])[0] == b""


def test_bpe_on_mixed_strings():
    """Spaces, marks, letters that change in lower case, special tokens: the library's ids, with any lexicon and a small memo."""
    from tokenizers import Tokenizer

    path, rng = P.path("byte_bpe_50k.json"), random.Random(8)
    tokenizer, v = Tokenizer.from_file(path), bpe.vocabulary(path)
    parts = ["a", "b", " ", "  ", "\n", "\t", " \n", "é", "İ", "1", "'s", "<|endoftext|>", ".", "!?", "😀", "\x85", "\xa0", "\x1c", "the", " ing", "x" * 60, "\u3000"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(1500)]
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    for lexicon in (None, bpe.Lexicon(bpe.compile_lexicon({w: v.merge(w) for w in (b" the", b"the", b" a", b"ing")}))):
        known = bpe.Encoder(v, lexicon)
        assert [np.frombuffer(x, "<u4").tolist() for at in range(0, 1500, 100) for x in known.texts(texts[at : at + 100])] == want
        assert not lexicon or known.answered


def test_language_id(spark, docs):
    train = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog were in the house", "en"), ("le chat et le chien sont dans la maison", "fr")] * 10)], "doc_id long, text string, lang string")
    model = language_id.fit(train)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(docs, model).collect() if r.doc_id is not None}
    assert got[0][0] == "en" and got[3] == got[4] == got[5] == ("und", 0.0) and all(0 <= s <= 1 for _, s in got.values())
    assert {r.lang_pred for r in language_id.identify(docs, language_id.fit(frames.empty(spark))).collect()} == {"und"}
    assert language_id.identify(frames.empty(spark), model).count() == 0


def test_toxicity_grammar():
    s = toxicity.Scorer(toxicity.Grammar({"idiot": 4.0}, {"vequ": 4.0}, (-3.0, 0.5, 1.0)))
    plain, negated, reported, targeted = (s.features(t)[0] for t in ("What an idiot.", "That is not an idiot.", "Bob said idiot.", "You idiot."))
    assert negated < plain < targeted and reported < plain and s.features("vequnor la")[0] == 4.0
    assert s.features("They will kill you.")[0] > 0 and s.features("kill time")[0] == 0
    assert s.score(None) == s.score("") and 0 <= s.score("") < s.score("You idiot") <= 1
    assert s.features("not. idiot")[0] == plain  # a clause ends the negation's scope


def test_toxicity_learns(spark, docs):
    labels = [(i, int(i % 4 == 0)) for i in range(400)] + [(None, 1), (5, None)]
    rng = random.Random(4)
    fill = lambda: " ".join(rng.choice(["the", "of", "and", "house", "tree", "sky", "run"]) for _ in range(20))
    texts = spark.createDataFrame([(i, fill() + (" grobnak " if i % 4 == 0 else " ") + fill()) for i in range(400)], "doc_id long, text string")
    grammar = toxicity.fit(texts, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert "grobnak" in grammar.words
    got = {r.doc_id: r.score for r in toxicity.toxicity(texts, grammar).collect()}
    assert min(got[i] for i in got if i % 4 == 0) > 0.5 > max(got[i] for i in got if i % 4)
    assert toxicity.without_toxic(texts, grammar).count() == 300
    assert toxicity.toxicity(docs, toxicity.fit(frames.empty(spark), spark.createDataFrame([], "doc_id long, toxic int"))).count() == docs.count()


def test_quality(spark, docs):
    rng = random.Random(6)
    good = lambda: " ".join(rng.choice(["river", "stone", "bridge", "and", "the"]) for _ in range(40)) + "."
    bad = lambda: "BUY!! NOW!! " * 15 + rng.choice(["x", "y"])
    texts = spark.createDataFrame([(i, good() if i % 3 else bad()) for i in range(240)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, (i % 3 > 0) + (i % 3 > 1)) for i in range(240)], "doc_id long, quality int")
    model = quality.fit(texts, labels)
    assert model.grades == [0.0, 1.0, 2.0] and np.all(np.diff(model.thresholds) > 0)
    got = {r.doc_id: r.expected_grade for r in quality.grade(texts, model).collect()}
    assert max(got[i] for i in got if i % 3 == 0) < min(got[i] for i in got if i % 3)
    assert quality.grade(docs, model).count() == docs.count()
    assert {r.tail_probability for r in quality.grade(docs, quality.fit(frames.empty(spark), labels)).collect()} == {1.0}


def repeats(texts, k=50):
    """Per text, which words lie in a window of k words that occurs elsewhere."""
    seen = collections.Counter(tuple(w[i : i + k]) for w in texts.values() for i in range(len(w) - k + 1))
    out = {i: [0] * len(w) for i, w in texts.items()}
    for i, w in texts.items():
        for at in range(len(w) - k + 1):
            if seen[tuple(w[at : at + k])] > 1:
                out[i][at : at + k] = [1] * k
    return out


def marked(spark, texts):
    got = {i: [0] * len(w) for i, w in texts.items()}
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")
    for r in suffix_dedup.repeated_passages(df).collect():
        got[r.doc_id][r.start_word : r.end_word] = [1] * (r.end_word - r.start_word)
    return got


def test_repeated_passages(spark, docs):
    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(3000)}"
    passages = [[word() for _ in range(n)] for n in (49, 50, 60, 200)]
    texts = {}
    for i in range(40):
        body = [word() for _ in range(rng.randrange(0, 120))]
        for p in rng.sample(passages, rng.randrange(4)):
            at = rng.randrange(len(body) + 1)
            body[at:at] = p
        texts[i] = body
    assert marked(spark, texts) == repeats(texts)
    assert suffix_dedup.repeated_passages(frames.empty(spark)).count() == 0
    assert suffix_dedup.repeated_passages(docs).count() >= 1  # a text of one word, over and over


def test_repeated_passages_of_overlapping_parts(spark):
    """Parts of under 50 words that repeat next to each other, cut-outs of one text, and few words over and over."""
    rng = random.Random(13)
    word = lambda: f"w{rng.randrange(4000)}"
    one, two = [word() for _ in range(40)], [word() for _ in range(40)]
    texts = {i: [word() for _ in range(9)] + (one + two if i % 4 == 0 and i < 4 else one if i % 2 else two) + [word() for _ in range(9)] for i in range(30)}
    source = [word() for _ in range(300)]
    for i in range(30, 70):
        a = rng.randrange(250)
        texts[i] = [word() for _ in range(rng.randrange(5))] + source[a : a + rng.randrange(30, 120)] + [word() for _ in range(rng.randrange(5))]
    for i in range(70, 80):
        texts[i] = [rng.choice(["x", "y"]) if i % 2 else "x" for _ in range(rng.randrange(45, 90))]
    texts[80] = [*source[:45], "other", *source[46:130], "more", *source[131:200]]
    assert marked(spark, texts) == repeats(texts)


def test_repeated_passages_quoted_from_long_copies(spark):
    """Each quote is too short for a stretch, and comes from the inside of a text that has one copy."""
    rng, texts = random.Random(17), {}
    word = lambda: f"w{rng.randrange(4000)}"
    for i in range(12):
        whole, a = [word() for _ in range(400)], rng.randrange(100, 240)
        for k in range(2):
            texts[3 * i + k] = [word() for _ in range(5)] + whole + [word() for _ in range(5)]
        texts[3 * i + 2] = [word() for _ in range(20)] + whole[a : a + rng.randrange(50, 66)] + [word() for _ in range(20)]
    assert marked(spark, texts) == repeats(texts)


def test_repeated_passages_of_rows_that_share_an_id(spark):
    common, other = " ".join(f"c{i}" for i in range(80)), " ".join(f"o{i}" for i in range(80))
    df = spark.createDataFrame([(1, common), (1, other), (2, common), (None, other), (3, None), (4, ""), (1, other)], "doc_id long, text string")
    got = sorted((r.doc_id, r.start_word, r.end_word) for r in suffix_dedup.repeated_passages(df).collect())
    assert got == [(1, 0, 80), (2, 0, 80)]
