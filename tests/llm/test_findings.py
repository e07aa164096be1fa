"""Cases of the review of round 1: what was left out before."""

import random

import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402
from plenary.llm import ngram_jaccard, pii, queries  # noqa: E402


def test_pipeline_near_copies_between_the_thresholds(spark):
    """Of 50 words one differs: 41/51 of the 5-word shingles are shared, but only 43/51 < 85 % of the 4-word ones."""
    words = [f"w{i}" for i in range(50)]
    other = [*words[:25], "changed", *words[26:]]
    apart = [*words[:10], "changed", *words[11:40], "again", *words[41:]]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(apart)), (4, None)], "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect()} == {1, 3, 4}


def test_pii_adds_planted_variants_and_no_look_alikes(spark):
    """Every kind has a model, on a corpus of base spans and on one without any."""
    base = lambda i: f"say user{i}@host{i % 7}.org then +1 ({200 + i}) 555-{3000 + i} then 10.{i}.0.1 then 4111 1111 1111 1111 end"
    more = {
        "email: ann.lee (at) example (dot) com now": "ann.lee (at) example (dot) com", "write bob[at]site[dot]org now": "bob[at]site[dot]org", "contact eve at corp dot net now": "eve at corp dot net",
        "server 10.1.2.3:8080 now": "10.1.2.3:8080", "see 10.9.8.7:443 now": "10.9.8.7:443", "tel (058) 555-3468 now": "(058) 555-3468", "dial 0044 201 555 3468 now": "0044 201 555 3468",
        "call 201.555.3468 now": "201.555.3468", "credit 4111.1111.1111.1111 now": "4111.1111.1111.1111", "pay 5500/0000/0000/0004 now": "5500/0000/0000/0004",
    }
    none = [
        "wait at noon. Then go", "email us at noon. Then go", "look at dot com now", "server 10.1.2.999:8080 now", "server 10.1.2.3:99999 now", "version 10.1.2.3:8080 now", "tel 55 12 34 now",
        "score (058) 555-3468 now", "on 2024-05-12 10.30 we met", "at 129.138.182.176 now", "credit 4111.1111.1111.1112 now", "serial 4111.1111.1111.1111 now", "sum 4.111.111.111.111.111 now", "41111111.11111111 now",
    ]
    for corpus in ([base(i) for i in range(60)], ["nothing to see"]):
        models = pii.fit(spark.createDataFrame(list(enumerate(corpus)), "doc_id long, text string"))
        assert set(models) == set(pii.KINDS) and all(trees and threshold < float("inf") for _, trees, threshold in models.values())
        df = spark.createDataFrame(list(enumerate([*more, *none])), "doc_id long, text string")
        got = [sorted(s.match for kind in pii.KINDS for s in r[f"added_{kind}"]) for r in pii.find(df, models).orderBy("doc_id").collect()]
        assert got == [[x] for x in more.values()] + [[]] * len(none)


def test_pii_redaction_keeps_columns_of_any_name(spark):
    rows = [(1, "a@b.co x", "base_email", "t", 8, "r"), (2, None, None, None, None, None), (3, "", "s", "s", 0, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, base_email string, _text string, n_chars long, row string")
    assert sorted(map(tuple, pii.redact(df).collect()), key=str) == sorted([(1, "[EMAIL] x", "base_email", "t", 9, "r"), *rows[1:]], key=str)


def test_op9_on_whole_tables(spark):
    """All columns of the query against regular expressions and trees walked in plain Python, over a whole table."""
    import hashlib
    import re

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    models = pii.fit(docs)
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    luhn = lambda d: sum((int(c) * 2 - 9 * (int(c) > 4) if i % 2 else int(c)) for i, c in enumerate(reversed(d))) % 10 == 0

    def holds(kind, m):
        d = re.sub("[^0-9]", "", m)
        return {"email": True, "ip": kind != "ip" or all(int(x) < 256 for x in m.split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]

    def possible(kind, m):
        d = re.sub("[^0-9]", "", m)
        if kind == "email":
            written = re.sub(r" ?(\(dot\)|\[dot\]| dot ) ?", ".", re.sub(r" ?(@|\(at\)|\[at\]| at ) ?", "@", m))
            return bool(re.fullmatch(r"[^@ ]+@[^@ ]+\.[A-Za-z]{2,}", written)) and not re.search(r" at .*\.", m)
        if kind == "ip":
            ip, _, port = m.partition(":")
            return all(int(x) < 256 for x in ip.split(".")) and int(port or 0) < 65536
        return 14 <= len(d) <= 19 and luhn(d) if kind == "card" else 10 <= len(d) <= 15

    def row(kind, m, before, after):
        separators, groups = re.sub("[A-Za-z0-9]", "", m), re.split("[^A-Za-z0-9]+", m)
        mark = {"email": "@" in m, "ip": ":" not in m, "card": m[0] in "3456", "phone": m.startswith(("+", "00"))}[kind]
        tight = bool(re.search("[0-9A-Za-z@#_]$", before)) + bool(re.match("[0-9A-Za-z@_]|[.,][0-9]", after))
        return [len(m), len(re.sub("[^0-9]", "", m)), len(re.sub("[^A-Za-z]", "", m)), len(separators), len(set(separators)) or 1, len(groups), max(map(len, groups)), mark, tight, bool(re.search(pii.CUES[kind], before)), bool(re.search(pii.AGAINST, before))]

    got = {r.doc_id: r for r in queries.queries()["op9_pii"](spark, "/root/testdata/sf0.001").collect()}
    for r in docs.collect():
        text, base, every = r.text or "", [], []
        for order, kind in enumerate(pii.KINDS):
            spans = [m.span() for m in re.finditer(patterns[kind], text) if holds(kind, m[0])]
            base += [(a, order, b) for a, b in spans]
            constant, trees, threshold = models[kind]
            for m in re.finditer(pii.GENERATORS[kind], text):
                a, b = m.span()
                met = [(x, y) for x, y in spans if x < b and y > a and not (kind == "ip" and x == a and y < b)]
                if not met and possible(kind, m[0]) and pii.margin(constant, trees, row(kind, m[0], text[max(0, a - 24) : a], text[b : b + 2])) >= threshold:
                    every.append((a, order, b))
        joined = lambda spans: ",".join(f"{pii.KINDS[o]}:{a}:{b}" for a, o, b in sorted(spans))
        x = got.pop(r.doc_id)
        assert [x.n_email, x.n_ip, x.n_card, x.n_phone] == [sum(o == k for _, o, _ in base) for k in range(4)]
        assert x.base_sha256 == hashlib.sha256(joined(base).encode()).hexdigest() and x.spans == joined(base + every)
    assert not got


@pytest.mark.parametrize("block", [500, 200_000])
def test_jaccard_counts_links_inside_components(spark, monkeypatch, block):
    """Each text of a family of near copies links with all those that a comparison of all pairs finds."""
    monkeypatch.setattr(ngram_jaccard, "BLOCK", block)
    rng = random.Random(9)
    base, texts = [f"w{i}" for i in range(120)], {}
    for i in range(24):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(9)}"
        texts[i] = tuple(w)
    sets = {i: {w[k : k + 4] for k in range(len(w) - 3)} for i, w in texts.items()}
    other = {i: {frozenset(t) for j, t in sets.items() if t != sets[i] and 100 * len(t & sets[i]) >= 85 * len(t | sets[i])} for i in sets}
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")
    got = {r.doc_id: r.n_links for r in ngram_jaccard.jaccard_components(df).collect()}
    assert got == {i: len(o) for i, o in other.items()} and max(got.values()) > 4


def test_jaccard_rows_that_share_an_id(spark):
    """All rows of an id count, whichever text they have; they are one document, and tables in between are dropped."""
    text = lambda seed: " ".join(f"{seed}{i}" for i in range(30))
    rows = [(1, text("a")), (1, text("b")), (2, text("b")), (3, text("c")), (2, text("d")), (4, text("d") + " x"), (5, None), (6, text("e")), (1, ""), (9, ""), (9, text("a"))]
    got = {(r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in ngram_jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 27, 1, 0), (2, 27, 1, 0), (2, 27, 1, 1), (3, 27, 3, 0), (4, 28, 1, 1), (5, 0, 5, 0), (6, 27, 6, 0), (1, 0, 1, 0), (9, 0, 1, 0), (9, 27, 1, 0)}


def test_jaccard_of_unlike_sizes_over_a_shared_passage(spark):
    """Many documents hold one passage and little else: lists meet across bands of size."""
    rng = random.Random(12)
    shared = [f"p{i}" for i in range(60)]
    texts = {i: shared[: rng.randrange(30, 60)] + [f"u{i}-{k}" for k in range(rng.randrange(8))] for i in range(90)}
    sets = {i: {tuple(w[k : k + 4]) for k in range(len(w) - 3)} for i, w in texts.items()}
    parent = {i: i for i in texts}
    find = lambda i: i if parent[i] == i else find(parent[i])
    for a in texts:
        for b in texts:
            if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngram_jaccard.jaccard_components(df).collect()} == {i: find(i) for i in texts}


def test_sketches_differ_no_more_than_sets():
    import numpy as np

    rng = np.random.default_rng(3)
    for size in (0, 1, 40, 600, 20_000):
        common, one, two = (np.unique(rng.integers(-(2**63), 2**63, n)) for n in (size, size // 5, size // 7 + 1))
        x, y = ngram_jaccard.sketch(np.concatenate([common, one])), ngram_jaccard.sketch(np.concatenate([common, two]))
        assert len(x) == ngram_jaccard.LANES
        differ = sum(int(v).bit_count() for v in (x ^ y).view(np.uint64))
        assert 0 < differ <= len(one) + len(two)


@pytest.mark.parametrize("wide", [0.3, 1.0])
def test_jaccard_of_a_family_that_straddles_the_threshold(spark, wide):
    """Of many texts a little more or less alike than asked, no link between components is lost to a filter."""
    rng = random.Random(14)
    base, texts = [f"w{i}" for i in range(150)], {}
    for i in range(140):
        w = list(base)
        for k in rng.sample(range(len(w)), rng.randrange(1, 7)):
            w[k] = f"x{rng.randrange(400)}"
        texts[i] = w
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in texts.items()}
    parent = {i: i for i in texts}
    find = lambda i: i if parent[i] == i else find(parent[i])
    for a in texts:
        for b in texts:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_jaccard.jaccard_components(df, 5, 80, count_links=False, wide=wide).collect()}
    assert got == {i: find(i) for i in texts} and 3 < len(set(got.values())) < 137


def python_vector(text):
    """The fingerprint of a text as the sum over its paragraphs, in plain Python."""
    import re

    import xxhash

    start = lambda seed: xxhash.xxh64_intdigest(seed.to_bytes(4, "little"), 42)
    hashed = lambda seed, x: xxhash.xxh64_intdigest(x.encode(), start(seed))
    identity, count, bits = [0] * 8, 0, [[0] * 48 for _ in range(4)]
    for paragraph in filter(None, text.split("\n")):
        identity = [(a + hashed(seed, paragraph)) % 2**56 for seed, a in enumerate(identity)]
        for phrase in filter(None, re.split(r"[.,;:!?|]+[ \t\x0b\f\r]*|(?<=[dgklmsuvz])[ \t\x0b\f\r]+", paragraph)):
            count += 1
            for word in range(4):
                h = hashed(8 + word, phrase)
                for i in range(48):
                    bits[word][i] += h >> (i % 16 + 21 * (i // 16)) & 1
    return identity + [count] + [sum(bits[w][shift + 16 * k] << 21 * k for k in range(3)) for w in range(4) for shift in range(16)], [2 * c - count for some in bits for c in some]


def test_op5_on_whole_tables(spark):
    """All columns against plain Python: fingerprints are sums over paragraphs."""
    import hashlib
    import math

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    order = sorted(texts, reverse=True)
    got = {r.doc_id: r for r in queries.queries()["op5_document_fingerprints"](spark, "/root/testdata/sf0.001").collect()}
    hexed = lambda v: "-".join(f"{x:x}" for x in v)

    def near(x, y):
        if x[0] == y[0]:
            return 1.0
        dot, own = sum(a * b for a, b in zip(x[1], y[1])), sum(a * a for a in x[1]) * sum(b * b for b in y[1])
        return max(0.0, min(1.0, dot / math.sqrt(own))) if own else 0.0

    vectors = {i: python_vector(texts[i]) for i in order}
    for i, after in zip(order, [*order[1:], order[0]]):
        text, half, r = texts[i], len(texts[i]) // 2, got[i]
        edited = text[: len(text) - half] + texts[after][:half]
        v = python_vector(edited)
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == hexed(vectors[i][0]) and r.edited_fingerprint == hexed(v[0])
        assert abs(r.near_edited - near(vectors[i], v)) < 1e-9 and abs(r.near_next - near(vectors[i], vectors[after])) < 1e-9


def test_fingerprints_add_up(spark):
    """Sums and differences of random paragraphs, spaces at their ends included, in any order."""
    from pyspark.sql import functions as F

    from plenary.llm import fingerprints

    rng = random.Random(11)
    make = lambda: "".join(rng.choice(["a", " ", "  ", "d ", ". ", "\t", "end", ",", "ü"]) for _ in range(rng.randrange(1, 9)))
    rows = []
    for i in range(120):
        one, two = ([make() for _ in range(rng.randrange(1, 5))] for _ in range(2))
        both = one + two
        rng.shuffle(both)
        rows.append((i, "\n".join(one), "\n".join(two), "\n".join(both)))
    df = spark.createDataFrame([*rows, (999, "a", " b", " b\na")], "i long, a string, b string, c string").select(*(fingerprints.vector(F.col(x)).alias(x) for x in "abc"))
    for r in df.select("a", "c", fingerprints.plus(F.col("a"), F.col("b")).alias("p"), fingerprints.minus(F.col("c"), F.col("b")).alias("m")).collect():
        assert r.p == r.c and r.m == r.a


def test_counters_beyond_their_range(spark):
    """A sum of more than 2**20 phrases: counters don't reach their neighbours, and likeness holds."""
    from pyspark.sql import functions as F

    from plenary.llm import fingerprints

    df = spark.createDataFrame([(" ".join(f"w{i}." for i in range(3000)),)], "t string").select(fingerprints.vector(F.col("t")).alias("v"))
    once = df.first().v
    for _ in range(9):
        df = df.select(fingerprints.plus(F.col("v"), F.col("v")).alias("v"))
    big = spark.createDataFrame([(once, df.first().v)], "a array<long>, b array<long>")
    r = big.select(fingerprints.likeness(F.col("a"), F.col("b")).alias("near"), fingerprints.minus(F.col("b"), F.col("b")).alias("zero")).first()
    assert r.near > 0.999 and not any(r.zero)


def test_packing_of_letters_that_change_in_lower_case():
    """Ids equal the library's on strings whose normalised lower case isn't letters only."""
    from tokenizers import Tokenizer

    from plenary.llm import packing

    rng, tokenizer, memo = random.Random(6), Tokenizer.from_file(packing.tokenizer_path()), packing.ChunkIds(packing.tokenizer_path())
    parts = ["a", "the", "İ", "é", "e\u0301", "²", "ß", "Σ", "ς", "1", ".", ",", "!?", "'s", " ", "\n", "ﬁ", "Ⅷ", "ª", "한", "\u1112\u1161\u11ab", "क", "\u0301", "<|endoftext|>", "<|", "\xa0", "\x85", "×", "Ü", "Ŋ", "ŉ", "ǅ", "'S", "'ll", "42", "$", "\x1c", "\x00", "ſ", "K"]
    texts = ["theİ.", *("".join(rng.choice(parts) for _ in range(rng.randrange(1, 9))) for _ in range(4000))]
    got = list(memo.texts([t.encode() for t in texts]))
    assert got == [memo.encode(t) for t in texts] and got[0] == memo.encode("theİ.") and len(got[0]) == 4 * len(tokenizer.encode("theİ.", add_special_tokens=False).ids)


def test_pairs_of_groups_meet_once(spark):
    """Groups that share many shingles of their prefixes are paired at the first only, and none is lost."""
    from pyspark.sql import functions as F

    rng = random.Random(5)
    groups = {g: sorted(rng.sample(range(12), 8)) for g in range(30)} | {100 + g: sorted(rng.sample(range(100, 160), 5)) for g in range(20)}
    rows = [(token, place + 1, g, 40, 0, g, g) for g, tokens in groups.items() for place, token in enumerate(tokens)]
    at = spark.createDataFrame(rows, "token long, pos int, gid long, n int, own int, low long, high long")
    at = at.withColumns({f"{name}_{i}": F.lit(0).cast("long") for name in ("all", "any") for i in range(ngram_jaccard.LANES)})
    fits = lambda i, j: 185 * (1 + min(40 - i, 40 - j)) >= 85 * 80  # noqa: E731  places from 1
    want = {(g, h) for g, x in groups.items() for h, y in groups.items() if g < h and any(fits(x.index(t) + 1, y.index(t) + 1) for t in set(x) & set(y))}
    found = [tuple(r) for r in ngram_jaccard._across(at, 85).collect()]
    assert set(found) == want and len(found) < 1.2 * len(want)
