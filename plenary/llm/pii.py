"""Personal data: candidate spans chosen by gradient boosting (native).

Exact patterns give base spans. High-recall generators propose more spans, which
may overlap each other and the base ones: e-mail addresses with spelled-out
signs, phone numbers without a country code, digits with other separators,
addresses with a port. Those that can't be what they look like (a wrong check
digit, a number beyond 255) go. Boosted regression trees score the rest by
their format and context; a threshold calibrated on a part kept aside selects.

No labels for such data exist, so training spans are made of base spans, those
of a bounded sample of the corpus and a few fixed ones, in their contexts:
rewritten as people write them they are positive examples, rewritten as what
only looks like them (versions, dates, decimals, serial numbers, sentences)
negative ones. What decides the label is how a span was made, not a feature.
Every kind is fitted, whatever the corpus. Trees are fitted on the driver and
compiled to column expressions, so scoring is all DataFrame expressions, in one
pass over the texts without a shuffle.

Offsets are code points. Spark's regular expressions give matches and the gaps
between them; offsets are sums of their lengths. Patterns use possessive
quantifiers where nothing can be given back, so long runs of characters cost
neither stack nor quadratic time.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, smallest_hashes

KINDS = ("email", "ip", "card", "phone")

_LOCAL = "A-Za-z0-9._%+-"
#: The base patterns; a run of characters is only tried from its start or the last match's end.
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # a run of digits with single separators is one match; those under 14 digits fail anyway
    "card": r"[0-9](?:[\x20-]?+[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Generators of proposals by the kind that they propose.
GENERATORS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:@|\(at\)|\[at\]|\x20at\x20)\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\(dot\)|\[dot\]|\x20dot\x20)\x20?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9.])[0-9]++(?:\.[0-9]++){3}(?::[0-9]++)?",
    "card": r"(?<![0-9])[0-9]{4}(?:[\x20.‐-―/-]?[0-9]){10,15}+(?![0-9])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+|00)?\(?[0-9]{1,4}\)?(?:[\x20./()-]{1,2}[0-9]{2,5}){2,5}+(?![0-9A-Za-z])",
}
#: Characters that context features see before a span and after it.
CONTEXT, AFTER = 24, 2
#: Words that announce personal data of a kind, and words that announce another number or name.
CUES = {
    "email": r"(?i)\b(?:e-?mail|contact|mailto|correo|courriel)\b",
    "ip": r"(?i)\b(?:ip|address|host|server|adresse)\b",
    "card": r"(?i)\b(?:card|credit|visa|konto|tarjeta|carte)\b",
    "phone": r"(?i)\b(?:phone|tel|call|mobile|fax|tel[eé]fono|t[eé]l[eé]phone|telefon)\b",
}
AGAINST = r"(?i)\b(?:version|release|section|chapter|page|isbn|order|invoice|serial|score|total|id|date|kapitel|página|numéro)\b"
#: Announcements that training spans are given.
ANNOUNCED = {"email": ("mail ", "E-mail: ", "contact ", "correo: "), "ip": ("server ", "IP: ", "host ", "adresse "), "card": ("card ", "credit: ", "visa ", "tarjeta "), "phone": ("tel ", "phone: ", "call ", "telefon ")}
OTHERWISE = ("version ", "section ", "order ", "serial ", "score ", "id ")

FEATURES = ("length", "digits", "letters", "separators", "kinds of separators", "groups", "longest group", "mark", "tight", "cue", "against")

#: Documents that are searched for base spans to learn from, and how many are kept of each kind (of smallest hash), with at most so many characters.
SAMPLE_DOCS, SAMPLE_SPANS, SPAN_CHARS = 20_000, 500, 100
TREES, DEPTH, RATE, LEAST = 20, 4, 0.3, 5
#: A proposal must be as sure as keeps this share of the selected ones right on the part kept aside.
PRECISION = 0.98


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _sum(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0), lambda a, x: a + x)


_BLOCK = 256


def _running(lengths: Column) -> Column:
    """Sums of ``lengths`` up to each place, itself excluded; blocks are summed first, so long arrays stay cheap."""
    whole = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _BLOCK).cast("int")), lambda b: _sum(F.slice(lengths, b * _BLOCK + 1, _BLOCK)))
    one = lambda blocks: F.transform(
        lengths,
        lambda _, i: _sum(F.slice(blocks, F.lit(1), F.floor(i / _BLOCK).cast("int"))) + _sum(F.slice(lengths, F.floor(i / _BLOCK).cast("int") * _BLOCK + 1, i % _BLOCK)),
    )
    return F.when(F.size(lengths) == 0, F.array().cast("array<int>")).otherwise(_let(whole, one))


def _located(text: Column, pattern: str) -> Column:
    """Array of (start, end, match) of the matches of ``pattern``, in order, in code points."""
    matches, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def place(both: Column) -> Column:
        # the gap before each match, and the match
        lengths = F.zip_with(F.slice(both["gaps"], F.lit(1), F.size(both["matches"])), both["matches"], lambda g, m: F.length(g) + F.length(m))
        return F.zip_with(
            F.zip_with(_running(lengths), lengths, lambda before, n: before + n),
            both["matches"],
            lambda end, m: F.struct((end - F.length(m)).alias("start"), end.alias("end"), m.alias("match")),
        )

    return _let(F.struct(matches.alias("matches"), gaps.alias("gaps")), place)


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    values = F.transform(F.regexp_extract_all(F.reverse(digits), F.lit("[0-9]"), F.lit(0)), lambda c: c.cast("int"))
    doubled = F.transform(values, lambda v, i: F.when(i % 2 == 0, v).otherwise(F.when(v > 4, 2 * v - 9).otherwise(2 * v)))
    return (_sum(doubled) % 10 == 0) & (digits != "")


def octets(match: Column) -> Column:
    """Whether all numbers between dots are at most 255."""
    parts = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))


def _holds(kind: str, match: Column) -> Column:
    n = F.length(digits_of(match))
    return {
        "email": lambda: F.lit(True),
        "ip": lambda: octets(match),
        "card": lambda: n.between(14, 19) & luhn(digits_of(match)),
        "phone": lambda: n.between(10, 15),
    }[kind]()


#: A sign without which a pattern can't match, so that most texts are passed over quickly.
_NEEDS = {"email": "@", "phone": "+", "ip": ".", "card": None}
_NONE = "array<struct<start:int,end:int,match:string>>"


def base_spans(text: Column, kind: str) -> Column:
    """Array of (start, end, match) of the base spans of ``kind`` in ``text`` (not null)."""
    found = F.filter(_located(text, BASE[kind]), lambda s: _holds(kind, s["match"]))
    need = F.contains(text, F.lit(_NEEDS[kind])) if _NEEDS[kind] else F.lit(True)
    return F.when(need & text.rlike(BASE[kind].replace(r"\G|", "")), found).otherwise(F.array().cast(_NONE))


def proposals(text: Column, kind: str) -> Column:
    """Array of (start, end, match) that the generator of ``kind`` proposes."""
    return F.when(text.rlike(GENERATORS[kind]), _located(text, GENERATORS[kind])).otherwise(F.array().cast(_NONE))


def _possible(match: Column, kind: str) -> Column:
    """Whether a proposal can be what it looks like: an address once its signs are written out, numbers in range, a right check digit."""
    if kind == "email":
        # after the bare word at, dots must be words too
        written = F.regexp_replace(match, r"\x20?(?:@|\(at\)|\[at\]|\x20at\x20)\x20?", "@")
        written = F.regexp_replace(written, r"\x20?(?:\(dot\)|\[dot\]|\x20dot\x20)\x20?", ".")
        return F.regexp_like(written, F.lit(r"^[^@\x20]++@[^@\x20]+\.[A-Za-z]{2,}$")) & ~F.regexp_like(match, F.lit(r"\x20at\x20.*\."))
    if kind == "ip":
        port = F.regexp_extract(match, ":0*([0-9]*)$", 1)
        return octets(F.regexp_replace(match, ":.*", "")) & ((F.length(port) < 5) | ((F.length(port) == 5) & (port <= "65535")))
    digits = digits_of(match)
    return F.length(digits).between(14, 19) & luhn(digits) if kind == "card" else F.length(digits).between(10, 15)


def features(kind: str, match: Column, before: Column, after: Column) -> list[Column]:
    """Format of a proposal and its context, as doubles, in the order of ``FEATURES``."""
    separators = F.regexp_replace(match, "[A-Za-z0-9]", "")
    # an edge is tight if the next character there belongs to a longer word or number
    tight = F.regexp_like(before, F.lit("[0-9A-Za-z@#_]$")).cast("int") + F.regexp_like(after, F.lit("^(?:[0-9A-Za-z@_]|[.,][0-9])")).cast("int")
    mark = {"email": F.contains(match, F.lit("@")), "ip": ~F.contains(match, F.lit(":")), "card": F.regexp_like(match, F.lit("^[3-6]")), "phone": F.startswith(match, F.lit("+")) | F.startswith(match, F.lit("00"))}[kind]
    return [
        c.cast("double")
        for c in (
            F.length(match),
            F.length(digits_of(match)),
            F.length(F.regexp_replace(match, "[^A-Za-z]", "")),
            F.length(separators),
            F.size(F.array_distinct(F.split(separators, ""))),
            F.size(F.split(match, "[^A-Za-z0-9]+")),
            F.array_max(F.transform(F.split(match, "[^A-Za-z0-9]+"), lambda g: F.length(g))),
            mark,
            tight,
            F.regexp_like(before, F.lit(CUES[kind])),
            F.regexp_like(before, F.lit(AGAINST)),
        )
    ]


def _context(text: Column, span: Column) -> tuple[Column, Column]:
    before = F.substring(text, F.greatest(F.lit(1), span["start"] - CONTEXT + 1), F.least(F.lit(CONTEXT), span["start"]))
    return before, F.substring(text, span["end"] + 1, F.lit(AFTER))


def seeds(kind: str) -> list[tuple[str, str, str]]:
    """A few base spans (match, before, after) that every model is taught, made by rule."""
    out = []
    for i in range(24):
        if kind == "card":
            digits = f"{3 + i % 4}{111111111111111 // (i + 1) * 7 % 10**14:014d}"
            twice = [int(c) * 2 - 9 * (int(c) > 4) if k % 2 == 0 else int(c) for k, c in enumerate(reversed(digits))]
            match = digits + str(-sum(twice) % 10)
        else:
            match = {"email": f"name{i}.last@site{i % 5}.{'com' if i % 2 else 'example.org'}", "ip": f"{10 + 9 * i}.{i}.{7 * i}.{i + 1}", "phone": f"+{1 + i % 90} ({200 + i}) 555-{1000 + 7 * i}"}[kind]
        out.append((match, "of the ", " and"[:AFTER]))
    return out


def examples(kind: str, match: str, before: str, after: str, i: int) -> list[tuple[str, str, str, int]]:
    """Training spans (match, before, after, y) made of the ``i``-th base span."""
    cue, other = before + ANNOUNCED[kind][i % 4], before + OTHERWISE[i % len(OTHERWISE)]
    digits = re.sub("[^0-9]", "", match)
    if kind == "email":
        local, _, host = match.rpartition("@")
        labels = host.split(".")
        spelled = f"{local} at {' dot '.join(labels)}"
        yes = [(match, before), (f"{local} (at) {' (dot) '.join(labels)}", before), (f"{local}[at]{'[dot]'.join(labels)}", before), (f"{local}[at]{host}", before), (spelled, cue)]
        no = [(spelled, before), (spelled, other), (f"{local} at {labels[0]} dot {labels[-1]}", before)]
        loose = [(match, before, "@x"), (f"{local} (at) {' (dot) '.join(labels)}", before, "@x")]
    elif kind == "ip":
        ports = f"{match}:{(80, 443, 8080, 5432)[i % 4]}"
        yes = [(match, before), (ports, before), (ports, cue)]
        no = [(match, other), (ports, other), (ports, before + "v")]
        loose = [(match, before, f".{i % 10}"), (ports, before, ".5")]
    elif kind == "card":
        fours = [digits[k : k + 4] for k in range(0, len(digits), 4)]
        dotted, sign = ".".join(fours), "./‐–"[i % 4]
        yes = [(digits, before), (dotted, before), (sign.join(fours), before), (sign.join(fours), cue), (dotted, cue)]
        cut = 8 + i % 5
        thousands = digits[: len(digits) % 3 or 3] + "".join("." + digits[k : k + 3] for k in range(len(digits) % 3 or 3, len(digits), 3))
        no = [(f"{digits[:cut]}.{digits[cut:]}", before), (thousands, before), (dotted, other), (sign.join(fours), other), (sign.join(fours), before + "x")]
        loose = [(f"{digits[:cut]}.{digits[cut:]}", before, ".1")]
    else:
        d = (digits + "0123456789")[-10:]
        plain = (f"({d[:3]}) {d[3:6]}-{d[6:]}", f"{d[:3]} {d[3:6]} {d[6:]}", f"{d[:3]}.{d[3:6]}.{d[6:]}", f"{d[:3]}-{d[3:6]}-{d[6:]}")
        yes = [(match, before), (f"00{digits[:-9]} {d[1:4]} {d[4:7]} {d[7:]}", before), *((p, cue) for p in plain)]
        date = f"20{d[0:2]}-0{1 + i % 9}-{10 + i % 18} {10 + i % 12}.{d[4:6]}"
        address = f"{100 + int(d[:2])}.{100 + int(d[2:4])}.{100 + int(d[4:6])}.{100 + int(d[6:8])}"
        no = [*((p, before) for p in plain), *((p, other) for p in plain[:2]), (date, before), (address, before), (f"{1 + i % 9}.{d[:3]}.{d[3:6]}.{d[6:9]}", before), (f"{d[:2]}-{d[2:4]} {d[4:6]}-{d[6:8]} {d[8:]}", before)]
        loose = [(plain[1], cue, ".5")]
    return [(m, b[-CONTEXT:], after, 1) for m, b in yes] + [(m, b[-CONTEXT:], after, 0) for m, b in no] + [(m, b[-CONTEXT:], z, 0) for m, b, z in loose]


def boost(rows: list[tuple[float, ...]], y: list[int]) -> tuple[float, list]:
    """Gradient boosting of logistic loss: (constant, trees). A tree is a float or (feature, cut, left, right).

    Deterministic: cuts are tried in order, and the first of equal gains wins.
    """
    import numpy as np

    x, y = np.array(rows, dtype=float).reshape(len(y), -1), np.array(y, dtype=float)
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    constant = math.log(share / (1 - share))
    margin, trees = np.full(len(y), constant), []

    def grow(at, gradient, hessian, depth):
        g, h = gradient[at].sum(), hessian[at].sum()
        best = (1e-6, None, None)
        if depth and len(at) >= 2 * LEAST:
            for f in range(x.shape[1]):
                values = np.unique(x[at, f])
                for cut in (values[:-1] + values[1:]) / 2:
                    left = x[at, f] <= cut
                    if LEAST <= left.sum() <= len(at) - LEAST:
                        gl, hl = gradient[at][left].sum(), hessian[at][left].sum()
                        gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
                        if gain > best[0] + 1e-9:
                            best = (gain, f, float(cut))
        if best[1] is None:
            return float(RATE * g / (h + 1))
        left = x[at, best[1]] <= best[2]
        return (best[1], best[2], grow(at[left], gradient, hessian, depth - 1), grow(at[~left], gradient, hessian, depth - 1))

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        tree = grow(np.arange(len(y)), y - p, p * (1 - p), DEPTH)
        trees.append(tree)
        margin += np.array([leaf(tree, r) for r in x])
    return constant, trees


def leaf(tree, row) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def margin(constant: float, trees: list, row) -> float:
    """Added up one by one, as the compiled columns are: sum() compensates rounding, so a margin at the threshold could differ."""
    for tree in trees:
        constant += leaf(tree, row)
    return constant


def compiled(tree, columns) -> Column:
    """A tree as a column expression."""
    if not isinstance(tree, tuple):
        return F.lit(tree)
    return F.when(columns[tree[0]] <= tree[1], compiled(tree[2], columns)).otherwise(compiled(tree[3], columns))


def fit(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", sample_docs: int = SAMPLE_DOCS, sample_spans: int = SAMPLE_SPANS) -> dict[str, tuple[float, list, float]]:
    """By kind: constant, trees and threshold on the margin.

    At most ``sample_spans`` base spans of each kind, of about ``sample_docs``
    documents, reach the driver, with their contexts; the texts are read once.
    Rows with a null id don't teach. Every fourth base span is kept aside, with
    all that is made of it; the threshold is the lowest that keeps ``PRECISION`` there.
    """
    texts = smallest_hashes(docs.where(F.col(id_col).isNotNull()), id_col, sample_docs).select(F.xxhash64(F.col(id_col)).alias("h"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    tagged = F.concat(*(F.transform(base_spans(F.col("text"), kind), lambda s, k=kind: F.struct(F.lit(k).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["match"].alias("match"))) for kind in KINDS))
    found = texts.select("h", "text", F.explode(tagged).alias("s")).where(F.length("s.match") <= SPAN_CHARS)
    before, after = _context(F.col("text"), F.col("s"))
    drawn = found.select("s.kind", "s.match", before.alias("before"), after.alias("after")).distinct()
    least = Window.partitionBy("kind").orderBy(F.xxhash64("match", "before", "after"), "match", "before", "after")
    rows = drawn.withColumn("place", F.row_number().over(least)).where(F.col("place") <= sample_spans).orderBy("kind", "place").collect()
    models, spark = {}, docs.sparkSession
    for kind in KINDS:
        base = seeds(kind) + [(r["match"], r["before"], r["after"]) for r in rows if r["kind"] == kind]
        made = [(i, *x) for i, b in enumerate(base) for x in examples(kind, *b, i)]
        frame = spark.createDataFrame(made, "i int, match string, before string, after string, y int")
        judged = frame.where(_possible(F.col("match"), kind)).select("i", "y", F.array(*features(kind, F.col("match"), F.col("before"), F.col("after"))).alias("x")).collect()
        judged.sort(key=lambda r: (r["i"], r["y"], r["x"]))
        train, aside = [r for r in judged if r["i"] % 4 != 3], [r for r in judged if r["i"] % 4 == 3]
        constant, trees = boost([tuple(r["x"]) for r in train], [r["y"] for r in train])
        margins = sorted(((margin(constant, trees, r["x"]), r["y"]) for r in aside), reverse=True)
        threshold, right = float("inf"), 0
        for i, (m, y) in enumerate(margins, 1):
            right += y
            if m > 0 and right >= PRECISION * i and (i == len(margins) or margins[i][0] < m):
                threshold = m
        models[kind] = (constant, trees, threshold)
    return models


def _added(text: Column, kind: str, model, base: Column) -> Column:
    """Proposals that the trees select and that overlap no base span of the kind, or add a port to one.

    Proposals of a kind never overlap each other, since they are successive matches.
    """
    constant, trees, threshold = model

    def sure(span: Column) -> Column:
        x = F.array(*features(kind, span["match"], *_context(text, span)))
        return _let(x, lambda x: sum((compiled(t, [x[i] for i in range(len(FEATURES))]) for t in trees), F.lit(constant)) >= threshold)

    def taken(span: Column) -> Column:
        met = lambda b: (b["start"] < span["end"]) & (b["end"] > span["start"])
        if kind == "ip":  # an address with its port goes beyond the base span that it begins with
            return F.exists(base, lambda b: met(b) & ((b["start"] != span["start"]) | (b["end"] >= span["end"])))
        return F.exists(base, met)

    return F.filter(proposals(text, kind), lambda s: ~taken(s) & _possible(s["match"], kind) & sure(s))


def _found(rows: DataFrame, models: dict) -> DataFrame:
    """``rows`` (text, not null, and row) with base_email, ..., added_email, ...."""
    text, none = F.col("text"), F.array().cast(_NONE)
    rows = rows.select("*", *(base_spans(text, kind).alias(f"base_{kind}") for kind in KINDS))
    return rows.select("*", *((_added(text, kind, models[kind], F.col(f"base_{kind}")) if kind in models else none).alias(f"added_{kind}") for kind in KINDS))


def find(docs: DataFrame, models: dict | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, the base spans of each kind and the added ones, of every row.

    Arrays of (start, end, match): base_email, ..., added_email, .... Null and
    empty texts have no spans; texts are read whole, however long. Rows that
    repeat an id or a text give a row each; an empty table gives an empty one.
    Other columns of ``docs`` don't matter. ``models`` ({}: base spans only) are
    fitted on ``docs`` unless given.
    """
    models = fit(docs, text_col, id_col) if models is None else models
    rows = docs.select(F.col(id_col).alias("row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return _found(rows, models).drop("text").withColumnRenamed("row", "doc_id")


def _joined(columns: dict[str, list[str]]) -> Column:
    """kind:start:end of the spans, by start, then in the order of ``KINDS``."""
    def tagged(name: str, order: int) -> Column:
        return F.transform(F.col(name), lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end")))

    every = F.concat(*(tagged(name, i) for i, kind in enumerate(KINDS) for name in columns[kind]))
    kinds = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(F.array_sort(every), lambda s: F.concat_ws(":", F.element_at(kinds, s["order"] + 1), s["start"].cast("string"), s["end"].cast("string"))))


def redact(docs: DataFrame, models: dict | None = None) -> DataFrame:
    """``docs`` with each span, base or added, replaced by its kind in brackets, and n_chars (if there) made to match.

    Of spans that overlap, the one that begins first is replaced, and what the
    next covers beyond it as well. Null and empty texts stay as they are; rows
    and columns keep their number and names, whatever these are.
    """
    models = fit(docs) if models is None else models
    # columns of docs stay inside a struct, so their names can't clash with those used here
    rows = _found(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.coalesce(F.col("text"), F.lit("")).alias("text")), models)

    def tagged(name: str, kind: str) -> Column:
        return F.transform(F.col(name), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(f"[{kind.upper()}]").alias("tag")))

    every = F.array_sort(F.concat(*(tagged(f"{part}_{kind}", kind) for kind in KINDS for part in ("base", "added"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate(
        every,
        start,
        lambda a, s: F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.concat(a["out"], F.when(s["start"] >= a["at"], F.concat(F.substring(F.col("text"), a["at"] + 1, s["start"] - a["at"]), s["tag"])).otherwise(F.lit(""))).alias("out"),
        ),
        lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.length("text"))),
    )
    rows = rows.select("row", F.when(F.size(every) == 0, F.col("row")["text"]).otherwise(done).alias("text"))
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return rows.select(*(changed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(documents(spark, sf_dir))
    base = {kind: [f"base_{kind}"] for kind in KINDS}
    every = {kind: [f"base_{kind}", f"added_{kind}"] for kind in KINDS}
    return found.select(
        "doc_id",
        *(F.size(f"base_{kind}").cast("long").alias(f"n_{kind}") for kind in KINDS),
        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"),
        _joined(every).alias("spans"),
    )


QUERIES = {"op9_pii": op9_pii}
ORACLES: dict[str, str] = {}
