"""Whole queries of the review of round 1, against brute force on small tables ."""

import collections
import datetime
import re

import duckdb
import pytest

from plenary import registry

@pytest.fixture(scope="module")
def small(tmp_path_factory):
    d, con = tmp_path_factory.mktemp("small"), duckdb.connect()
    tables = {
        "nation": "SELECT 0 AS n_nationkey, 'NATION_0' AS n_name, 1 AS n_regionkey",
        "customer": "SELECT range AS c_custkey, 0 AS c_nationkey FROM range(20)",
        "part": "SELECT range AS p_partkey, ['cold bolt', 'cold gear', 'hot rod'][1 + range % 3] AS p_name, 'Brand#' || (range % 2) AS p_brand, 'TYPE' AS p_type FROM range(395, 1210, 5)",
        "orders": "SELECT range AS o_orderkey, range % 20 AS o_custkey, 'F' AS o_orderstatus, '1-URGENT' AS o_orderpriority, 1.0 AS o_totalprice, TIMESTAMP '1997-05-01' + INTERVAL (range % 60) DAY AS o_orderdate FROM range(250, 350)",
        "lineitem": "SELECT range AS l_orderkey, 395 + 5 * (range % 7) AS l_partkey, range % 4 AS l_suppkey, 'F' AS l_linestatus FROM range(250, 350) UNION ALL SELECT range, 1205, 9, 'F' FROM range(250, 350)",
        "documents": "SELECT 1 AS doc_id, 'Nation nation tion' AS text UNION ALL SELECT 2, 'other nation'",
        "events": "SELECT range AS event_id, range AS user_id, 'view' AS event_type, TIMESTAMP '2024-01-01 01:00:00' + INTERVAL (range) DAY AS ts FROM range(10)",
    }
    for name, sql in tables.items():
        con.sql(f"CREATE TABLE {name} AS {sql}")
        con.sql(f"COPY {name} TO '{d}/{name}.parquet' (FORMAT parquet)")
    return str(d), {n: con.sql(f"SELECT * FROM {n}").fetchall() for n in tables}


def run(spark, small, name):
    return registry.queries()[name](spark, small[0]).collect()


def test_type_conflicts(spark, small):
    mentions = {}
    for _, p, *_ in small[1]["lineitem"]:
        mentions[p] = mentions.get(p, 0) + 1
    want = set()
    for i, name, kind, _ in small[1]["part"]:
        for j, other, other_kind, _ in small[1]["part"]:
            if i < j and name == other and kind != other_kind:
                m, o = mentions.get(i, 0), mentions.get(j, 0)
                want.add((name, i, j, j if (m <= 2 and o > 3 * m) or other_kind < kind else i))
    got = run(spark, small, "type_conflicts")
    assert len(got) == len(want) and {tuple(r) for r in got} == want and max(r.id for r in got) > 400


def test_entity_by_jurisdiction(spark, small):
    want = {}
    for _, p, *_ in small[1]["lineitem"]:
        want[p] = want.get(p, 0) + 1
    assert {(r.id, r.jurisdiction_id, r.mentions, r.meetings) for r in run(spark, small, "entity_by_jurisdiction")} == {(p, 1, n, n) for p, n in want.items()}


def test_linked_participants(spark, small):
    first = {}
    for i, name, *_ in small[1]["part"]:
        first[name] = min(i, first.get(name, i))
    got = {(r.id, r.name): (r.entity_id, r.confidence) for r in run(spark, small, "linked_participants")}
    names = ("cold bolt", "cold gear", "cold rod")
    exact = {(m, names[m % 3]): (first[names[m % 3]], 0.95) for m, *_ in small[1]["orders"] if names[m % 3] in first}
    assert {k: v for k, v in got.items() if v[1] == 0.95} == exact and max(m for m, _ in exact) >= 300


def test_unique_conflicts(spark, small):
    first, want = {}, set()
    for i, name, brand, kind in small[1]["part"]:
        first[name, brand, kind] = min(i, first.get((name, brand, kind), i))
    for i, *code in small[1]["part"]:
        if first[tuple(code)] != i:
            want.add(("/".join(code), i))
    got = run(spark, small, "unique_conflicts")
    assert len(got) == len(want) and {(r.code, r.p_partkey) for r in got} == want and max(i for _, i in want) > 600


def test_revision_history(spark, small):
    cases = collections.defaultdict(list)
    for item, case, *_, at in small[1]["orders"]:
        cases[case].append((at.date(), item))
    want = set()
    for case, held in cases.items():
        held.sort()
        want |= {(case, item, day.isoformat(), n + 1, (day - held[n - 1][0]).days if n else None) for n, (day, item) in enumerate(held)}
    got = run(spark, small, "revision_history")
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_token_index(spark, small):
    terms = collections.defaultdict(list)
    for i, text in small[1]["documents"]:
        for t in re.findall("[a-z0-9]+", text.lower()):
            terms[t].append(i)
    assert {tuple(r) for r in run(spark, small, "token_index")} == {(t, len(set(ids)), len(ids)) for t, ids in terms.items()}


def test_sliding_windows(spark, small):
    want = collections.Counter()
    for *_, at in small[1]["events"]:
        begins = at.replace(hour=at.hour // 6 * 6, minute=0)
        want.update((begins - datetime.timedelta(hours=6 * k)).strftime("%Y-%m-%d %H") for k in range(4))
    assert {r.start: r.views for r in run(spark, small, "sliding_windows")} == want and max(want) > "2024-01-04"


def test_supporting_edges(spark, small):
    held, seen = collections.defaultdict(set), collections.defaultdict(set)
    for m, *_, at in small[1]["orders"]:
        held["NATION_0", at.strftime("%Y-%m")].add(m)
    for m, _, member, _ in small[1]["lineitem"]:
        seen[member].add(m)
    want = {(body, month, member, len(ids)) for (body, month), ids in held.items() for member in seen if ids <= seen[member]}
    assert {tuple(r) for r in run(spark, small, "supporting_edges")} == want and len(want) == 2


def test_merge_plan(spark, tmp_path):
    """Against all pairs: words in another order, a suffix, containment without a shared word, a chain, an acronym."""
    names = ["river oak trust", "trust river oak", "river oak trust llc", "Acme", "Acme LLC", "oldbolt", "coldbolts", "Salt Power", "SP", "ab", "xaby", "lone", "lone", None, None, ""]
    con = duckdb.connect()
    con.execute("CREATE TABLE part (p_partkey BIGINT, p_name VARCHAR, p_brand VARCHAR)")
    con.executemany("INSERT INTO part VALUES (?, ?, 'B')", list(enumerate(names)))
    con.sql(f"COPY part TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    con.sql(f"COPY (SELECT (range * range) % {len(names)} AS l_partkey FROM range(40)) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    mentions = collections.Counter(i * i % len(names) for i in range(40))

    def alike(a, b):
        a, b = (" ".join(re.findall("[a-z0-9]+", n.lower())) for n in (a, b))
        x, y = set(a.split()), set(b.split())
        short, long = sorted((a, b), key=len)
        return (x | y and len(x & y) / len(x | y) >= 0.85) or (len(short) >= 3 and short in long and len(short) > 0.25 * len(long))

    group = {i: i for i in range(len(names))}
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            if a is not None and b is not None and (a == b or alike(a, b)):
                old, new = group[i], group[j]
                group = {k: new if g == old else g for k, g in group.items()}
    held = collections.defaultdict(list)
    for i, g in group.items():
        held[g].append(i)
    want = {(min(ids, key=lambda i: (-mentions[i], i)), len(ids), sum(mentions[i] for i in ids), len(ids) - 1) for ids in held.values()}
    got = {tuple(r) for r in registry.queries()["merge_plan"](spark, str(tmp_path)).collect()}
    assert got == want and max(n for _, n, *_ in want) == 3


def rows_made(plan):
    """The most rows that a node of an executed plan put out."""
    made, kids = plan.metrics().get("numOutputRows"), plan.children()
    kind = plan.getClass().getSimpleName()
    below = [plan.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [plan.plan()] if kind.endswith("QueryStageExec") else [kids.apply(i) for i in range(kids.size())]
    return max([made.get().value() if made.isDefined() else 0, *map(rows_made, below)])


def test_inferred_absence(spark, tmp_path):
    """Against all pairs: members who voted on all, on the first, on all but the first, null ids, a motion held twice; and no row for each pair."""
    con = duckdb.connect()
    con.sql("CREATE TABLE nation AS SELECT range AS n_nationkey, 'NATION_' || range AS n_name, 1 AS n_regionkey FROM range(2)")
    con.sql("CREATE TABLE customer AS SELECT range AS c_custkey, range % 2 AS c_nationkey FROM range(6)")
    orders = [(i if i else None, i % 6) for i in range(120)] + [(9000 + 4096 * i, 1) for i in range(8)] + [(13, 3), (13, 2)]
    con.execute("CREATE TABLE orders (o_orderkey BIGINT, o_custkey BIGINT)")
    con.executemany("INSERT INTO orders VALUES (?, ?)", orders)
    con.sql("ALTER TABLE orders ADD COLUMN o_orderstatus VARCHAR; ALTER TABLE orders ADD COLUMN o_orderpriority VARCHAR; ALTER TABLE orders ADD COLUMN o_totalprice DOUBLE; ALTER TABLE orders ADD COLUMN o_orderdate TIMESTAMP")
    keys = sorted({k for k, _ in orders if k})
    votes = [(k, 1) for k in keys] + [(k, 2) for k in keys[:20]] + [(k, 3) for k in keys[2:]] + [(k, None) for k in keys[:30]] + [(k, 4) for k in keys[:8]] + [(None, 2), (7, 2), (13, 5)]
    votes += [(k, 100 + i) for i in range(200) for k in keys[i % 7 : i % 7 + 12]]
    con.execute("CREATE TABLE lineitem (l_orderkey BIGINT, l_suppkey BIGINT)")
    con.executemany("INSERT INTO lineitem VALUES (?, ?)", votes)
    con.sql("ALTER TABLE lineitem ADD COLUMN l_linestatus VARCHAR; ALTER TABLE lineitem ADD COLUMN l_returnflag VARCHAR")
    con.sql("UPDATE lineitem SET l_linestatus = CASE WHEN l_orderkey % 11 = 0 THEN 'O' ELSE 'F' END, l_returnflag = 'A'")
    for name in ("nation", "customer", "orders", "lineitem"):
        con.sql(f"COPY {name} TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
    want = con.sql(registry.oracle_sql()["inferred_absence"]).fetchall()
    df = registry.queries()["inferred_absence"](spark, str(tmp_path))
    got = df.collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == set(want) and df.columns == ["body", "member_id", "missed", "first_missed"]
    assert ("NATION_1", None) in {w[:2] for w in want} and None in {w[3] for w in want} and ("NATION_1", 1) not in {w[:2] for w in want}
    assert 0 < rows_made(df._jdf.queryExecution().executedPlan()) < 2 * len(votes) < sum(w[2] for w in want) / 2
