"""Every query with oracle SQL gives the same rows as DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from plenary import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    return value


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((repr([plain(r[i]) for i in order]) for r in values))


def same(a, b):
    return repr(a).replace(".0,", ",").replace(".0]", "]") == repr(b).replace(".0,", ",").replace(".0]", "]")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, duck, name):
    got = registry.queries()[name](spark, DIR)
    want = duck.sql(registry.oracle_sql()[name])
    assert same(rows(got.columns, [tuple(r) for r in got.collect()]), rows(want.columns, want.fetchall()))


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    assert registry.queries()[name](spark, DIR).count() >= 0


def test_search_against_brute_force(spark):
    import re

    from plenary.plans.text import parse_query, search_documents

    assert parse_query('a "b c" -d "e') == [(False, ["a"]), (False, ["b", "c"]), (True, ["d"]), (False, ["e"])]
    got = {r.doc_id: r["rank"] for r in search_documents(spark, DIR).collect()}
    want = {}
    for d, text, source in duckdb.sql(f"select doc_id, text, source from '{DIR}/documents.parquet'").fetchall():
        whole = f"{source} \n {text}"
        tests = [re.search(p, whole, re.A | re.I) for p in (r"\bthe", r"\bof\w*\W+the", r"\bles")]
        if tests[0] and tests[1] and not tests[2]:
            r = sum(w * len(re.findall(p, f, re.A | re.I)) for f, w in ((source, 1.0), (text, 0.4)) for p in (r"\bthe", r"\bof\w*\W+the"))
            want[d] = round(r / (r + 1), 6)
    top = sorted(want.items(), key=lambda x: (-x[1], x[0]))[:50]
    assert got == dict(top)
