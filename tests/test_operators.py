"""Operators on small hand-made frames: ties, nulls, empties."""

import pytest
from pyspark.sql import functions as F

from plenary.functions import text as T
from plenary.operators import events, relational, replication, resolution
from plenary.plans import votes
from plenary.sources import connectors


def test_votes_ties_and_abstentions(spark):
    v = spark.createDataFrame([(1, 1, "yes"), (1, 2, "no"), (2, 1, "abstain"), (3, 1, "yes"), (3, 2, "yes"), (3, 3, "no"), (4, 1, None)], "motion_id long, member_id long, vote string")
    got = {r.motion_id: r for r in votes.attributes(v).collect()}
    assert (got[1].majority, got[1].is_split, got[1].dissents) == ("tie", True, 0)
    assert (got[2].majority, got[2].is_unanimous) == (None, None)
    assert (got[3].majority, got[3].dissents, got[3].margin) == ("yes", 1, 1)
    assert (got[4].total, got[4].yes) == (1, 0)


def test_or_join_gives_a_pair_once(spark):
    left = spark.createDataFrame([(1, 10, "a"), (2, None, "b"), (3, 99, "z")], "lid long, k long, c string")
    right = spark.createDataFrame([(10, 10, "a"), (11, 11, "b")], "rid long, rk long, rc string")
    got = sorted((r.lid, r.rid) for r in relational.or_join(left, right, "lid", [("k", "rk"), ("c", "rc")], "rid").collect() if r.rid) 
    assert got == [(1, 10), (2, 11)]
    assert relational.or_join(left, right, "lid", [("k", "rk"), ("c", "rc")], "rid").count() == 3


def test_span_join(spark):
    points = spark.createDataFrame([("d", 5), ("d", 10), ("d", 25), ("e", 1)], "k string, at int")
    starts = spark.createDataFrame([("d", 6, 1), ("d", 20, 2)], "k string, s int, item int")
    got = {(r.k, r.at): r.span_item for r in relational.span_join(points, starts, "k", "at", "s", "item").collect()}
    assert got == {("d", 5): None, ("d", 10): 1, ("d", 25): 2, ("e", 1): None}


def test_page_and_truncated(spark):
    df = spark.range(7)
    assert [(r.id, r.total_count, r.total_pages) for r in relational.page(df, ["id"], 2, 3).collect()] == [(3, 7, 3), (4, 7, 3), (5, 7, 3)]
    assert {r.has_more for r in relational.truncated(df, ["id"], 3).collect()} == {True}
    assert {r.has_more for r in relational.truncated(df, ["id"], 7).collect()} == {False}


def test_null_safe_anti(spark):
    a = spark.createDataFrame([(1, None), (2, "x")], "i int, k string")
    b = spark.createDataFrame([(1, None)], "i int, k string")
    assert [r.i for r in relational.null_safe_anti(a, b, ["i", "k"]).collect()] == [2]


def test_components_and_merge(spark):
    nodes = spark.range(8)
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (6, 7)], "a long, b long")
    label = resolution.components(edges, nodes)
    assert {r.id: r.component for r in label.collect()} == {0: 0, 1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 6, 7: 6}
    e = nodes.withColumn("mentions", F.col("id"))
    s = resolution.survivors(e, label, "mentions")
    assert {r.id: r.survivor for r in s.collect()}[1] == 4
    moved = resolution.repointed(edges, s, ["a", "b"])
    assert moved.count() == 0


@pytest.mark.parametrize(
    "text, want",
    [("Item was approved as amended", "approved_as_amended"), ("Approved", "approved"), ("pull", "unknown"), ("pulled from agenda", "pulled"), ("Presentation only; approved", "informational"), (None, "unknown")],
)
def test_lifecycle(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(T.lifecycle(F.col("t"))).first()[0] == want


def test_scalars(spark):
    df = spark.createDataFrame([("Mayor  John O'Neil, Chair", "Smith & Co-Op, LLC", "01.02.a", "C-12-345-0A", "3/4/2024")], "p string, o string, n string, c string, d string")
    r = df.select(T.person_name("p"), T.org_name(F.col("o")), T.item_number(F.col("n")), T.item_parent(F.col("n")), T.case_base(F.col("c")), T.iso_date(F.col("d"))).first()
    assert tuple(r) == ("john o'neil", "smith and coop", None, "01.02", "C-12-345", "2024-03-04")


def test_events_offsets_are_code_points(spark):
    df = spark.createDataFrame([(1, "😀 Motion approved in case Z-123."), (2, "It could be approved."), (3, None)], "id long, t string")
    got = events.extract_events(df, "id", "t").collect()
    assert [(r.id, r.start, r.end, r.outcome, r.case_number) for r in got] == [(1, 9, 17, "approved", "Z-123")]


def test_upsert_and_diff(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    s = spark.createDataFrame([(2, "c"), (3, None)], "k int, v string")
    assert sorted((r.k, r.v) for r in replication.upsert(t, s, ["k"]).collect() if r.v) == [(1, "a"), (2, "c")]
    assert sorted((r.k, r.action) for r in replication.reconcile(t, s, "k").collect()) == [(1, "delete"), (3, "insert")]
    assert replication.multiset_diff(t, t, ["k", "v"]).count() == 0


def test_read_only_guard():
    assert connectors.read_only("SELECT 1; -- drop\nWITH a AS (SELECT 2) SELECT * FROM a") == ["SELECT 1", "WITH a AS (SELECT 2) SELECT * FROM a"]
    for bad in ("DROP TABLE x", "SELECT 1; DELETE FROM t", "/* SELECT */ INSERT INTO t VALUES (1)", "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a"):
        with pytest.raises(ValueError):
            connectors.read_only(bad)
    assert connectors.read_only("SELECT 'drop table; x' AS s") == ["SELECT 'drop table; x' AS s"]


def test_csv_append_skips_known_keys(spark, tmp_path):
    path = f"file://{tmp_path}/items"
    new = spark.createDataFrame([("1", "a"), ("1", "again"), ("2", "b")], "id string, v string")
    assert connectors.append_new_csv(new, path, ["id"]) == 2
    assert connectors.append_new_csv(spark.createDataFrame([("2", "x"), ("3", "c")], "id string, v string"), path, ["id"]) == 1
    assert sorted(r.id for r in connectors.read_csv(spark, path).collect()) == ["1", "2", "3"]


def test_html_tables(spark):
    df = spark.createDataFrame([(1, "<table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>x <b>y</b> &amp; z</td></tr></table>"), (2, None)], "id long, html string")
    got = [(r.id, r.table, r.row, r.cells) for r in connectors.html_rows(df, "id", "html").collect()]
    assert got == [(1, 0, 0, ["A", "B"]), (1, 0, 1, ["1", "x y & z"])]


def test_immutable_artifact(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "a int")
    where = connectors.write_artifact(df, f"file://{tmp_path}/art")
    assert connectors.write_artifact(df, f"file://{tmp_path}/art") == where
    assert spark.read.parquet(where).count() == 1
