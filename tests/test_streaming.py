"""Streams end with the rows of the batch plans."""

import shutil

from pyspark.sql import functions as F

from plenary.streaming import jobs

SRC = "/root/testdata/sf0.001/events.parquet"


def test_counts_equal_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    shutil.copy(SRC, tmp_path / "in" / "a.parquet")
    out = {}

    def keep(batch, number):
        out.update({r.user_id: r.views for r in batch.collect()})

    jobs.run_available(jobs.lifetime_counts(jobs.event_stream(spark, f"file://{tmp_path}/in")), f"file://{tmp_path}/c1", keep, "update")
    batch = spark.read.parquet(SRC).where("event_type = 'view'").groupBy("user_id").count()
    assert out == {r.user_id: r["count"] for r in batch.collect()}


def test_upsert_batches(spark, tmp_path):
    (tmp_path / "in").mkdir()
    e = spark.read.parquet(SRC)
    e.where("event_id < 500").coalesce(1).write.parquet(f"file://{tmp_path}/in/x1")
    e.where("event_id >= 400").coalesce(1).write.parquet(f"file://{tmp_path}/in/x2")
    write = jobs.upsert_batches(f"file://{tmp_path}/t", ["event_id"], ["event_id", "value"])
    jobs.run_available(jobs.event_stream(spark, f"file://{tmp_path}/in/*"), f"file://{tmp_path}/c2", write)
    last = max((tmp_path / "t").iterdir(), key=lambda p: int(p.name.split("=")[1]))
    got = spark.read.parquet(f"file://{last}")
    assert got.count() == e.count() == got.select("event_id").distinct().count()


def test_windows_and_sessions_run(spark, tmp_path):
    (tmp_path / "in").mkdir()
    shutil.copy(SRC, tmp_path / "in" / "a.parquet")
    for i, make in enumerate((jobs.trending_windows, jobs.sessions, jobs.deduplicated)):
        seen = []
        jobs.run_available(make(jobs.event_stream(spark, f"file://{tmp_path}/in")), f"file://{tmp_path}/w{i}", lambda b, n, seen=seen: seen.append(b.agg(F.count(F.lit(1))).first()[0]))
        assert seen
