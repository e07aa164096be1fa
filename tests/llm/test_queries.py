"""Registered queries on the smallest tables, and the pipeline against its stages' brute force."""

import duckdb
import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402
from plenary.llm import queries  # noqa: E402

DIR = "/root/testdata/sf0.001"


def test_exact_dedup_oracle(spark):
    got = sorted(map(tuple, queries.queries()["op2_exact_dedup"](spark, DIR).collect()))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{DIR}/documents.parquet'")
    want = con.sql(queries.oracle_sql()["op2_exact_dedup"])
    order = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert got == sorted(tuple(r[want.columns.index(c)] for c in order) for r in want.fetchall())


def test_ten_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))


@pytest.mark.parametrize("name", ["op4_quality_classifier", "op6_toxicity", "op7_language_id", "op9_pii", "op10_bpe_codec"])
def test_one_row_per_document(spark, name):
    assert queries.queries()[name](spark, DIR).select("doc_id").distinct().count() == spark.read.parquet(f"{DIR}/documents.parquet").count()


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    packed = corpus_pipeline.run(spark, DIR)
    kept = {r.doc_id for r in packed.select("doc_id").distinct().collect()}
    assert 0.6 * docs.count() < len(kept) < docs.count()
    # no two that stayed are equal but for white space
    texts = {r.doc_id: "".join((r.text or "").split()) for r in docs.collect() if r.doc_id in kept}
    assert len(set(texts.values())) == len(texts)
