"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "vote_attributes", "member_vote_stats", "pairwise_alignment", "swing_votes", "body_analytics", "alignment_matrix", "filtered_meetings", "current_membership",
    "entity_directory", "entity_top_per_kind", "graph_accounting", "similar_names", "search_documents", "token_index", "attachment_cascade", "table_diff",
    "event_attribution", "event_runs", "stratified_sample", "embedding_screen",
)


def main() -> None:
    from pyspark.sql import SparkSession

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from plenary import registry

    queries, times = registry.queries(), {}
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()  # start-up isn't any query's
    for name in HEADLINE:
        began = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
