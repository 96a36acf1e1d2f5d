"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import re
import sys
import time

HEADLINE = [
    "bm25_search", "bm25_param_sweep", "hybrid_search", "rerank_pluggable", "cosine_topk", "keyword_snippets", "fixed_windows", "pack_chunks", "probe_containment", "retrieval_metrics",
    "three_source_merge", "conflict_resolve", "encode_literals", "six_dim_similarity", "range_join", "earliest_in_range", "dictionary_mentions", "shadow_elimination", "session_context", "latest_per_key_left_join", "route_questions",
]


def main() -> None:
    where, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from loomspark.plans import registry

    found, seconds = registry.queries(), {}
    spark.read.parquet(f"{where}/documents.parquet").selectExpr("sum(length(text))").collect()  # starts the session
    spark.range(0, 1000, 1, int(cpus)).mapInArrow(lambda batches: batches, "id bigint").write.format("noop").mode("overwrite").save()  # and Python workers
    for name in sys.argv[1:] or HEADLINE:
        began = time.perf_counter()
        found[name](spark, where).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    sf = re.search(r"sf([\d.]+)", where)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": float(sf[1]) if sf else None}))


if __name__ == "__main__":
    main()
