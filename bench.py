"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from kgspark.session import local_session

HEADLINE = [
    "resolve_exact", "resolve_tiered", "semantic_match", "mentioned_in_topn", "entity_degree", "relationship_enrichment",
    "stats_by_predicate", "fixed_chunks", "sentence_chunks", "text_search_ilike", "cosine_topk", "trigram_search",
    "entity_scan", "page_clean_text", "content_hash_diff", "event_dedup", "event_poll", "crossref_upsert", "latest_bundle",
    "upsert_latest", "code_python_symbols", "canonical_hash",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cores=cpus, partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    from kgspark import plans

    spark.range(1000).selectExpr("sum(id)").collect()  # starts the executor threads before timing
    times = {}
    for name in HEADLINE:
        start = time.time()
        plans.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": cpus}), flush=True)


if __name__ == "__main__":
    main()
