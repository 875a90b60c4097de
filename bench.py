"""Time the headline queries and print one JSON line.

Each query is written to a sink that drops its rows, so all of them are computed, and is run twice in a row: ``queries``
and ``value`` are the second runs, ``first_runs`` and ``first_total`` the first ones, which also pay for compiled code that
no query before has used. BENCH_SF_DIR names the tables, BENCH_CPUS the cores. Names given as arguments replace the
headline list; ``all`` stands for every query.
"""

from __future__ import annotations

import json
import os
import sys
import time

from retrievo import plans
from retrievo.session import build_session

HEADLINE = """bm25_topk bm25_topk_indexed vector_topk hybrid_search hybrid_over_candidates ann_topk result_cache_hits
adaptive_rag adaptive_rag_hybrid eval_report profile_comparison token_stats chunk_documents doc_format mixed_blocks ingest_status qa_extract
parse_generated session_context semantic_cache_lookup rate_5m timer_percentiles sustained_alerts rate_limit_replay
token_budget_replay run_stop_reasons guarded_join_agg guarded_window""".split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    known = plans.queries()
    names = sys.argv[1:] or HEADLINE
    names = list(known) if names == ["all"] else names
    spark = build_session("bench", cores=cpus, shuffle_partitions=cpus)
    # start the executor threads and Python workers; no query is run before it is timed
    spark.range(0, 1000, 1, cpus).mapInArrow(lambda batches: batches, "id long").selectExpr("sum(id)").collect()
    first, took = {}, {}
    for name in names:
        for runs in (first, took):
            start = time.perf_counter()
            known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {first[name]} {took[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec",
                      "queries": took, "first_runs": first, "first_total": round(sum(first.values()), 3),
                      "sf": os.path.basename(sf_dir), "cpus": cpus}))


if __name__ == "__main__":
    main()
