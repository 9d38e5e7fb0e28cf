"""Headline queries, timed: prints one JSON line.

Each query is run once to warm the JVM and once for the time, and is written to
a sink that takes every row.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from factloom.catalog import all_queries  # noqa: E402
from factloom.session import build_session  # noqa: E402

HEADLINES = [
    "f01_current_version", "f07_total_positive", "f10_fy_detail", "q06_top_evidence", "q10_screen_results",
    "x01_extract_claims", "x06_ground_document_quotes", "x18_map_claim_objects", "d05_segment_pages",
    "k05_temporal_conflicts", "k07_denial_overlap", "g12_relation_paths", "g14_subgraph_nodes",
    "g22_taxonomy_closure", "p03_verify_chain", "s07_land_raw", "n16_merge_observations", "v02_fold_states",
    "r01_verified_relevance", "t01_company_list",
    "g16_supply_neighbors", "g23_taxonomy_violations", "q11_explain_relation", "m01_stream_land_in_batches",
    "m05_enforce_states", "k06_incoming_conflicts", "n19_business_segments", "n20_holdings", "f14_revenue_evidence",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", int(cpus))
    times: dict[str, float] = {}
    for name in HEADLINES:
        for _ in range(2):
            start = time.time()
            all_queries()[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
