"""Times the second run of the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from passageway.plans.registry import QUERIES
from passageway.session import local_session

HEADLINE = [
    "chunk_documents",
    "build_collection",
    "audit_collection",
    "term_stats",
    "encode_text",
    "exact_topk",
    "exact_topk_text",
    "ann_topk_prefix",
    "bm25_topk",
    "rrf_fuse",
    "sweep_k",
    "assemble_context",
    "extractive_answers",
    "illegal_citations",
    "enforce_whitelist",
    "majority",
    "confusion",
    "retrieval_hits",
    "answer_quality",
    "fingerprint",
    "training_mix",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")))
    names = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in names:
        # The first run compiles plans and starts workers; nothing is cached between the two.
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total wall time", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir)}))
    spark.stop()


if __name__ == "__main__":
    main()
