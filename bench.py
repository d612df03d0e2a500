"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the number of cores.
Each query runs to the end (all columns are produced, nothing is kept).  The
derived traffic tables are stored once, which is timed as ``prepare``.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from beckon.plans import traffic  # noqa: E402
from beckon.plans.queries import QUERIES  # noqa: E402
from beckon.session import local_session  # noqa: E402

HEADLINE = [
    "document_text_features", "message_text_features", "rule_cascade", "sender_trust",
    "user_engagement", "business_relation", "similar_dismissals", "tfidf_vocabulary",
    "tfidf_weights", "evidence_topk", "message_type", "verified_output", "consistency",
    "class_report", "stratified_split", "feature_matrix", "route_messages",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = local_session("bench", cores, int(cores))
    start = time.perf_counter()
    traffic.tables(spark, sf_dir)
    prepare = time.perf_counter() - start
    names = [n for n in sys.argv[1:] if n in QUERIES] or HEADLINE
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_seconds_with_prepare", "value": round(sum(seconds.values()) + prepare, 3),
        "unit": "sec", "queries": seconds, "prepare": round(prepare, 3), "sf": sf_dir,
        "cores": int(cores)}))


if __name__ == "__main__":
    main()
