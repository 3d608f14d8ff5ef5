"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from digestry.session import local_session  # noqa: E402
import sample_queries  # noqa: E402

HEADLINE = ("ingest_flatten", "feed_entries", "keyword_topk", "classify_domain", "quality_score", "ranked_items",
            "dedup_titles", "capped_topk", "funnel_counts", "curate", "source_weights", "feedback_from_log",
            "stream_weights", "briefing_doc", "card_elements", "ranked_large", "curate_large", "emerging_terms")


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, 8, "digestry-bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1_000_000).selectExpr("sum(id)").collect()  # start the executor threads
    seconds = {}
    for name in names:
        best = None
        for _ in range(2):
            start = time.perf_counter()
            sample_queries.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        seconds[name] = round(best, 3)
    print(json.dumps({"metric": "total seconds of the headline queries, best of two runs each",
                      "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                      "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
