"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query is built and run to its last row: once to warm up, then up to
three times, of which the median counts (plan building included).  A query is
not repeated once it has used its share of time.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from narrprep.plans.queries import QUERIES
from narrprep.session import local_session

HEADLINE = [
    "detect_language",
    "clean_text",
    "rules_apply",
    "html_text",
    "chapter_spans",
    "book_chapters",
    "merge_short",
    "narration_summary",
    "timeline",
    "chapter_markers",
    "pending_chunks",
    "latest_state",
    "progress_changes",
    "jobs_page",
]
RUNS = 3
SHARE = 8.0


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in HEADLINE:
        run(name)
        taken = []
        while len(taken) < RUNS and sum(taken) < SHARE:
            taken.append(run(name))
        seconds[name] = round(statistics.median(taken), 3)
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("count(*)", "sum(length(text))").first()
    per_second = {
        name: {"docs": round(docs[0] / seconds[name]), "chars": round(docs[1] / seconds[name])}
        for name in ("detect_language", "clean_text", "chapter_spans", "merge_short", "narration_summary")
    }
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "sum of median query times",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
                "documents_per_second": per_second,
            }
        )
    )


if __name__ == "__main__":
    main()
