"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one warm-up, then the median of three.

Prints one JSON line. Every query is drained completely through the no-op sink.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quizlake.plans.queries import registered  # noqa: E402
from quizlake.session import local_session  # noqa: E402

HEADLINE = [
    "scored_attempts",
    "progress_summary",
    "graded_answers",
    "review_lines",
    "performance_trend",
    "latest_quizzes_per_module",
    "question_numbers",
    "quiz_documents",
    "notes_assembled",
    "note_fingerprints",
    "note_previews",
    "prompts",
    "identity_resolution",
    "module_upsert",
    "answers_replace",
    "fk_audit",
    "response_status",
    "first_valid_attempt",
    "curated_questions",
    "saved_questions",
]
RUNS = 3


def drain(frame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    queries = registered()
    seconds = {}
    for name in names:
        times = []
        for _ in range(1 + RUNS):
            started = time.perf_counter()
            drain(queries[name](spark, folder))
            times.append(time.perf_counter() - started)
        seconds[name] = round(statistics.median(times[1:]), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
