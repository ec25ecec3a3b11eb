"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
the data and the cores. Each query runs once to warm up, then BENCH_RUNS
(default 1) times into the ``noop`` sink; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from checks.queries import QUERIES
from checks.session import session

HEADLINE = (
    "normalize_text",
    "repair_mojibake",
    "split_sentences",
    "top_answers",
    "text_to_questions_template",
    "normalize_qa",
    "flatten_qas",
    "corpus_bleu",
    "rouge_n",
    "rouge_l_documents",
    "meteor_exact",
    "embedding_match_f1",
    "compute_text_metrics",
    "run_summary",
    "early_stopping",
    "pad_batches",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = session(int(os.environ.get("BENCH_CPUS", "8")))
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        times = []
        for _ in range(runs + 1):
            started = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - started)
        seconds[name] = round(statistics.median(times[1:]), 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
