"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "tally_vader",
    "vader_scores",
    "run_emoji",
    "tally_nlp",
    "emoji_to_alias",
    "flag_emoji",
    "flatten_status",
    "track_topics",
    "hashtags",
    "load_lexicon",
    "split_emoji_aware",
    "tag_vader",
    "evaluate_splits",
    "train_bayes",
    "train_forest",
    "train_gbt",
    "upsert_rows",
    "latest_by",
    "run_registry",
    "run_report",
    "topic_counts",
    "stream_score",
    "stream_tally",
]


def main() -> None:
    from tonewise import workload
    from tonewise.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session(
        "bench",
        master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "12g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    workload.load_all()
    names = sys.argv[1:] or HEADLINE

    def run(name: str, directory: str) -> float:
        started = time.perf_counter()
        workload.QUERIES[name](spark, directory).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - started

    # Each query first runs twice over the smallest tables, uncounted, so that the JVM has compiled it.
    warm = Path(sf_dir).parent / "sf0.001"
    timings = {}
    for name in names:
        for _ in range(2 if warm.exists() else 0):
            run(name, str(warm))
        timings[name] = round(run(name, sf_dir), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": Path(sf_dir).name.removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
