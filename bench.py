"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the number of cores.  Each
query runs twice into a no-op sink and the faster run counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from catalog.queries import QUERIES, TEXT_PARTITIONS  # noqa: E402
from tidemark.session import build_session  # noqa: E402

HEADLINE = [
    "tokens", "clean_text_regex", "word_count", "word_shares", "top_words", "top_words_all", "share_hist2d",
    "affect_wide", "emotion_scores", "mann_whitney", "tfidf_avg", "tfidf_top_terms",
    "distinct_authors", "first_seen", "new_users_per_day", "sample_n", "sample_frac_per_group",
    "posts_of_authors", "companion_first_match", "cut_by_time", "cut_by_position", "cut_by_priority",
    "author_text", "author_last_tokens", "class_metrics", "batch_metrics", "roc_auc", "accuracy_pct",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", cpus, spark_ui_enabled="false", spark_driver_memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    # Each test table is one file of one row group, which no reader can split.
    spark.conf.set(TEXT_PARTITIONS, str(cpus))
    seconds = {}
    for name in names:
        runs = []
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(min(runs), 3)
    spark.stop()
    total = round(sum(seconds.values()), 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": scale}))


if __name__ == "__main__":
    main()
