"""Seconds per headline query over $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from promptmill.queries import QUERIES
from promptmill.session import build_session, release

HEADLINE = ["class_counts", "plan_quotas", "token_stats", "top_ngrams", "ngram_jaccard", "msttr", "score_moments", "kde",
            "ks_two_sample", "js_distance", "synthesis_table", "content_profile", "text_column_stats", "version_comparison",
            "group_profile", "gini", "combine", "dedup_exact_normalised", "dedup_near", "near_duplicate_clusters",
            "topic_keywords", "mean_pairwise_cosine", "language_profiles", "language_detection", "score_inference", "balanced_metrics",
            "balanced_rows", "shared_token_pairs", "neighbour_graph", "density_clusters"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8,
                          spark__driver__memory="16g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    # One small query first, so that the start of the JVM and of the Python workers is not measured.
    QUERIES["class_counts"](spark, folder).collect()
    seconds = {}
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        release()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).replace("sf", "")}))
    spark.stop()


if __name__ == "__main__":
    main()
