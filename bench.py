"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the folder of tables (default sf0.1), BENCH_CPUS the number of cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from answerproof.plans.queries import QUERIES  # noqa: E402
from answerproof.session import local_session  # noqa: E402

HEADLINE = (
    "rate_by_template",
    "label_pairs",
    "flag_pairs",
    "label_responses",
    "label_with_scores",
    "canonical_documents",
    "rate_grouping_sets",
    "coverage",
    "length_correlation",
    "rate_by_keyword",
    "tfidf_documents",
    "normalize_prompts",
    "balanced_audit_sample",
    "weighted_confusion",
    "kappa_multiclass",
    "bootstrap_rate_ci",
    "cluster_bootstrap_fpr",
    "resize_up",
    "harvest_questions",
    "majority_vote",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 1))
    spark = local_session(cores, **{"spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/orders.parquet").groupBy("o_orderpriority").count().collect()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    rows = spark.read.parquet(f"{folder}/orders.parquet").count()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "qa_rows": rows,
                "label_rows_per_sec": round(rows / seconds["label_pairs"]),
                "cpus": cores,
            }
        ),
        flush=True,
    )


if __name__ == "__main__":
    main()
