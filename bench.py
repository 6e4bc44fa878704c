"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the tables (default sf0.1), ``BENCH_CPUS`` the cores and
``BENCH_QUERIES`` (comma separated) other queries. Every result is consumed in
full by the ``noop`` sink; training and scratch writes count towards the time.
"""

from __future__ import annotations

import json
import os
import time

from civitext import plans
from civitext.session import local_session

HEADLINE = [
    "label_distribution",
    "text_length_histogram",
    "text_length_median",
    "sample_per_class",
    "script_coverage",
    "normalise_text",
    "stratified_split",
    "carve_validation",
    "splits_roundtrip",
    "tokenise",
    "term_frequencies",
    "vocab_encode",
    "nb_train_harm",
    "select_best_candidate",
    "predict_harm",
    "predict_combined",
    "stream_score",
    "lr_train_score",
    "eval_class_report",
    "harm_train_evaluate",
    "attribute_tokens",
    "top_tokens",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES")
    spark = local_session(cpus, app="civitext-bench", shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    registered = plans.queries()
    registered["normalise_text"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm up
    times = {}
    for name in names.split(",") if names else HEADLINE:
        start = time.perf_counter()
        registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    total = round(sum(times.values()), 3)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": total,
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
