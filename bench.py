"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints ONE JSON line:
{"metric": "total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}
Each query is forced with a no-op write (full execution, nothing collected),
except the routing plans, whose result is the one-row score table; their
test-split scores are reported under "quality" (the reference publishes only
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from bugroute.plans.catalog import CATALOG  # noqa: E402
from bugroute.plans.routing import route_and_score, route_light  # noqa: E402
from bugroute.session import local_session  # noqa: E402

HEADLINE = [
    "bugs_table", "one_hot", "index_classes", "split_positional", "batches",
    "metrics_preds", "per_class", "sentences", "words", "tokens", "word_groups_cnn",
    "build_vocab", "doc_vectors_rnn", "doc_vectors_cnn", "losses", "loss_totals",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=max(8, 2 * int(cpus) if cpus.isdigit() else 16),
                          app="bugroute-bench")
    # warm-up: JVM, parquet footers
    run(CATALOG["n_classes"][0](spark, sf_dir))
    times: dict[str, float] = {}
    for name in HEADLINE:
        t = time.time()
        run(CATALOG[name][0](spark, sf_dir))
        times[name] = round(time.time() - t, 3)
    quality: dict[str, dict] = {}
    # the router with loaded vectors: what is timed is features, fit and scores
    loaded = lambda spark, sf: route_and_score(spark, sf, trained=False)
    for name, fn in (("route_text_softmax", loaded), ("route_light_softmax", route_light)):
        t = time.time()
        row = fn(spark, sf_dir).first()
        times[name] = round(time.time() - t, 3)
        quality[name] = {k: round(float(row[k]), 4) for k in
                         ("accuracy", "precision", "recall", "f1", "wprecision", "wrecall", "wf1")}
        quality[name]["n_test"] = int(row["n"])
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir,
                      "quality": quality}))


if __name__ == "__main__":
    main()
