"""Benchmark of the headline jobs.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query is executed to completion through the ``noop`` sink (no driver
collect). Before timing, every headline job runs once, untimed, on the
smallest fixture (BENCH_WARM_DIR, default sf0.001): this pays one-time costs
(JIT, expression code generation, Python worker start-up) so that the timed
run at BENCH_SF_DIR measures the jobs themselves. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quarry.plans.queries import QUERIES  # noqa: E402
from quarry.session import build_session  # noqa: E402

HEADLINE = [
    "d1_recall_at_k",        # flagship: binary k-NN + rerank + recall@k over the vector table
    "c2_dense_knn",          # exact inner-product k-NN, every vector against the table
    "c3_hamming_knn",        # exact Hamming k-NN on packed codes
    "j2_encode_passages",    # batch passage encoding
    "p3_text_recall",        # text retrieval evaluation with answer matching
    "d5_answer_accuracy",    # reader evaluation (reader set -> spans -> exact match)
    "p6_batch_qa",           # batch question answering
    "i1_multi_key_batches",  # weighted multi-key batch sampler
    "p7_biencoder_pairs",    # bi-encoder training-pair table
    "p9_biencoder_eval",     # in-batch ranks and losses
    "c5_corpus_answer_search",  # every passage containing every answer (inverted postings)
    "k1_question_stream",    # streaming QA over micro-batches
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(warm_dir):
        warm_dir = sf_dir
    for name in HEADLINE:
        if name in QUERIES:
            QUERIES[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        if name not in QUERIES:
            continue
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(f"# {name}: {times[name]}s", file=sys.stderr, flush=True)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir,
                      "cpus": int(cpus), "warmup": f"one untimed pass over {warm_dir}"}))
    spark.stop()


if __name__ == "__main__":
    main()
