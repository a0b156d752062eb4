"""Time the named queries; prints one JSON line.

BENCH_SF_DIR (default sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (comma list or
``all``; default the headline queries below). Each query runs to the end into the
noop sink, once, after a few small queries that warm the session.
"""

from __future__ import annotations

import json
import os
import sys
import time

from procspark import build_session, plans

HEADLINE = """
trace_build trace_validity_prompt pair_validity_prompt next_activity_prompt dfg_prompt tree_prompt group_split
balanced_sample task_batches strip_truncate pack_blocks tag_align entity_f1 pad_batches perplexity_by_lang
dataset_union_metrics qa_windows qa_span_labels qa_nbest qa_metric layer_mean mrr_acc knn_vote bert_score_ranks
cka_2d clf_metrics
""".split()


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    wanted = list(plans.QUERIES) if chosen == "all" else [q for q in chosen.split(",") if q] or HEADLINE
    spark = build_session(f"local[{cpus}]", int(cpus), "bench", **{"spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    for warm in ("scored_tokens", "tag_align", "entity_f1", "head_logits"):
        run(plans.QUERIES[warm](spark, "/root/testdata/sf0.001"))
    times = {}
    for name in wanted:
        start = time.perf_counter()
        run(plans.QUERIES[name](spark, sf))
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total query time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf.rstrip("/")), "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
