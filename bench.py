"""Times the headline queries and prints one JSON line.

    BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (comma-separated)
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

HEADLINE = [
    "resume_details", "text_clean", "relevant_text_resume", "page_assemble", "html_text", "chunks_resume",
    "dedup_keep_first", "stratified_split", "tfidf", "tfidf_cosine", "keyterms_tfidf", "keyterms_yake", "jaccard_pairs",
    "hashed_vectors", "score_matrix", "best_role", "retrieve_topk_role", "self_similarity",
    "class_report", "screen_result", "prompts_fit", "retrieve_by_cells", "word_vectors", "svm_predict",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")

    from matchloom.plans import all_queries
    from matchloom.session import local_session

    spark = local_session(cores=cpus)
    queries = all_queries()
    # One cheap pass starts the JVM's and Python's machinery, which is not what is measured.
    queries["top1_accuracy"](spark, sf_dir).collect()
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    match = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "total wall-clock of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": float(match.group(1)) if match else None,
    }))


if __name__ == "__main__":
    main()
