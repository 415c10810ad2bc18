"""Time the headline queries on one machine; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) set the data and
the cores. Every query runs into the ``noop`` sink, so all of its rows are computed.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from utterscale.plans import catalog  # noqa: E402

HEADLINE = [
    "wer_by_lang", "cer_corpus", "bleu_corpus", "bleu_two_refs", "chrf_corpus", "eval_report", "ter_corpus",
    "char_vocab", "encode_labels", "ctc_greedy", "normalize_text", "numbers_to_words", "parse_annotations",
    "seeded_shuffle", "seeded_sample_per_group", "length_batches", "pad_inputs", "best_so_far", "validate_props",
    "align_edit_counts", "stream_event_counts",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cores}]").appName("utterscale-bench")
             .config("spark.sql.shuffle.partitions", cores)
             .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": float(scale) if scale.replace(".", "").isdigit() else scale}))
    spark.stop()


if __name__ == "__main__":
    main()
