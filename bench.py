"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from vitalforms.plans.catalogue import QUERIES  # noqa: E402
from vitalforms.session import build_session  # noqa: E402

HEADLINE = (
    "records_list", "records_search", "dashboard_counts", "pivot_fields", "upsert_corrections",
    "form_render_birth", "form_extract_102", "form_extract_97", "digitize", "stored_fields",
    "licence_pairs", "keyword_classify", "pattern_search", "combined_evaluation", "char_error_rate",
    "char_confusion", "label_rollup", "accuracy_by_form", "sequence_text", "running_mean",
    "early_stopping", "word_regions", "span_offsets", "span_corpus", "span_locate",
    "split_stratified", "shuffled_cut", "mnb_predict", "stream_window",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("vitalforms-bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus,
                          spark__driver__memory="16g", spark__ui__enabled="false",
                          spark__ui__showConsoleProgress="false",
                          spark__python__sql__dataFrameDebugging__enabled="false",
                          spark__vitalforms__read__partitions=cpus)  # tables of one row group would keep one core busy
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the workers before the clock
    times = {}
    for name in HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
    orders = spark.read.parquet(f"{folder}/orders.parquet").count()
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(folder.rstrip("/")),
        "digitize_docs_per_sec": round(orders / times["digitize"], 1),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
