"""Times the headline queries and prints one JSON line."""

import importlib
import json
import os
import time

from pyspark.sql import SparkSession

QUERIES = [
    "playlist_rules", "tag_stats_all", "tag_cooccurrence", "tag_cooccurrence_matrix", "mood_pairs_loose", "mood_correlation", "segment_stats", "calib_apply", "calib_states",
    "files_with_tags", "files_in_folders", "states_head_coverage", "match_fuzzy", "vector_topk", "plays_top", "taste_weights", "pl_hidden_gems", "tags_merge_counts",
    "op1_length_histogram", "op2_toxicity", "op3_license_scan", "op4_line_dedup", "op5_ngram_join", "op6_bpe", "op7_reply_trees", "op8_host_rules", "op9_decontaminate", "op10_url_filter", "op11_vector_codes", "op12_simhash", "op13_divergence",
    "vector_ivf_stored", "vector_promoted", "scan_changes", "sync_changes", "calibrated_tags", "m3u_documents", "pool_trimmed_mean",
]


def main() -> None:
    at = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    known = importlib.import_module("__spark_entry__").queries()
    # the session's start is in no query's time
    spark.read.parquet(f"{at}/part.parquet").groupBy("p_brand").count().write.format("noop").mode("overwrite").save()
    took = {}
    for name in QUERIES:
        if name in known:
            began = time.time()
            known[name](spark, at).write.format("noop").mode("overwrite").save()
            took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(at.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
