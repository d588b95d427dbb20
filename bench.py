"""Runs the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS] and prints one line of JSON."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent
HEADLINE = [
    "bm25_topk", "coverage_topk", "tf_cosine_topk", "embedding_cosine_topk", "idf_weights", "ngram_transitions", "symbol_energy", "exact_dedupe_first_wins",
    "normalized_dedupe", "reject_reasons", "hash_rank_sample", "item_containment", "reachability", "parent_chain", "history_budget", "cumulative_offsets",
    "coordinate_lookup", "byte_energy", "intent_kinds", "append_dedupe",
]


def main() -> None:
    sys.path.insert(0, str(ROOT))
    os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    from lexstrata import catalog

    queries, took = catalog.queries(), {}
    spark.read.parquet(f"{folder}/documents.parquet").count()  # the session's own start doesn't count
    from lexstrata.operators.index import index_of

    began = time.time()
    index_of(spark.read.parquet(f"{folder}/documents.parquet"))  # built once; every text query reads it
    took["index_build"] = round(time.time() - began, 3)
    for name in os.environ.get("BENCH_ONLY", ",".join(HEADLINE)).split(","):
        began = time.time()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": folder.rstrip("/").rpartition("sf")[2]}))
    spark.stop()


if __name__ == "__main__":
    main()
