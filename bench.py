"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the tables (default sf0.1), ``BENCH_CPUS`` the cores (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from orbivec.operators import ivf
from orbivec.operators import quantise as qz
from orbivec.operators.bm25 import bm25
from orbivec.operators.hybrid import hybrid
from orbivec.operators.knn import knn, radial
from orbivec.operators.metrics import query_recall
from orbivec.operators.truth import build_ground_truth
from orbivec.plans.table import VectorTable
from orbivec.session import materialise, scratch_path, ship
from orbivec.sources.synthetic import clustered_queries, clustered_vectors
from workload import QUERIES
from workload.registry import corpus, described, queries_of, table

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
SYNTHETIC, SYNTHETIC_DIMS, SYNTHETIC_QUERIES = 100_000, 128, 1_000


def session() -> SparkSession:
    spark = (SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
             .config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
             .config("spark.driver.memory", "16g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def run(df) -> int:
    """Compute every column of every row."""
    df.write.format("noop").mode("overwrite").save()
    return 0


def main() -> None:
    spark = session()
    times: dict[str, float] = {}
    facts: dict[str, float] = {}

    def timed(name, fn):
        start = time.time()
        out = fn()
        times[name] = round(time.time() - start, 3)
        return out

    rows = corpus(spark, SF_DIR)
    asked = queries_of(rows)
    n = rows.count()
    run(knn(rows, asked, 10))  # start the Python workers outside the measurements

    for space in ("l2", "innerproduct", "cosine"):
        timed(f"knn_{space}", lambda s=space: run(knn(rows, asked, 10, s)))
    facts["pairs_per_sec"] = round(n * n / times["knn_l2"])
    with_text = materialise(described(spark, SF_DIR), "described").repartition(int(CPUS))
    for mode in ("efficient", "post_filter"):
        timed(f"knn_{mode}", lambda m=mode: run(knn(with_text, asked, 10, where="age < 8", filter_mode=m)))
    timed("knn_nested", lambda: run(QUERIES["knn_nested"](spark, SF_DIR)))
    timed("radial", lambda: run(radial(rows, asked, "l2", max_distance=1.5)))
    timed("ground_truth_100", lambda: run(build_ground_truth(rows.withColumn("pos", F.col("_id")))))

    truth = materialise(knn(rows, asked, 10), "truth")
    centroids = timed("ivf_train", lambda: ivf.ivf_train(rows, 16))
    cells = timed("ivf_write", lambda: ivf.ivf_write(rows, centroids, scratch_path(spark, "cells")))
    for probes in (1, 4, 16):
        hits = timed(f"ivf_search_{probes}", lambda p=probes: materialise(ivf.ivf_search(cells, centroids, asked, 10, p), "hits"))
        facts[f"ivf_recall_{probes}"] = round(query_recall(hits, truth, 10).agg(F.avg("recall_k")).first()[0], 4)
    for encoder in ("fp16", "one_bit", "pq"):
        codec = timed(f"{encoder}_train", lambda e=encoder: qz.train_codec(rows, e, code_size=6))
        codes = materialise(qz.quantise(rows, codec), "codes")
        hits = timed(f"{encoder}_rescore", lambda: materialise(qz.rescored(codes, codec, rows, asked, 10, 5.0), "hits"))
        facts[f"{encoder}_recall"] = round(query_recall(hits, truth, 10).agg(F.avg("recall_k")).first()[0], 4)

    docs = table(spark, SF_DIR, "documents").select(F.col("doc_id").alias("_id"), "text")
    facts["bm25_pairs"] = docs.count() ** 2
    timed("bm25", lambda: run(bm25(docs, queries_of(docs), 10)))
    timed("hybrid", lambda: run(hybrid(with_text, queries_of(with_text), 10)))
    timed("run_metrics", lambda: run(QUERIES["run_metrics"](spark, SF_DIR)))
    timed("upsert", lambda: run(QUERIES["upsert"](spark, SF_DIR)))
    timed("vecs_roundtrip", lambda: run(QUERIES["vecs_roundtrip"](spark, SF_DIR)))

    # Scaling beyond the small table: ingest and search of synthetic vectors.
    made = VectorTable(spark, scratch_path(spark, "made"))

    def ingest():
        made.upsert(clustered_vectors(spark, SYNTHETIC, SYNTHETIC_DIMS))
        made.compact(shards=int(CPUS))

    timed("synthetic_ingest", ingest)
    facts["ingest_docs_per_sec"] = round(SYNTHETIC / times["synthetic_ingest"])
    questions = materialise(clustered_queries(spark, SYNTHETIC_QUERIES, SYNTHETIC_DIMS), "questions")
    timed("synthetic_knn", lambda: run(knn(made.read(), questions, 10)))
    facts["synthetic_pairs_per_sec"] = round(SYNTHETIC * SYNTHETIC_QUERIES / times["synthetic_knn"])
    facts["synthetic_queries_per_sec"] = round(SYNTHETIC_QUERIES / times["synthetic_knn"], 1)

    print(json.dumps({"metric": "total_time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "facts": facts, "sf": os.path.basename(SF_DIR.rstrip("/"))}))


if __name__ == "__main__":
    main()
