"""Headline timings. Prints one JSON line; each query runs to a no-op sink.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default all), BENCH_RUNS
(default 3, the median counts after one warm-up run). Names of other queries, or of the
trial ``hot_vectors``, can be given as arguments.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from presswork.operators import dedup  # noqa: E402
from presswork.plans import registry  # noqa: E402

HEADLINE = [
    "latest_feed",
    "trending",
    "other_press",
    "recommend",
    "recommend_excluding_seen",
    "chunk_documents",
    "embed_chunks",
    "hourly_run",
    "ingest_rss_items",
    "insert_if_absent",
    "similar_pairs",
    "elect_duplicates",
    "retrieve_topk",
    "prompt_context",
    "chat_history_last_n",
    "upsert_prefs",
    "stream_ingest_dedup",
    "live_feed_batch",
]


def hot_vectors(spark: SparkSession, sf_dir: str, n: int = 200_000) -> DataFrame:
    """Election among many vectors: a third exact copies of one, a third near copies of it,
    half of all in one category. Vectors come from ``embeddings``, repeated with small turns."""
    base = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    known = base.count()
    rows = spark.range(n).withColumn("vec_id", F.col("id") % known)
    group = F.col("id") % 3
    first = base.filter("vec_id = 0").first()["embedding"]
    hot = F.array(*[F.lit(float(x)) for x in first])
    turned = F.transform(hot, lambda x, i: x + 0.02 * F.sin(F.col("id") * (i + 1)))
    vectors = rows.join(base.select("vec_id", "embedding"), "vec_id").select(
        F.col("id").alias("article_id"),
        F.when(F.col("id") % 2 == 0, F.lit(1)).otherwise(2 + F.col("id") % 3).cast("int").alias("category_id"),
        (1 + F.col("id") % 50).cast("int").alias("source_id"),
        F.timestamp_seconds(F.col("id") * 7919 % 2_592_000).cast("timestamp_ntz").alias("published_at"),
        F.when(group == 0, hot).when(group == 1, turned)
        .otherwise(F.transform("embedding", lambda x: x.cast("double")))
        .cast("array<float>").alias("vec"),
    )
    return dedup.elect_duplicates(vectors)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS") or str(os.cpu_count())
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("presswork-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries() | {"hot_vectors": hot_vectors}
    names = sys.argv[1:] or HEADLINE

    def run(name: str) -> float:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    times = {}
    for name in names:
        run(name)
        times[name] = round(statistics.median(run(name) for _ in range(runs)), 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, sum of medians",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
                "spark": spark.version,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
