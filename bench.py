"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from tamis.functions.sizing import optimal_bits
from tamis.plans import catalog
from tamis.plans.queries import QUERIES
from tamis.sources import keys as source

HEADLINE = (
    "semi_join_bloom12", "anti_join", "inner_join", "bloom_words_classic12", "bloom_words_block32", "bloom_false_positives_block32", "counting_counters_counting", "counting_read_counting",
    "cqf_build", "cqf_merge", "cqf_inner_product", "gcs_build", "prefix_first_level", "semi_join_alg0", "semi_join_alg12", "semi_join_alg116", "semi_join_alg1086", "semi_join_alg3086",
    "static_function", "hash_murmur64", "sort_baseline",
)


#: Algorithms with published figures, measured over so many generated keys.
FILTERS, FILTER_KEYS = (0, 2, 3, 4, 10, 11, 12, 13, 20, 30, 40, 41, 42, 50, 51, 53, 54, 116, 118), 300_000


def filters(spark: SparkSession) -> dict:
    """Rate, bits a key, and nanoseconds a key for adding and finding (wall-clock, all cores)."""
    present, absent = source.random_keys(spark, FILTER_KEYS, seed=1).persist(), source.random_keys(spark, FILTER_KEYS, 1 << 40, seed=1).persist()
    present.count(), absent.count()
    out = {}
    for i in FILTERS:
        began = time.perf_counter()
        f = catalog.ALGORITHMS[i].build(present, "key", FILTER_KEYS)
        f.rows = f.rows.persist()
        f.rows.count()
        built = time.perf_counter()
        rate = f.semi_join(absent, "key").count() / FILTER_KEYS
        probed = time.perf_counter()
        if f.semi_join(present, "key").count() != FILTER_KEYS:
            raise AssertionError(f"{catalog.ALGORITHMS[i].name} lost keys")
        bits = f.bits_per_item
        out[catalog.ALGORITHMS[i].name] = {"rate_percent": round(100 * rate, 4), "bits_per_item": round(bits, 2), "wasted_percent": round(100 * (bits / optimal_bits(rate) - 1), 1) if rate else None, "ns_per_add": round((built - began) / FILTER_KEYS * 1e9, 1), "ns_per_find": round((probed - built) / FILTER_KEYS * 1e9, 1)}
        f.rows.unpersist()
    return out


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["semi_join_bloom12"](spark, sf_dir).collect()  # warm-up
    took = {}
    for name in HEADLINE:
        runs = []
        for _ in range(2):
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        took[name] = round(min(runs), 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "filters": filters(spark)}))
    spark.stop()


if __name__ == "__main__":
    main()
