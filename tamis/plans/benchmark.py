"""What the benchmark measures: rates, sizes, scores, sweeps."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.functions import sizing as S
from tamis.operators import kernels as K
from tamis.operators import sharded
from tamis.plans import catalog
from tamis.sources import keys as source


def match_size(a: DataFrame, b: DataFrame, key: str = "key") -> DataFrame:
    """One row: rows of ``a`` with a key in ``b``, repeats included."""
    return a.join(b.select(key).distinct(), key, "left_semi").agg(F.count("*").alias("match_size"))


def count_distinct(a: DataFrame, key: str = "key") -> DataFrame:
    return a.agg(F.countDistinct(key).alias("count_distinct"))


def has_duplicates(a: DataFrame, key: str = "key") -> DataFrame:
    return a.groupBy(key).count().agg(F.coalesce(F.max(F.col("count") > 1), F.lit(False)).alias("has_duplicates"))


def false_positive_rate(f: catalog.Filter, probes: DataFrame, present: DataFrame, key: str = "key") -> DataFrame:
    """One row: negatives, of which found, and their share. Probes that are present do not count."""
    absent = probes.join(present.select(key).distinct(), key, "left_anti")
    return f.might_contain(absent, key).agg(F.count("*").alias("negatives"), F.coalesce(F.sum(F.col("maybe").cast("long")), F.lit(0)).alias("found")).withColumn("rate", F.col("found") / F.col("negatives"))


def false_negatives(f: catalog.Filter, present: DataFrame, key: str = "key") -> DataFrame:
    """One row: added keys that are not found; 0 for a right filter."""
    return f.might_contain(present, key).agg(F.coalesce(F.sum((~F.col("maybe")).cast("long")), F.lit(0)).alias("false_negatives"))


REPORT = (
    "id int, name string, n long, nanos_per_add double, nanos_per_remove double, nanos_per_find map<int,double>, rate double, bits_per_item double, optimal_bits double, wasted_percent double, add_and_3_find double"
)


def measure(algorithm: catalog.Algorithm, to_add: DataFrame, absent: DataFrame, sample_size: int, seed: int = 0) -> tuple:
    """A report row of one algorithm; times are wall-clock, over all cores."""
    n = to_add.count()
    began = time.perf_counter_ns()
    f = algorithm.build(to_add, "key", n, seed)
    f.rows = f.rows.persist()
    f.rows.count()
    add, finds, rate = (time.perf_counter_ns() - began) / max(n, 1), {}, float("nan")
    try:
        for percent in (0, 25, 50, 75, 100):
            probes = source.mix(to_add, absent, sample_size, percent, seed).persist()
            total, present = probes.count(), probes.join(to_add, "key", "left_semi").count()
            began = time.perf_counter_ns()
            found = f.might_contain(probes, "key").where("maybe").count()
            finds[percent] = (time.perf_counter_ns() - began) / max(total, 1)
            probes.unpersist()
            if found < present:
                raise AssertionError(f"{algorithm.name} lost {present - found} keys")
            if percent == 0:
                rate = (found - present) / max(total - present, 1)
        removal = float("nan")
        if algorithm.removes:
            began = time.perf_counter_ns()
            f.remove(to_add, "key").rows.count()
            removal = (time.perf_counter_ns() - began) / max(n, 1)
        bits = f.bits_per_item
        best = S.optimal_bits(rate) if rate else float("nan")
        return (algorithm.id, algorithm.name, n, add, removal, finds, rate, bits, best, 100 * (bits / best - 1), add + 3 * sum(finds.values()) / len(finds))
    finally:
        f.rows.unpersist()


def bulk(spark: SparkSession, n: int, ids: list[int] | None = None, seed: int = 1 << 20, sample_size: int | None = None) -> DataFrame:
    """Builds and probes each algorithm over n generated keys; a row each."""
    sample_size = min(n, 10_000_000) if sample_size is None else sample_size
    to_add, absent = source.generate(spark, n, seed).persist(), source.generate(spark, max(n, sample_size), seed, n).persist()
    rows = []
    for i in catalog.DEFAULT_IDS if ids is None else ids:
        if i == catalog.SORT_ID:
            began = time.perf_counter_ns()
            to_add.orderBy("key").agg(F.max("key")).first()
            to_add.sort("key").write.format("noop").mode("overwrite").save()
            rows.append((i, "Sort", n, (time.perf_counter_ns() - began) / n, *[None] * 7))
        else:
            rows.append(measure(catalog.ALGORITHMS[i], to_add, absent, sample_size, seed))
    to_add.unpersist()
    absent.unpersist()
    return spark.createDataFrame(rows, REPORT)


def geometric(low: int, high: int, steps: int) -> list[int]:
    """Sizes from low to high in equal ratios, without repeats."""
    ratio = (high / low) ** (1 / max(steps - 1, 1))
    return list(dict.fromkeys(round(low * ratio**i) for i in range(steps)))


def construction_sweep(spark: SparkSession, kind: str, params: dict, sizes: list[int], repeats: int = 10, seed: int = 0) -> DataFrame:
    """(n, builds, failures, failure_rate, bits_per_item, nanos_per_key): many builds of each size, spread over the cluster."""
    sharded.importable(spark)
    grid = spark.createDataFrame([(n, r) for n in sizes for r in range(repeats)], "n long, repeat int").repartition("n", "repeat")

    def run(batches):
        import numpy as np
        import pandas as pd

        for b in batches:
            out = []
            for n, r in zip(b["n"], b["repeat"], strict=True):
                h = np.arange(n, dtype=np.int64)
                began = time.perf_counter_ns()
                payload, _, attempts = K.build(kind, h, seed + 1_000_003 * int(r), params)
                out.append((n, attempts - 1, 8 * K.KERNELS[kind].bytes(payload) / n, (time.perf_counter_ns() - began) / n))
            yield pd.DataFrame(out, columns=["n", "failures", "bits", "nanos"])

    got = grid.mapInPandas(run, "n long, failures int, bits double, nanos double")
    per = got.groupBy("n").agg(F.count("*").alias("builds"), F.sum("failures").alias("failures"), F.avg("bits").alias("bits_per_item"), F.avg("nanos").alias("nanos_per_key"))
    return per.withColumn("failure_rate", F.col("failures") / (F.col("failures") + F.col("builds")))


def load_histogram(f: DataFrame) -> DataFrame:
    """(load, buckets): how many buckets of a sharded table filter hold so many tags."""
    sharded.importable(f.sparkSession)

    def run(batches):
        import numpy as np
        import pandas as pd

        for b in batches:
            for payload in b["payload"]:
                table = K.load(payload)[1]["table"]
                loads = (table != (K.EMPTY if table.dtype == np.uint16 and table.shape[1] == K.PLACES else 0)).sum(1)
                values, counts = np.unique(loads, return_counts=True)
                yield pd.DataFrame({"load": values, "buckets": counts})

    return f.select("payload").mapInPandas(run, "load long, buckets long").groupBy("load").agg(F.sum("buckets").alias("buckets"))
