"""Streams over the events table, run to their end, for queries and tests."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.operators import bloom, counting
from tamis.streaming import maintain


def _users(spark: SparkSession, sf_dir: str) -> int:
    """Keys that the maintained filters are sized for."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").dropna().distinct().count()


def _scratch(spark: SparkSession) -> str:
    """A folder that driver and executors share; a local session may use a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/tamis-stream-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="tamis-stream-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    return f"file://{own}"


def _batches(spark: SparkSession, sf_dir: str, work: str, parts: int = 3) -> DataFrame:
    """The events as a stream of some files, one a batch."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartitionByRange(parts, "ts").write.parquet(f"{work}/in")
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{work}/in")


def _finish(writer) -> None:
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()


def counting_of_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    work, s = _scratch(spark), counting.spec("counting", _users(spark, sf_dir))
    _finish(maintain.maintain_counting(_batches(spark, sf_dir, work), "user_id", s, f"{work}/filter", f"{work}/checkpoint"))
    return maintain.current(spark, f"{work}/filter")


def bloom_of_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    work, s = _scratch(spark), bloom.spec("block32", _users(spark, sf_dir))
    _finish(maintain.maintain_bloom(_batches(spark, sf_dir, work), "user_id", s, f"{work}/filter", f"{work}/checkpoint"))
    return maintain.current(spark, f"{work}/filter")


def first_seen_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each user was seen first: once."""
    work = _scratch(spark)
    out = maintain.first_seen(_batches(spark, sf_dir, work).select("user_id"), "user_id", shards=4)
    _finish(out.writeStream.format("parquet").option("path", f"{work}/out").option("checkpointLocation", f"{work}/checkpoint"))
    return spark.read.parquet(f"{work}/out").groupBy("user_id").agg(F.count("*").alias("events"))


def daily_windows(spark: SparkSession, sf_dir: str, parts: int = 3) -> DataFrame:
    """The filters of the days (since 1970) that the watermark closed: (day, block, words).

    The events come in spans of time, one after the other, so none is late."""
    work = _scratch(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts")
    # the clock's time as an instant in UTC, whatever the session's zone
    second = F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts"))
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts"))
    events = events.select("user_id", F.timestamp_micros(micros).alias("ts"), second.alias("second"))
    first, last = events.agg(F.min("second"), F.max("second")).first()
    if first is None:
        first = last = 0
    span = F.least(F.floor((F.col("second") - first) * parts / (last - first + 1)), F.lit(parts - 1))
    s, schema = bloom.spec("block32", _users(spark, sf_dir)), events.drop("second").schema
    for part in range(parts):
        events.where(span == part).drop("second").write.mode("append").parquet(f"{work}/in")
        out = maintain.windowed_bloom(spark.readStream.schema(schema).parquet(f"{work}/in"), "ts", "user_id", s, "1 day", "1 hour")
        _finish(out.writeStream.format("parquet").outputMode("append").option("path", f"{work}/out").option("checkpointLocation", f"{work}/checkpoint"))
    day = F.floor(F.unix_seconds("window.start") / 86400).cast("long").alias("day")
    return spark.read.schema(out.schema).parquet(f"{work}/out").select(day, "block", *s.words)
