"""job leases of many keys: a batch pays by buckets of keys, and slices are dealt in one pass, several files each."""

import datetime as dt
import time

from pyspark.sql import functions as F

from sieveline.operators.lineage import fresh_path
from sieveline.streaming import pairing, timers

JOB = "key long, at timestamp, kind string, seq long"


def test_thousands_of_keys_in_little_time(spark):
    """12,000 keys in three batches: with a group a key they took over a minute."""
    kinds = F.element_at(F.array(*map(F.lit, ("enqueue", "claim", "heartbeat", "fail"))), (F.floor(F.col("id") / 12_000) + 1).cast("int"))
    rows = spark.range(48_000).select((F.col("id") % 12_000).alias("key"), F.timestamp_seconds(1_700_000_000 + F.col("id") / 100).alias("at"), kinds.alias("kind"), F.col("id").alias("seq"))
    path, out = fresh_path(spark, "many"), fresh_path(spark, "many-out")
    buckets = timers.buckets_for(rows, "key")
    files = pairing.in_order_files(rows, "at", path, group=timers.bucket("key", buckets))
    spark.createDataFrame([(-1, dt.datetime(2030, 1, 1), "heartbeat", 0)], JOB).coalesce(1).write.mode("append").parquet(path)
    since = time.time()
    changes = timers.job_leases(pairing.file_stream(timers.with_rocksdb(spark), path, JOB, files), lease_seconds=10**6, attempts=1, buckets=buckets)
    changes.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/check").trigger(availableNow=True).start().awaitTermination()
    got = {r.change: r.n for r in spark.read.parquet(f"{out}/rows").groupBy("change").agg(F.count("*").alias("n")).collect()}
    assert got == {"queued": 12_000, "running": 12_000, "failed": 12_000, "dead": 12_000}
    assert time.time() - since < 45


def test_slices_are_in_order_whole_and_bounded(spark, monkeypatch):
    monkeypatch.setattr(pairing, "SLICE_ROWS", 500)
    monkeypatch.setattr(pairing, "GROUP_ROWS", 300)
    rows = spark.range(6000).select((F.col("id") % 10).alias("key"), F.when(F.col("id") % 100 > 0, F.timestamp_seconds(F.col("id"))).alias("at"), F.lit("claim").alias("kind"), F.col("id").alias("seq"))
    path = fresh_path(spark, "slices")
    files = pairing.in_order_files(rows, "at", path, group=F.col("key"))
    back = spark.read.schema(JOB).parquet(path).select("*", "_metadata.file_path", "_metadata.file_modification_time")
    found = back.groupBy("file_path", "file_modification_time").agg(F.min("at").alias("low"), F.max("at").alias("high"), F.count("*").alias("n")).orderBy("file_modification_time").collect()
    assert files == 4 and len(found) == 4 * 3 and sum(r.n for r in found) == 6000 and max(r.n for r in found) < 700
    slices = [found[i : i + files] for i in range(0, len(found), files)]
    assert all(max(r.high for r in a) < min(r.low for r in b) for a, b in zip(slices, slices[1:]))
    assert back.select("seq").distinct().count() == 6000
