"""Continuous operators (T1-T7) as Structured Streaming plans.

Sinks that merge use ``foreachBatch`` with a batch number in the path, so a
repeated batch overwrites itself. Rows later than a watermark are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.usage import fingerprint, merge_runtime_edges

EVENT = "ts timestamp, path string, op string"


def debounced(events: DataFrame, gap: str = "500 milliseconds", watermark: str = "5 seconds") -> DataFrame:
    """The last event of each path once it has been quiet for ``gap``; works on streams and tables."""
    marked = events.withWatermark("ts", watermark) if events.isStreaming else events
    return marked.groupBy(F.session_window("ts", gap).alias("w"), "path").agg(F.max_by("op", "ts").alias("op"), F.max("ts").alias("ts")).select("path", "op", "ts")


def stale_jobs(jobs: DataFrame, now, minutes: int = 30) -> DataFrame:
    """Running jobs that began too long ago go back to the queue."""
    late = (F.col("status") == "running") & (F.col("started_at") < now - F.make_interval(mins=F.lit(minutes)))
    return jobs.withColumns({"status": F.when(late, "queued").otherwise(F.col("status")), "started_at": F.when(late, F.lit(None)).otherwise(F.col("started_at"))})


def run_jobs(queue: DataFrame, handle, checkpoint: str, interval: str = "2 seconds") -> StreamingQuery:
    """A stream of queued jobs, handled a batch at a time; the checkpoint takes the place of row locks."""
    return queue.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()


def usage_rollup(events: DataFrame, width: str = "1 hour", watermark: str = "10 minutes") -> DataFrame:
    """Counts by window, source and outcome."""
    marked = events.withWatermark("ts", watermark) if events.isStreaming else events
    return marked.groupBy(F.window("ts", width).alias("w"), "source", "outcome").agg(F.count("*").alias("n"), F.avg("latency_ms").alias("mean_ms")).select(F.col("w.start").alias("since"), "source", "outcome", "n", "mean_ms")


def merge_edges_into(stream: DataFrame, path: str, keys: list[str], checkpoint: str) -> StreamingQuery:
    """Each batch of observed calls merges into the newest version below ``path``.

    Only the first batch begins with nothing; a later one whose predecessor is missing fails.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark: SparkSession = batch.sparkSession
        old = spark.read.parquet(f"{path}/v={number - 1}") if number else None
        new = batch.withColumn("seq", F.monotonically_increasing_id())
        base = old if old is not None else new.drop("seq").limit(0)
        merge_runtime_edges(base.select(*new.drop("seq").columns), new, keys).write.mode("overwrite").parquet(f"{path}/v={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def changed_alerts(results: DataFrame, known: DataFrame) -> DataFrame:
    """Saved queries whose result hash isn't the stored one: ``query, fingerprint``."""
    now = fingerprint(results, ["path", "start_line", "end_line"], ["query"])
    return now.join(known.select("query", F.col("fingerprint").alias("old")), "query", "left").where("old is null or old <> fingerprint").drop("old")


def append_insight(counts: DataFrame, path: str, batch: int) -> None:
    """One point (``ts, query, match_count``) a query; a batch that is written again replaces its own points."""
    counts.select("ts", "query", "match_count").write.mode("overwrite").parquet(f"{path}/batch={batch}")


def over_limit(requests: DataFrame, limit: int = 200, watermark: str = "2 seconds") -> DataFrame:
    """Keys with more than ``limit`` requests in a second."""
    marked = requests.withWatermark("ts", watermark) if requests.isStreaming else requests
    return marked.groupBy(F.window("ts", "1 second").alias("w"), "key").agg(F.count("*").alias("n")).where(F.col("n") > limit).select(F.col("w.start").alias("second"), "key", "n")


def stream_table(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of the Parquet files in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
