"""Overlapping windows over late and unordered rows; provisional and final counts told apart.

``sliding_counts`` is the plan, for tables and streams: a row belongs to ``width / slide``
windows. ``run_sliding`` keeps two outputs of one stream:

- ``final``: append mode; a window comes once, when the watermark has passed its end;
- ``provisional``: update mode through ``foreachBatch``; each batch's changed windows under
  their batch number, so a repeated batch overwrites itself. The newest version of a window
  is its state; windows that are final are not provisional any more.

Rows later than the watermark are in neither; their number is in the report.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .pairing import late_rows


def sliding_counts(events: DataFrame, by: list[str], *, ts: str = "ts", value: str = "value", width: str = "1 hour", slide: str = "15 minutes", watermark: str = "30 minutes") -> DataFrame:
    """``started, ended, by, n, total``; rows without a time are in no window."""
    marked = events.withWatermark(ts, watermark) if events.isStreaming else events
    grouped = marked.groupBy(F.window(ts, width, slide).alias("w"), *by)
    return grouped.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("started"), F.col("w.end").alias("ended"), *by, "n", "total")


@dataclass
class Report:
    """What a run did: late rows dropped by the final output's query, and batches of either."""

    late: int
    final_batches: int
    provisional_batches: int


def run_sliding(events: DataFrame, by: list[str], folder: str, **shape: str) -> Report:
    """Both outputs over what the stream holds now, below ``folder``; again with the same folder it goes on."""
    plan = sliding_counts(events, by, **shape)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/provisional/batch={number}")

    final = plan.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/final").option("checkpointLocation", f"{folder}/checkpoint-final").trigger(availableNow=True).start()
    changed = plan.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{folder}/checkpoint-provisional").trigger(availableNow=True).start()
    for q in (final, changed):
        _finished(q)
    return Report(late_rows(final), len(final.recentProgress), len(changed.recentProgress))


def _finished(q: StreamingQuery) -> None:
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


def state(spark: SparkSession, folder: str, by: list[str]) -> DataFrame:
    """Every window with ``status``: final ones as they came, others as their newest version says."""
    final = spark.read.parquet(f"{folder}/final")
    newest = Window.partitionBy("started", "ended", *by).orderBy(F.col("batch").desc())
    open_ = spark.read.parquet(f"{folder}/provisional").withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n", "batch")
    matched = [F.col(f"o.{c}").eqNullSafe(F.col(f"f.{c}")) for c in ("started", "ended", *by)]
    on = matched[0]
    for m in matched[1:]:
        on = on & m
    rest = open_.alias("o").join(final.alias("f"), on, "left_anti")
    return final.withColumn("status", F.lit("final")).unionByName(rest.withColumn("status", F.lit("provisional")))
