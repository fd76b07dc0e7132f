"""Two streams joined within a bounded time: requests with their responses.

Both sides keep state until the watermarks say that nothing can match any more; then it
is evicted, and a request that found no response comes out with nulls. Rows later than
their side's watermark are dropped by Spark and counted in the query's progress
(``late_rows``). The same function over tables is the batch form of the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from ..operators.lineage import fresh_path

REQUEST = "request_id long, key long, sent timestamp"
RESPONSE = "response_id long, key long, answered timestamp"


def paired(requests: DataFrame, responses: DataFrame, within: str = "1 hour", watermark: str = "10 minutes") -> DataFrame:
    """``request_id, key, sent, response_id, answered``: every response of the key from ``sent`` to ``within`` after it; nulls if there is none.

    Null keys and times match nothing: in the batch form such requests stay without a response; a
    stream leaves requests without a time out, as they can't be finished by any watermark.
    """
    r = requests.select("request_id", "key", "sent")
    s = responses.select("response_id", F.col("key").alias("_key"), "answered")
    if requests.isStreaming:
        r = r.where("sent is not null").withWatermark("sent", watermark)
    if responses.isStreaming:
        s = s.where("answered is not null").withWatermark("answered", watermark)
    bounds = F.expr(f"key = _key AND answered >= sent AND answered <= sent + INTERVAL {within}")
    return r.join(s, bounds, "leftOuter").select("request_id", "key", "sent", "response_id", "answered")


def run_pairing(requests: DataFrame, responses: DataFrame, out: str, checkpoint: str, **bounds: str) -> StreamingQuery:
    """The stream form, appended to ``out``, over what is there now; run again with the same checkpoint it goes on."""
    return paired(requests, responses, **bounds).writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_rows(query: StreamingQuery) -> int:
    """Rows that a finished or running query has dropped as later than the watermark, over all its reported batches."""
    return sum(int(state["numRowsDroppedByWatermark"]) for p in query.recentProgress for state in p["stateOperators"])


def state_rows(query: StreamingQuery) -> int:
    """Rows that the query's operators keep after its last batch."""
    last = query.lastProgress
    return sum(int(state["numRowsTotal"]) for state in last["stateOperators"]) if last else 0


#: Rows of a slice's file, which one task writes; rows of one group in a slice that is cut by groups.
SLICE_ROWS, GROUP_ROWS = 1_000_000, 100_000


def in_order_files(df: DataFrame, ts: str, path: str, least: int = 3, group: Column | None = None) -> int:
    """A table as files in the order of a time, as a producer would leave them: slice after slice; returns the files of a slice.

    Slices end at approximate quantiles of the time; rows without one go first. A slice is one file of about
    ``SLICE_ROWS`` rows. With ``group`` there are as many slices as keep a group's rows in each below about ``GROUP_ROWS``,
    whatever the number of groups, and a slice may be several files: a reader that pays for each group in a batch
    then pays a few times a group. The table is read once and dealt into its slices, so a slice costs its own rows only.
    """
    spark = df.sparkSession
    seconds = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    rows = df.count()
    if group is None:
        slices, files = max(least, -(-rows // SLICE_ROWS)), 1
    else:
        most = df.groupBy(group.alias("_group")).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        slices = max(least, -(-most // GROUP_ROWS))
        files = max(1, -(-rows // (slices * SLICE_ROWS)))
    ends = df.select(seconds.alias("s")).where("s is not null").approxQuantile("s", [(i + 1) / slices for i in range(slices - 1)], min(0.01, 0.2 / slices))
    number = F.coalesce(sum(((seconds > e).cast("int") for e in ends), F.lit(0)), F.lit(0))
    dealt = fresh_path(spark, "dealt")
    df.withColumn("_slice", number).write.partitionBy("_slice").parquet(dealt)
    for i in range(slices):
        own = spark.read.schema(StructType([*df.schema.fields, StructField("_slice", IntegerType())])).parquet(dealt).where(F.col("_slice") == i).drop("_slice")  # its folder only
        (own.coalesce(1) if files == 1 else own.repartition(files)).write.mode("append").parquet(path)
    return files


def file_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of a folder's Parquet files, oldest first."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
