"""Mergeable summaries: sketches as columns per hour, merged into days and ranges without the rows.

A rollup row holds exact counts and sums, a distinct-count sketch (HyperLogLog) and a
quantile sketch (KLL), both bounded in size whatever the hour holds, so a rollup is small
and any merge of its rows (to days, to weeks, over other columns) reads the rollup alone.

Errors: the distinct count's standard error is about 0.83 / sqrt(2**(LG_K - 1)), below 2 %; a
quantile's rank is off by about 1.7 % at ``KLL_K`` = 200. Both are exact for small inputs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_K, KLL_K = 12, 200


def hourly(events: DataFrame, by: list[str], *, ts: str, distinct: str, value: str, width: str = "hour") -> DataFrame:
    """``width, by, n, total, distinct_sketch, value_sketch``; null values and ids count in ``n`` only."""
    return events.groupBy(F.date_trunc(width, ts).alias(width), *by).agg(
        F.count("*").alias("n"), F.sum(value).alias("total"), F.hll_sketch_agg(distinct, LG_K).alias("distinct_sketch"), F.kll_sketch_agg_double(F.col(value).cast("double"), KLL_K).alias("value_sketch")
    )


def merged(rollup: DataFrame, by: list[Column]) -> DataFrame:
    """Rollup rows merged by other keys (days, fewer columns): sums of counts, unions of sketches."""
    return rollup.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.kll_merge_agg_double("value_sketch", KLL_K).alias("value_sketch")
    )


def estimates(rollup: DataFrame, quantiles: dict[str, float]) -> DataFrame:
    """Sketch columns replaced by ``distinct_count`` and one column a quantile."""
    q = {name: F.kll_sketch_get_quantile_double("value_sketch", F.lit(float(rank))) for name, rank in quantiles.items()}
    return rollup.withColumns({"distinct_count": F.hll_sketch_estimate("distinct_sketch"), **q}).drop("distinct_sketch", "value_sketch")


def append_hours(events: DataFrame, path: str, by: list[str], *, ts: str, distinct: str, value: str) -> None:
    """Write the rollup partitioned by day; a day that is written again replaces itself, others stay."""
    rolled = hourly(events, by, ts=ts, distinct=distinct, value=value).withColumn("day", F.to_date("hour"))
    rolled.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def rank_error(rows: DataFrame, by: list[str], value: str, estimated: DataFrame, column: str, rank: float) -> DataFrame:
    """How far an estimated quantile's rank is from the one asked for: ``by, error``, by one join of the rows with the estimates.

    A value that many rows share covers a stretch of ranks; inside it the error is 0.
    """
    joined = rows.join(estimated.select(*by, F.col(column).alias("_q")), by)
    counted = joined.groupBy(*by).agg(F.count_if(F.col(value) < F.col("_q")).alias("_below"), F.count_if(F.col(value) <= F.col("_q")).alias("_to"), F.count(value).alias("_n"))
    low, high = F.col("_below") / F.col("_n"), F.col("_to") / F.col("_n")
    return counted.select(*by, F.greatest(F.lit(0.0), low - rank, rank - high).alias("error"))
