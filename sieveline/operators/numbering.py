"""Row numbers over a whole table without one task for all of it.

Ranges of the order are the tasks; each numbers its own rows, and the counts of the ranges
before it, one number a range, carry the numbers on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut


def numbered(df: DataFrame, order: list[Column | str], name: str = "number", partitions: int | None = None) -> DataFrame:
    """``df`` with ``name``, from 1 in the given order; the order should tell all rows apart, else ties are numbered in any order.

    Rows that are equal in the order lie in one range, so it should be selective.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    at = cut(placed.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    held = at.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))  # one row a range
    before = held.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).drop("_n")
    return at.join(F.broadcast(before), "_part").withColumn(name, F.col("_at") - F.col("_first") + F.col("_before") + 1).drop("_part", "_at", "_first", "_before")


def round_robin(df: DataFrame, order: list[Column | str], members: int, name: str = "member") -> DataFrame:
    """M4: rows dealt to the members of a pool in turn, in the given order."""
    return numbered(df, order, name).withColumn(name, ((F.col(name) - 1) % members).cast("int"))
