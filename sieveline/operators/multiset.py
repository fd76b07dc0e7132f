"""Multiset comparison of two manifests: repeats count.

Both sides become one table of rows with a count on either side, summed by the whole
row in one shuffle (with partial sums before it, so a row repeated a million times is
one row of the exchange). Differences, intersections and unions all come from these counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEFT, RIGHT = "n_left", "n_right"


def compare(left: DataFrame, right: DataFrame) -> DataFrame:
    """Each distinct row (nulls are equal) with how often either side has it: ``n_left``, ``n_right``."""
    columns = left.columns
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    both = left.select(*columns, one.alias(LEFT), none.alias(RIGHT)).unionByName(right.select(*columns, none.alias(LEFT), one.alias(RIGHT)))
    return both.groupBy(*columns).agg(F.sum(LEFT).alias(LEFT), F.sum(RIGHT).alias(RIGHT))


def repeated(counts: DataFrame, times) -> DataFrame:
    """Rows of ``compare`` as often as ``times`` says."""
    n = times.cast("int")
    spread = counts.where(n > 0).withColumn("_i", F.explode(F.sequence(F.lit(1), n)))
    return spread.drop("_i", LEFT, RIGHT)


def except_all(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left rows less as many equal right rows."""
    return repeated(compare(left, right), F.col(LEFT) - F.col(RIGHT))


def intersect_all(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of both sides, as often as the side that has fewer."""
    return repeated(compare(left, right), F.least(LEFT, RIGHT))


def union_max(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of either side, as often as the side that has more."""
    return repeated(compare(left, right), F.greatest(LEFT, RIGHT))


def changes(left: DataFrame, right: DataFrame) -> DataFrame:
    """What turns the left manifest into the right one: rows with ``change`` (added, removed) and ``times``; equal counts are left out."""
    more = F.col(RIGHT) - F.col(LEFT)
    return compare(left, right).where(more != 0).withColumns({"change": F.when(more > 0, "added").otherwise("removed"), "times": F.abs(more)}).drop(LEFT, RIGHT)
