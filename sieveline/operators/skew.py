"""Joins that choose their way by measured size and skew.

``measure`` counts both sides by key (partial sums before the exchange) and keeps what
the choice needs: totals, and the heavy keys, those with over ``share`` of a task's fair
part. ``adaptive_join`` then takes

- a broadcast, if a side's measured bytes are below ``broadcast_bytes``;
- else a plain join for all keys that aren't heavy, and for heavy keys a salted one: the
  side with more rows of the key is dealt over as many salts as its rows need, the
  other side's rows of the key are copied to each of these salts.

Heavy keys are at most ``partitions / share`` on either side, whatever the tables hold, so their list is
bounded and goes along as a small table.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut

#: Measured bytes up to which a side is broadcast; times a task's fair part from which a key is heavy.
BROADCAST_BYTES, HEAVY = 64 << 20, 1.0
#: Rows whose size is measured.
SIZED = 100_000
_KEY, _SALT = "_join_key", "_join_salt"


@dataclass
class Choice:
    """What was measured, and the way taken."""

    way: str
    rows: tuple[int, int]
    bytes: tuple[int, int]
    heavy: DataFrame | None = None
    salts: dict = field(default_factory=dict)


def row_bytes(df: DataFrame, rows: int) -> int:
    """Bytes of a row as text of its columns, on average over about ``SIZED`` rows drawn from all; 16 more for the row itself."""
    some = df if rows <= SIZED else df.sample(SIZED / rows, seed=7)
    length = sum((F.coalesce(F.length(F.to_json(F.struct(df[f"`{c}`"]))), F.lit(0)) for c in df.columns), F.lit(16))
    return int(some.agg(F.avg(length)).first()[0] or 16)


def key_of(df: DataFrame, on: list[str]):
    """One string for the key; null if a part is, as such rows join nothing."""
    parts = [df[f"`{c}`"].cast("string") for c in on]
    missing = F.lit(False)
    for p in parts:
        missing = missing | p.isNull()
    return F.when(~missing, F.to_json(F.array(*parts)))


def measure(left: DataFrame, right: DataFrame, on: list[str], partitions: int, share: float = HEAVY) -> tuple[DataFrame, tuple[int, int]]:
    """Heavy keys (``key, n_left, n_right``) and both row counts."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    both = left.select(key_of(left, on).alias(_KEY), one.alias("n_left"), none.alias("n_right")).unionByName(right.select(key_of(right, on).alias(_KEY), none.alias("n_left"), one.alias("n_right")))
    counts = cut(both.groupBy(_KEY).agg(F.sum("n_left").alias("n_left"), F.sum("n_right").alias("n_right")))
    total = counts.agg(F.coalesce(F.sum("n_left"), none).alias("l"), F.coalesce(F.sum("n_right"), none).alias("r")).first()
    heavy = counts.where(F.col(_KEY).isNotNull() & (F.col("n_left") > 0) & (F.col("n_right") > 0))
    heavy = heavy.where((F.col("n_left") > share * total.l / partitions + 1) | (F.col("n_right") > share * total.r / partitions + 1))
    return heavy, (total.l, total.r)


def adaptive_join(left: DataFrame, right: DataFrame, on: list[str], *, partitions: int | None = None, share: float = HEAVY, broadcast_bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, Choice]:
    """The inner equi-join on ``on`` (columns of both sides; others must have different names), and the way taken."""
    spark = left.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    heavy, rows = measure(left, right, on, n, share)
    widths = row_bytes(left, rows[0]), row_bytes(right, rows[1])
    size = rows[0] * widths[0], rows[1] * widths[1]
    if min(size) <= broadcast_bytes:
        small_right = size[1] <= size[0]
        out = left.join(F.broadcast(right), on) if small_right else left.hint("broadcast").join(right, on)
        return out, Choice("broadcast right" if small_right else "broadcast left", rows, size)
    fair = [max(1.0, share * r / n) for r in rows]
    needs = lambda c, f: F.greatest(F.lit(1), F.ceil(F.col(c) / F.lit(f))).cast("int")
    # the side with more fair parts is dealt, the other one copied
    plan = heavy.withColumns({"_l": needs("n_left", fair[0]), "_r": needs("n_right", fair[1])}).withColumn("_deal_left", F.col("_l") >= F.col("_r")).withColumn("_salts", F.greatest("_l", "_r")).select(_KEY, "_deal_left", "_salts")
    plan = cut(plan)
    if plan.isEmpty():
        return left.join(right, on), Choice("plain", rows, size, heavy)
    spread = F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))

    def salted(df: DataFrame, is_left: bool) -> tuple[DataFrame, DataFrame]:
        keyed = df.withColumn(_KEY, key_of(df, on))
        some = keyed.join(F.broadcast(plan), _KEY)  # a bounded list
        dealt = some.where(F.col("_deal_left") == F.lit(is_left))
        copied = some.where(F.col("_deal_left") != F.lit(is_left))
        deal = dealt.withColumn(_SALT, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns], F.monotonically_increasing_id()), F.col("_salts")).cast("int"))  # equal rows part too
        copy = copied.withColumn(_SALT, spread)
        drop = ["_deal_left", "_salts"]
        return deal.drop(*drop).unionByName(copy.drop(*drop)), keyed.join(F.broadcast(plan.select(_KEY)), _KEY, "left_anti").drop(_KEY)

    heavy_left, rest_left = salted(left, True)
    heavy_right, rest_right = salted(right, False)
    hot = heavy_left.join(heavy_right.drop(*on), [_KEY, _SALT]).drop(_KEY, _SALT)
    plain = rest_left.join(rest_right, on)
    return plain.unionByName(hot.select(*plain.columns)), Choice("salted", rows, size, plan)


def dealt_rows(df: DataFrame, on: list[str], plan: DataFrame, partitions: int, is_left: bool = True) -> DataFrame:
    """Rows of each partition of the salted exchange: ``part, n``; for tests and reports of the spread."""
    keyed = df.withColumn(_KEY, key_of(df, on)).join(F.broadcast(plan), _KEY)
    deal = keyed.where(F.col("_deal_left") == F.lit(is_left)).withColumn(_SALT, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns], F.monotonically_increasing_id()), F.col("_salts")).cast("int"))
    return deal.repartition(partitions, _KEY, _SALT).groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n"))
