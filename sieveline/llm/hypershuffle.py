"""Sharding by a hypergeometric communication matrix, in DataFrame expressions only.

A uniform shuffle into shards of exact sizes, without one global sort:

1. permute each source partition in its own task, and write its rows with the
   partition and their rank in it to the shared folder, so that all later steps and
   retries see the same rows;
2. draw the matrix on the driver: how many rows of each source partition go to
   each shard, multivariate hypergeometric with the shard sizes as margins;
3. deal the ranks of each source partition by the matrix's row;
4. exchange the rows, and permute each shard again.

So whole rows are on disk as staged, as exchanged once and as shards.

A permutation is a sort by a keyed hash. A source partition's is a task's sort, which
spills to disk; a shard's is taken in sub-buckets of about ``BUCKET_ROWS`` rows by the
hash's range, so no task holds a whole shard.

Shard sizes differ by at most one (law ``rows``). Which documents are equal has no
influence: copies fall where the shuffle puts them.

Nulls and ties: every row counts, whatever is null in it; rows are told apart by
their place, so repeated rows get slots of their own. Texts of any length are rows
like others; columns travel in a struct, so their names clash with nothing. An
empty table gives no rows.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_path, stage

#: So few that a task gets several of them, which keeps tasks even.
BUCKET_ROWS = 1_000


#: log(n!) less Stirling's formula for small n; a series gives the others.
_EXACT = 16


def _stirling_error(n: int) -> float:
    if n < _EXACT:
        return math.lgamma(n + 1.0) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi) if n else 0.0
    return (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - 1 / 1188 / n**2) / n**2) / n**2) / n**2) / n


def _deviance(x: float, mean: float) -> float:
    """``x log(x / mean) + mean - x`` without cancellation where they are near."""
    if abs(x - mean) < 0.1 * (x + mean):
        v = (x - mean) / (x + mean)
        total, term, j = (x - mean) * v, 2 * x * v, 1
        while True:
            term *= v * v
            new = total + term / (2 * j + 1)
            if new == total:
                return new
            total, j = new, j + 1
    return x * math.log(x / mean) + mean - x


def _binomial(x: int, n: int, p: float, q: float) -> float:
    """The binomial probability by the saddle-point form, good to about 1e-14 whatever the sizes."""
    if x == 0:
        return math.exp(n * (math.log1p(-p) if p < 0.1 else math.log(q)))
    if x == n:
        return math.exp(n * (math.log1p(-q) if q < 0.1 else math.log(p)))
    log = _stirling_error(n) - _stirling_error(x) - _stirling_error(n - x) - _deviance(x, n * p) - _deviance(n - x, n * q)
    return math.exp(log) * math.sqrt(n / (2 * math.pi * x * (n - x)))


def probability(k: int, good: int, bad: int, drawn: int) -> float:
    """The chance of ``k`` good ones among ``drawn``: a ratio of binomial probabilities."""
    n = good + bad
    p, q = drawn / n, (n - drawn) / n
    return _binomial(k, good, p, q) * _binomial(drawn - k, bad, p, q) / _binomial(drawn, n, p, q)


def hypergeometric(rng: random.Random, good: int, bad: int, drawn: int) -> int:
    """A draw by inversion outward from the mode (time grows with the standard deviation).

    The probabilities it adds up are good to about 1e-13 each; what rounding leaves
    of the whole, below 1e-9, falls on the mode.
    """
    low, high = max(0, drawn - bad), min(drawn, good)
    if low == high:
        return low
    mode = min(high, max(low, (drawn + 1) * (good + 1) // (good + bad + 2)))
    p = probability(mode, good, bad, drawn)
    u = rng.random() - p
    up, down, p_up, p_down = mode, mode, p, p
    while u > 0:
        if up >= high and down <= low:
            return mode  # what rounding left over
        if up < high:
            p_up *= (good - up) * (drawn - up) / ((up + 1) * (bad - drawn + up + 1))
            up += 1
            u -= p_up
            if u <= 0:
                return up
        if down > low:
            p_down *= down * (bad - drawn + down) / ((good - down + 1) * (drawn - down + 1))
            down -= 1
            u -= p_down
            if u <= 0:
                return down
        if p_up < 1e-300 and p_down < 1e-300:
            return mode
    return mode


def matrix(counts: list[int], sizes: list[int], seed: int) -> list[list[int]]:
    """Rows: source partitions; columns: shards; margins: ``counts`` and ``sizes``."""
    rng, room, out = random.Random(seed), list(sizes), []
    for n in counts:
        row, left, rest = [], n, sum(room)
        for i, size in enumerate(room):
            take = left if i == len(room) - 1 else hypergeometric(rng, size, rest - size, left)
            row.append(take)
            left, rest = left - take, rest - size
        room = [a - b for a, b in zip(room, row)]
        out.append(row)
    return out


def shuffle_into_shards(df: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """All columns of ``df`` with ``shard`` int and ``slot`` long, which replace columns of these names; others may have any name.

    The rows are written once to the shared folder with their rank, and exchanged whole once.
    """
    spark = df.sparkSession
    row = F.struct(*[df[f"`{c}`"] for c in df.columns if c not in ("shard", "slot")])
    first = F.xxhash64(F.lit(seed), F.lit("first"), "at")
    second = F.xxhash64(F.lit(seed), F.lit("second"), "at")
    placed = df.select(row.alias("row"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    local = placed.withColumn("hash", first).sortWithinPartitions(_upper(), "hash", "at")
    rank = F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1))  # a row's number in its partition, as sorted
    keyed = stage(local.select("row", "part", "at", rank.alias("rank")), "rows")
    counts = {r.part: r.n for r in keyed.groupBy("part").agg(F.count("*").alias("n")).collect()}  # one row a partition
    total = sum(counts.values())
    sizes = [total // shards + (i < total % shards) for i in range(shards)]
    names = sorted(counts)
    rows = matrix([counts[p] for p in names], sizes, seed)
    ends = [(p, [sum(row[: i + 1]) for i in range(shards)]) for p, row in zip(names, rows)]
    dealt = spark.createDataFrame(ends, "part int, ends array<long>")  # partitions x shards numbers
    shard = F.size(F.filter("ends", lambda e: e <= F.col("rank")))
    sent = keyed.join(F.broadcast(dealt), "part").select("row", "at", shard.alias("shard"), second.alias("hash"))
    out = _ranked(sent, "shard", max(sizes, default=0))
    return out.select("row.*", "shard", F.col("rank").alias("slot"))


def _upper() -> Column:
    """0 to 2**31 - 1, by which rows are sorted and cut into sub-buckets."""
    return F.shiftrightunsigned("hash", 33).cast("long")


def _ranked(rows: DataFrame, key: str, largest: int) -> DataFrame:
    """Adds ``rank``, from 0 within each key by ``hash`` (then ``at``), counted in sub-buckets of about ``BUCKET_ROWS`` rows."""
    buckets = max(1, -(-largest // BUCKET_ROWS))
    rows = rows.withColumn("upper", _upper()).withColumn("bucket", F.floor(F.col("upper") * buckets / F.lit(2.0**31)).cast("int"))
    held = rows.groupBy(key, "bucket").agg(F.count("*").alias("n"))
    base = held.select(key, "bucket", (F.sum("n").over(Window.partitionBy(key).orderBy("bucket")) - F.col("n")).alias("base"))
    number = F.row_number().over(Window.partitionBy(key, "bucket").orderBy("upper", "hash", "at"))
    ranked = rows.withColumn("number", number).join(base, [key, "bucket"])  # one row a bucket; the rows stay where the window has them
    return ranked.withColumn("rank", (F.col("base") + F.col("number") - 1).cast("long")).drop("upper", "bucket", "number", "base", "hash")


def write_shards(df: DataFrame, shards: int, path: str | None = None, seed: int = 0) -> DataFrame:
    """The shards as folders ``shard=0`` and so on of Parquet files with ``slot``; returns what was written."""
    path = path or fresh_path(df.sparkSession, "shards")
    out = shuffle_into_shards(df, shards, seed)
    out.write.partitionBy("shard").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(out.schema).parquet(path)
