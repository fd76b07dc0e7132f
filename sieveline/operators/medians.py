"""Weighted medians by key in two phases: bounded partial states per task, merged by key, exact in the end.

States pay for keys of more than ``EXACT_ROWS`` rows only. The others are sorted by key and added up, which holds
that many rows of a key at most. The rest of this text is about the large keys.

A task summarises its rows of a key as at most ``CELLS`` cells (least value, greatest value,
weight) of about equal weight; equal values are never parted. Cells of all tasks are merged in two
steps: by key and a salt, compacted to ``CELLS`` again, then by key. What the cells prove is a
stretch in which the median must lie. Keys whose stretch isn't one value yet go through the rows
again, which now only cells inside the stretch (and the weight below it) count for; each
pass narrows a stretch by about ``CELLS``. A stretch of ``EXACT_ROWS`` rows or fewer is sorted and added up, so two or
three passes end with the exact value, and no task ever holds a large key's rows. What is known of the large keys, a
row each and thus one for ``EXACT_ROWS`` rows of the table at most, is broadcast: the rows stay where they are.

The median is the least value whose weight, with all below it, reaches half of the key's total.
Null values, and weights that are null or not positive, don't take part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

#: Cells of a state; keys that a task holds before it hands its states on; salts of a key's states; rows held before they are summarised.
CELLS, HELD_KEYS, SALTS, PENDING = 64, 20_000, 8, 1 << 18
#: Rows of a key that are sorted and added up at once.
EXACT_ROWS = 1 << 14
_STATE = "key string, low double, high double, weight double"
_ARROW = pa.schema([("key", pa.string()), ("low", pa.float64()), ("high", pa.float64()), ("weight", pa.float64())])


def compact(low: np.ndarray, high: np.ndarray, weight: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """At most ``cells`` cells of about equal weight; equal single values are put together first."""
    order = np.lexsort((high, low))
    low, high, weight = low[order], high[order], weight[order]
    new = np.append(True, (low[1:] != low[:-1]) | (high[1:] != high[:-1]))
    at = np.flatnonzero(new)
    low, high, weight = low[at], high[at], np.add.reduceat(weight, at)
    if len(low) > cells:
        group = np.minimum((np.cumsum(weight) - weight / 2) * cells // weight.sum(), cells - 1).astype(np.int64)
        at = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        low, high, weight = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.add.reduceat(weight, at)
    return low, high, weight


def _batch(states: list[tuple]) -> pa.RecordBatch:
    keys = [k for k, low, _, _ in states for _ in range(len(low))]
    columns = [np.concatenate([s[i] for s in states]) if states else np.zeros(0) for i in (1, 2, 3)]
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array(c) for c in columns)], schema=_ARROW)


def _grouped(key: np.ndarray, *values: np.ndarray) -> Iterator[tuple]:
    order = np.argsort(key, kind="stable")
    key = key[order]
    at = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        yield key[a], *(v[order[a:b]] for v in values)


def _summarise(cells: int):
    """Arrow batches ``key, low, high, weight`` in any order -> at most ``cells`` cells a key held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, PENDING):
                part = batch.slice(at, PENDING)
                codes = part.column(0).dictionary_encode()
                names = codes.dictionary.to_pylist()
                for code, *new in _grouped(codes.indices.to_numpy(), *(part.column(i).to_numpy() for i in (1, 2, 3))):
                    name = names[code]
                    old = held.get(name)
                    held[name] = compact(*(np.concatenate(x) for x in zip(old, new)) if old else new, cells)
                if len(held) > HELD_KEYS:
                    yield _batch([(k, *v) for k, v in held.items()])
                    held = {}
        if held:
            yield _batch([(k, *v) for k, v in held.items()])

    return run


def states(rows: DataFrame, cells: int = CELLS) -> DataFrame:
    """Phase one: ``key, low, high, weight`` cells of each task's rows (``key, value, weight``); no exchange."""
    return rows.select("key", F.col("value").alias("low"), F.col("value").alias("high"), "weight").mapInArrow(_summarise(cells), _STATE)


def merge(parts: DataFrame, cells: int = CELLS) -> DataFrame:
    """Phase two: states of a key merged by a tree of two levels, at most ``SALTS`` times ``cells`` cells on the upper one."""
    salted = parts.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    lower = salted.repartition("key", "_salt").select("key", "low", "high", "weight").mapInArrow(_summarise(cells), _STATE)
    return lower.repartition("key").mapInArrow(_summarise(cells), _STATE)


def stretches(cells: DataFrame, totals: DataFrame) -> DataFrame:
    """``key, half, low, high, below``: where the median lies, and the weight of what is surely below that.

    ``totals``: ``key, half, below`` with the half weight and the weight that lies under the cells.
    """
    joined = cells.join(totals, "key")
    by_low = Window.partitionBy("key").orderBy("low").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    by_high = Window.partitionBy("key").orderBy("high").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    # at most so much weight stands at or under a cell's least value; at least so much at or under its greatest
    ranked = joined.withColumn("_most", F.col("below") + F.sum("weight").over(by_low)).withColumn("_least", F.col("below") + F.sum("weight").over(by_high))
    return ranked.groupBy("key").agg(
        F.any_value("half").alias("half"), F.min(F.when(F.col("_most") >= F.col("half"), F.col("low"))).alias("low"), F.min(F.when(F.col("_least") >= F.col("half"), F.col("high"))).alias("high")
    )


def weighted_median(df: DataFrame, keys: list[str], value: str, weight: str, *, cells: int = CELLS, max_passes: int = 30) -> DataFrame:
    """``keys, median, total_weight`` of each key that has a row taking part."""
    v, w = F.col(f"`{value}`").cast("double"), F.col(f"`{weight}`").cast("double")
    name = F.to_json(F.array(*[F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("\0null")) for k in keys]))
    rows = df.where(v.isNotNull() & ~F.isnan(v) & (w > 0)).select(name.alias("key"), *[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)], v.alias("value"), w.alias("weight"))
    firsts = [F.any_value(f"_k{i}").alias(f"_k{i}") for i in range(len(keys))]
    known = cut(rows.groupBy("key").agg(F.sum("weight").alias("total_weight"), F.count("*").alias("_n"), *firsts))
    slim, large, done = rows.select("key", "value", "weight"), known.where(F.col("_n") > EXACT_ROWS), []
    some = not large.isEmpty()
    if not some or not known.where(F.col("_n") <= EXACT_ROWS).isEmpty():
        small = slim.join(F.broadcast(large.select("key")), "key", "left_anti") if some else slim
        done.append(_summed(small.select("*", (F.sum("weight").over(Window.partitionBy("key")) / 2).alias("half"), F.lit(0.0).alias("below"))))
    if some:
        done += _narrowed(slim, large.select("key", (F.col("total_weight") / 2).alias("half"), F.lit(0.0).alias("below")), cells, max_passes)
    named = known.join(reduce(DataFrame.unionByName, done), "key")
    return named.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], "median", "total_weight")


def _summed(rows: DataFrame) -> DataFrame:
    """``key, median`` of ``key, value, weight, half, below``: the first value at which the weight, with ``below`` under these rows, reaches half."""
    upto = Window.partitionBy("key").orderBy("value").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = rows.withColumn("_c", F.col("below") + F.sum("weight").over(upto))
    return ranked.groupBy("key").agg(F.coalesce(F.min(F.when(F.col("_c") >= F.col("half"), F.col("value"))), F.max("value")).alias("median"))


def _narrowed(slim: DataFrame, totals: DataFrame, cells: int, max_passes: int) -> list[DataFrame]:
    """``key, median`` of the keys in ``totals``, in parts, by states and narrowing passes."""
    current, done = slim.join(F.broadcast(totals.select("key")), "key", "left_semi"), []
    for _ in range(max_passes):
        found = cut(stretches(merge(states(current, cells), cells), totals))
        done.append(found.where("low = high").select("key", F.col("low").alias("median")))
        left = found.where("low < high")
        if left.isEmpty():
            return done
        inside = F.col("value") >= F.col("low")
        near = slim.join(F.broadcast(left), "key").where("value <= high").groupBy("key", "low", "high", "half")
        counted = cut(near.agg(F.coalesce(F.sum(F.when(~inside, F.col("weight"))), F.lit(0.0)).alias("below"), F.count(F.when(inside, 1)).alias("n")))
        few, many = counted.where(F.col("n") <= EXACT_ROWS), counted.where(F.col("n") > EXACT_ROWS)
        if not few.isEmpty():
            done.append(_summed(slim.join(F.broadcast(few), "key").where("value between low and high").select("key", "value", "weight", "half", "below")))
        if many.isEmpty():
            return done
        totals = many.select("key", "half", "below")
        current = slim.join(F.broadcast(many), "key").where("value between low and high").select("key", "value", "weight")
    raise RuntimeError(f"medians haven't settled in {max_passes} passes")
