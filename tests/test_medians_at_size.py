"""medians of many small keys go through no Python state, and a large key's rows are never brought together."""

import random

import pytest
from pyspark.sql import functions as F

from sieveline.operators import medians


@pytest.mark.parametrize("exact", [0, 20, 400, 1 << 14])
def test_every_way_gives_the_same_medians(spark, monkeypatch, exact):
    monkeypatch.setattr(medians, "EXACT_ROWS", exact)
    rng = random.Random(9)
    rows = [(k, rng.choice([rng.random(), float(rng.randrange(4))]), float(rng.randrange(1, 9))) for k, n in (("hot", 3000), ("b", 300), (None, 40), ("few", 3)) for _ in range(n)]
    rows += [("same", 2.0, 1.0)] * 500 + [("ends", float("-inf"), 1.0), ("ends", float("inf"), 1.0), ("ends", 1e308, 1.0)]
    want = {}
    for key in {k for k, _, _ in rows}:
        own = sorted((v, w) for k, v, w in rows if k == key)
        half, run = sum(w for _, w in own) / 2, 0.0
        for v, w in own:
            run += w
            if run >= half:
                want[key] = (v, 2 * half)
                break
    df = spark.createDataFrame(rows, "k string, v double, w double").repartition(5)
    assert {r.k: (r.median, r.total_weight) for r in medians.weighted_median(df, ["k"], "v", "w", cells=8).collect()} == want


def test_a_large_key_stays_where_it_is(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(medians, "cut", lambda df: seen.append(df._jdf.queryExecution().toString()) or df.localCheckpoint(eager=True))
    rows = spark.range(200_000).select(F.lit("hot").alias("k"), F.pmod(F.xxhash64("id"), F.lit(10**9)).cast("double").alias("v"), F.lit(1.0).alias("w"))
    assert medians.weighted_median(rows, ["k"], "v", "w").count() == 1
    over_rows = [plan for plan in seen if "MapInArrow" not in plan]  # the others join states
    assert len(over_rows) > 1 and not any("SortMergeJoin" in plan for plan in over_rows)


def test_small_keys_need_no_states(spark, monkeypatch):
    monkeypatch.setattr(medians, "states", None)
    rows = spark.range(30_000).select((F.col("id") % 3000).alias("k"), F.col("id").cast("double").alias("v"), F.lit(1.0).alias("w"))
    got = medians.weighted_median(rows, ["k"], "v", "w")
    assert got.count() == 3000 and got.where("median <> k + 4 * 3000").count() == 0
