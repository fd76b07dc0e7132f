"""Gumbel top-k: inclusion follows the weights."""

import math
from collections import Counter

from sieveline.llm import importance

WEIGHTS = [math.log(w) for w in (8.0, 4.0, 2.0, 1.0, 1.0)]


def frame(spark):
    return spark.createDataFrame([(i, i, w) for i, w in enumerate(WEIGHTS)], "doc_id long, crc long, weight double")


def exact(k):
    """Inclusion probabilities of sampling without replacement, by all orders."""
    p = [math.exp(w) for w in WEIGHTS]
    out = [0.0] * len(p)

    def go(chosen, prob):
        if len(chosen) == k:
            for i in chosen:
                out[i] += prob
            return
        rest = sum(x for i, x in enumerate(p) if i not in chosen)
        for i, x in enumerate(p):
            if i not in chosen:
                go([*chosen, i], prob * x / rest)

    go([], 1.0)
    return out


def test_inclusion_rates_over_many_seeds(spark):
    """The noise alone, over 4,000 seeds in one job."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    seeds = spark.range(4000).select(F.col("id").alias("seed"))
    u = (F.shiftrightunsigned(F.xxhash64("seed", "doc_id", "crc"), 11).cast("double") + 0.5) / F.lit(2.0**53)
    scored = seeds.join(F.broadcast(frame(spark)), F.lit(True)).withColumn("score", F.col("weight") - F.log(-F.log(u)))
    place = F.row_number().over(Window.partitionBy("seed").orderBy(F.col("score").desc()))
    rows = scored.withColumn("place", place).groupBy("doc_id").agg(*[F.count_if(F.col("place") <= k).alias(f"k{k}") for k in (1, 2, 3)]).collect()
    for k in (1, 2, 3):
        want = exact(k)
        for r in rows:
            assert abs(r[f"k{k}"] / 4000 - want[r.doc_id]) < 0.03


def test_k_rows_are_drawn_and_seeds_differ(spark):
    df = frame(spark)
    drawn = [frozenset(r.doc_id for r in importance.gumbel_top_k(df, 2, seed).where("kept").collect()) for seed in range(6)]
    assert all(len(x) == 2 for x in drawn) and len(set(drawn)) > 1
    assert importance.gumbel_top_k(df, 0).where("kept").count() == 0 and importance.gumbel_top_k(df, 9).where("kept").count() == 5
    cold = importance.gumbel_top_k(df, 2, temperature=1e-4).where("kept").collect()
    assert {r.doc_id for r in cold} == {0, 1}


def test_k_of_a_whole_resampling(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    kept = importance.resample(docs, labels, k=50, temperature=1.0).where("kept")
    assert kept.count() >= 50 and Counter(r.kept for r in kept.collect())[True] < 60
