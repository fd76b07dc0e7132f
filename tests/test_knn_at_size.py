"""Exact neighbours as matrix products: same ranks as pair by pair, on odd vectors and ties too."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from sieveline.operators import ranking


def _cosine(a, b):
    if a is None or b is None or len(a) != len(b) or not a:
        return 0.0
    na, nb = math.sqrt(sum(x * x for x in a)), math.sqrt(sum(x * x for x in b))
    return 0.0 if not na or not nb else round(sum(x * y for x, y in zip(a, b)) / (na * nb), 9)


@pytest.mark.parametrize("block", [4096, 7])
def test_ranks_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ranking, "MAX_BROADCAST_QUERIES", block)
    r = random.Random(5)
    vectors = [[r.uniform(-1, 1) for _ in range(4)] for _ in range(300)]
    vectors += [vectors[0]] * 40 + [[2 * x for x in vectors[1]]] * 30 + [[0.0] * 4, [], [1.0, 2.0], None]
    rows = [(f"k{i:04d}", v) for i, v in enumerate(vectors)]
    r.shuffle(rows)
    asked = [(i, vectors[i]) for i in range(20)] + [(100, [0.0] * 4), (101, [1.0, 1.0]), (102, []), (103, None)]
    got = ranking.knn(spark.createDataFrame(rows, "id string, embedding array<double>").repartition(3), spark.createDataFrame(asked, "qid long, qvec array<double>"), 10).collect()
    for qid, q in asked:
        want = sorted(((-_cosine(q, v), key) for key, v in rows if v is not None))[:10]
        mine = sorted((x.rank, x.key, x.score) for x in got if x.qid == qid)
        assert [(key, score) for _, key, score in mine] == [(key, pytest.approx(-s, abs=2e-9)) for s, key in want]


def test_null_and_infinite_elements_rank_as_before(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [0.5, 0.5])], "id long, embedding array<double>")
    got = ranking.knn(rows, spark.createDataFrame([(1, [1.0, 0.0])], "qid long, qvec array<double>"), 4).orderBy("rank").collect()
    assert [x.key for x in got] == [3, 1, 4, 2] and got[3].score is None


def test_many_pairs_in_little_time(spark):
    """240 million pairs: pair by pair they took minutes."""
    v = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: (F.pmod(F.xxhash64("id", i), F.lit(2001)) / 1000.0 - 1.0).cast("float"))
    rows = spark.range(120_000).repartition(4).select("id", v.alias("embedding"))
    asked = rows.where("id % 60 = 0").select(F.col("id").alias("qid"), F.col("embedding").alias("qvec"))
    since = time.time()
    got = ranking.knn(rows, asked, 10)
    assert got.where("rank = 1 and qid = key").count() == 2000
    assert time.time() - since < 45
