import random

from pyspark.sql import functions as F

from sieveline.operators import ranking as r

LIST = "path string, start_line int, score double, rank int"


def fused(spark, v, w, k=10):
    a, b = spark.createDataFrame(v, LIST), spark.createDataFrame(w, LIST)
    return [(x.path, x.start_line, round(x.score, 6)) for x in r.fuse_rrf(a, b, k).orderBy("rank").collect()]


def test_fusion_dedup_and_disjoint(spark):
    assert fused(spark, [("a.go", 10, 0.9, 1)], [("a.go", 10, 0.7, 1)]) == [("a.go", 10, 1.0)]
    out = fused(spark, [("a.go", 10, 0.9, 1)], [("b.go", 20, 0.8, 1)])
    assert [p for p, _, _ in out] == ["a.go", "b.go"]


def test_fusion_passes_a_lone_leg_through_uncut(spark):
    leg = [(f"f{i}.go", 1, 1.0 - i / 10, i + 1) for i in range(5)]
    assert [s for _, _, s in fused(spark, leg, [], k=2)] == [1.0, 0.9, 0.8, 0.7, 0.6]


def test_cosine_guards(spark):
    from sieveline.functions.scalars import cosine

    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0])], "a array<float>, b array<float>")
    assert [x[0] for x in df.select(cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0, 0.0]


def test_diversity_equals_greedy(spark):
    rng = random.Random(1)
    rows = [(f"p{rng.randrange(3)}", "", i) for i in range(60)]
    rows = [(p, f"{p}/f{rng.randrange(5)}", i) for p, _, i in rows]
    got = [x.rank for x in r.diversify(spark.createDataFrame(rows, "project string, path string, rank int"), 2, 5, 12).orderBy("rank").collect()]
    assert got == [x[2] for x in r.diversify_loop(rows, 2, 5, 12)]


def test_pack_context_cuts_between_characters(spark):
    df = spark.createDataFrame([(1, "x" * 100), (2, "é" * 100), (3, "y")], "rank int, block string")
    out = {x.rank: x.block for x in r.pack_context(df, 201).collect()}
    assert out == {1: "x" * 100, 2: "é" * 50}
    assert {x.rank for x in r.pack_context(df, 150).collect()} == {1}


def test_similar_orders_by_cosine(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, None)], "id int, embedding array<float>")
    out = r.similar(df, [1.0, 0.0, 0.0], 0).collect()
    assert [x.id for x in out] == [1, 2] and abs(out[0].score - 1) < 1e-9


def test_an_unbounded_list_is_an_error(spark, monkeypatch):
    import pytest

    from sieveline.operators import ranking

    monkeypatch.setattr(ranking, "MAX_RESULTS", 5)
    rows = spark.range(6)
    with pytest.raises(Exception, match="result list of over 5 rows"):
        ranking.with_rank(rows, rows["id"]).collect()
    assert ranking.with_rank(rows.limit(5), rows["id"]).count() == 5
