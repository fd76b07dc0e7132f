from sieveline.operators import evaluation as v


def metrics(spark, qrels, ranked, k):
    run = spark.createDataFrame([("q", f, i + 1) for i, f in enumerate(ranked)], "qid string, file string, rank int")
    return v.metrics(run, spark.createDataFrame([("q", f, g) for f, g in qrels], "qid string, file string, grade int"), k).first()


def test_repeats_use_up_ranks(spark):
    m = metrics(spark, [("auth.go", 3), ("middleware.go", 2)], ["noise", "auth.go", "auth.go", "middleware.go"], 4)
    assert m.mrr == 0.5 and m.recall == 1 and 0 < m.ndcg < 1
    m = metrics(spark, [("a.go", 1), ("b.go", 1)], ["a.go", "a.go", "noise", "b.go"], 2)
    assert m.precision == 0.5
    assert metrics(spark, [("a.go", 1), ("b.go", 1)], ["a.go", "a.go", "noise", "b.go"], 4).recall == 1


def test_empty_and_perfect(spark):
    m = metrics(spark, [("a.go", 3)], [], 10)
    assert (m.ndcg, m.mrr, m.precision, m.recall) == (0, 0, 0, 0)
    assert metrics(spark, [("a.go", 3)], ["a.go"], 10).ndcg == 1


def test_promotion_never_lowers_ndcg(spark):
    before = 0.0
    for place in range(19, -1, -4):
        ranked = [f"n{i}" for i in range(20)]
        ranked[place] = "a.go"
        now = metrics(spark, [("a.go", 2)], ranked, 20).ndcg
        assert now >= before
        before = now
