"""an index is built of each row's own words without an exchange, unless keys repeat."""

from pyspark.sql import functions as F

from sieveline.operators import positional


def _held(index):
    return {(r.term, r.key): list(r.places) for r in index.collect()}


def test_places_without_an_exchange(spark, monkeypatch):
    monkeypatch.setattr(positional, "SLICE_WORDS", 7)
    texts = [(1, "a b a c"), (2, None), (3, ""), (4, "x " * 40 + "y"), (None, "b b"), (5, "É a, b")]
    df = spark.createDataFrame(texts, "id long, content string").repartition(3)
    index = positional.build(df)
    assert "Exchange hashpartitioning(term" not in index._jdf.queryExecution().toString() and "Exchange hashpartitioning(key" not in index._jdf.queryExecution().toString()
    want = {("a", 1): [1, 3], ("b", 1): [2], ("c", 1): [4], ("x", 4): [*range(1, 41)], ("y", 4): [41], ("b", None): [1, 2], ("e", 5): [1], ("a", 5): [2], ("b", 5): [3]}
    assert _held(index) == want == _held(positional.build(df, terms=["a", "b", "c", "x", "y", "e"]))


def test_repeated_keys_are_put_together(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "b a a"), (None, "c"), (None, "c c")], "id long, content string").repartition(4)
    assert _held(positional.build(df)) == {("a", 1): [1, 2, 3], ("b", 1): [1, 2], ("c", None): [1, 1, 2]}
    assert positional.build(df.where(F.lit(False))).count() == 0
