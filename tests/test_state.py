"""Routes with a failed leg, counters with a missing version, cut path searches, caches and scopes."""

import hashlib

import pytest
from pyspark.sql import functions as F

from sieveline.operators import graph, ranking, usage
from sieveline.streaming import continuous


def legs(spark):
    names = "path string, score double, rank int"
    return spark.createDataFrame([("a", 0.9, 1), ("b", 0.8, 2)], names), spark.createDataFrame([("b", 3.0, 1), ("c", 2.0, 2)], names)


def test_a_failed_leg_gives_a_labelled_route(spark):
    v, w = legs(spark)
    get = lambda a, b, k=5: [(r.path, r.route) for r in ranking.hybrid_route(a, b, k, keys=("path",)).orderBy("rank").collect()]
    assert get(v, w) == [("b", "hybrid"), ("a", "hybrid"), ("c", "hybrid")]
    assert get(v, None) == [("a", "vector"), ("b", "vector")] and get(None, w, 1) == [("b", "keyword")]
    assert get(v, w.limit(0)) == [("a", "hybrid"), ("b", "hybrid")]  # empty, but it didn't fail
    with pytest.raises(ValueError):
        ranking.hybrid_route(None, None, 5)


def test_a_missing_version_of_the_counters_fails(spark, tmp_path):
    schema = "source string, request_count long, error_count long, p95_latency_ms double, first_seen long, last_seen long"
    src, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))

    def batch(n):
        spark.createDataFrame([("s", n, 0, 1.0, n, n)], schema).write.mode("append").parquet(src)
        q = continuous.merge_edges_into(continuous.stream_table(spark, src, schema), out, ["source"], mark)
        q.awaitTermination()

    batch(1)
    batch(2)
    last = max(int(p.name[2:]) for p in (tmp_path / "out").iterdir() if p.name.startswith("v="))
    assert spark.read.parquet(f"{out}/v={last}").first().request_count == 3
    (tmp_path / "out" / f"v={last}").rename(tmp_path / "gone")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        batch(3)


def test_a_cut_path_search_says_so(spark):
    edges = [("s", f"m{i}", "imports") for i in range(5)] + [("m4", "t", "imports")]
    df = spark.createDataFrame(edges, "source string, target string, kind string")
    assert graph.shortest_path(df, "s", "t") == (["s", "m4", "t"], False)
    assert graph.shortest_path(df, "s", "t", undirected=False, max_nodes=2) == ([], True)


def test_fingerprint_is_that_of_the_sorted_rows(spark):
    rows = [(i % 3, f"p{i}") for i in range(500)]
    df = spark.createDataFrame(rows, "g int, path string")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()

    def slow(paths):
        parts = [(sha(p), sha(p)) for p in paths]
        for digits in usage.FINGERPRINT_LEVELS:
            held = {}
            for p, h in parts:
                held.setdefault(p[:digits], []).append((p, h))
            parts = [(k, sha("\n".join(h for _, h in sorted(v)))) for k, v in held.items()]
        return parts[0][1]

    got = {r.g: r.fingerprint for r in usage.fingerprint(df, ["path"], ["g"]).collect()}
    assert got == {g: slow([p for k, p in rows if k == g]) for g in range(3)}


def test_cache_and_scope(spark):
    names = "query string, at timestamp, answer int"
    t = lambda s: F.lit(f"2024-01-01 00:00:{s:02d}").cast("timestamp")
    rows = lambda *x: spark.createDataFrame([(q, None, a) for q, _, a in x], names).withColumn("at", F.element_at(F.array(*[t(s) for _, s, _ in x]), F.col("answer")))
    kept = ranking.cached_results(rows(("a", 9, 1), ("b", 5, 2)), rows(("a", 1, 1), ("c", 2, 2)), t(10), 8, 10)
    assert [r.query for r in kept.collect()] == ["a", "b"]
    data = spark.createDataFrame([(i, w) for i, w in enumerate("xyz")], "id int, workspace string")
    members = spark.createDataFrame([("x", "me"), ("y", "you")], "workspace string, user string")
    none = spark.createDataFrame([], "user string, workspace string")
    assert {r.workspace for r in usage.in_scope(data, members, none, "me").collect()} == {"x", "z"}
    assert {r.workspace for r in usage.in_scope(data, members, none.union(spark.createDataFrame([("me", "z")], "user string, workspace string")), "me").collect()} == {"z"}
