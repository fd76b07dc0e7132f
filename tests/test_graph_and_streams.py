import datetime as dt
import random

from pyspark.sql import functions as F

from sieveline.operators import graph as g
from sieveline.operators import usage, writepath
from sieveline.streaming import continuous


def random_edges(seed, n=25, m=60):
    rng = random.Random(seed)
    return sorted({(f"n{rng.randrange(n):02}", f"n{rng.randrange(n):02}") for _ in range(m)})


def distances(edges, start, directed=True):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        if not directed:
            near.setdefault(b, set()).add(a)
    seen, front = {start: 0}, [start]
    while front:
        new = sorted({y for x in front for y in near.get(x, ()) if y not in seen})
        seen |= {y: seen[front[0]] + 1 for y in new}
        front = new
    return seen


def test_bfs_against_brute_force(spark):
    edges = random_edges(1)
    df = spark.createDataFrame(edges, "source_file string, target_file string")
    got = {r.path: r.depth for r in g.bfs(df, spark.createDataFrame([("n00",)], "path string"), 3).collect()}
    assert got == {k: d for k, d in distances(edges, "n00", directed=False).items() if 0 < d <= 3}


def test_shortest_path_has_least_length(spark):
    edges = random_edges(2)
    df = spark.createDataFrame([(a, b, "imports") for a, b in edges], "source string, target string, kind string")
    dist = distances(edges, "n00")
    goal = max((d, k) for k, d in dist.items())[1]
    way, _ = g.shortest_path(df, "n00", goal)
    assert len(way) - 1 == dist[goal] and all(e in edges for e in zip(way, way[1:]))
    assert g.shortest_path(df, "n00", "nowhere")[0] == []


def test_fixture_graph(spark):
    edges = [("auth/auth.go", "jwt/"), ("auth/auth.go", "log/"), ("gateway/gateway.go", "auth/"), ("gateway/gateway.go", "log/"), ("jwt/jwt.go", "log/")]
    df = spark.createDataFrame(edges, "source_file string, target_file string")
    got = {(r.path, r.kind) for r in g.callers(df, "jwt/jwt.go").collect()}
    assert got == {("auth/auth.go", "direct"), ("gateway/gateway.go", "transitive")}
    assert {r.path: r.depth for r in g.impact(df, "jwt/jwt.go").collect()} == {"auth/auth.go": 1, "gateway/gateway.go": 2}


def test_reversed_runtime_ranges_are_turned(spark):
    t = dt.datetime(2024, 1, 1)
    kinds = "k int, request_count long, error_count long, p95_latency_ms double, first_seen timestamp, last_seen timestamp"
    old = spark.createDataFrame([(1, 5, 0, 9.0, t, t)], kinds)
    new = spark.createDataFrame([(1, 2, 1, 3.0, t + dt.timedelta(2), t + dt.timedelta(1), 7), (1, -1, 0, 3.0, t, t, 8)], kinds + ", seq long")
    row = usage.merge_runtime_edges(old, new, ["k"]).first()
    assert (row.request_count, row.error_count, row.p95_latency_ms, row.last_seen) == (7, 1, 3.0, t + dt.timedelta(2))


def test_embedding_is_cached_and_round_trips(spark):
    inputs = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c")], "key int, text string")
    cache = spark.createDataFrame([], "input_hash string, model string, embedding array<float>")
    out, new = writepath.embed_missing(inputs, cache, "m")
    assert new.count() == 2 and out.where("embedding is null").count() == 0
    assert out.where(writepath.decode_vector(writepath.encode_vector(F.col("embedding"))) != F.col("embedding")).count() == 0


def test_streams(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    src, out, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
    kinds = "k int, request_count long, error_count long, p95_latency_ms double, first_seen timestamp, last_seen timestamp"
    for i in range(2):
        spark.createDataFrame([(1, 2, 0, float(i), t, t + dt.timedelta(i))], kinds).coalesce(1).write.mode("append").parquet(src)
    q = continuous.merge_edges_into(continuous.stream_table(spark, src, kinds), out, ["k"], check)
    q.awaitTermination(60)
    assert spark.read.parquet(out).where("v = 1").first().request_count == 4

    events = [(t, "a", "write"), (t + dt.timedelta(milliseconds=100), "a", "remove"), (t + dt.timedelta(seconds=3), "a", "write")]
    got = continuous.debounced(spark.createDataFrame(events, continuous.EVENT)).orderBy("ts").collect()
    assert [r.op for r in got] == ["remove", "write"]


def test_alerts(spark):
    rows = spark.createDataFrame([("q", "a", 1, 2), ("q", "b", 1, 2)], "query string, path string, start_line int, end_line int")
    none = spark.createDataFrame([], "query string, fingerprint string")
    first = continuous.changed_alerts(rows, none)
    assert first.count() == 1
    assert continuous.changed_alerts(rows.orderBy(F.desc("path")), first).count() == 0


def test_the_first_of_several_shortest_ways(spark):
    edges = [("s", x, "i") for x in "cab"] + [(x, y, "i") for x, y in ("bz", "az", "cy", "yg", "zg", "az", "ax")]
    df = spark.createDataFrame([*edges, ("q", "s", "i")], "source string, target string, kind string")
    assert g.shortest_path(df, "s", "g") == (["s", "a", "z", "g"], False)
    assert g.shortest_path(df, "s", "q") == (["s", "q"], False)
    assert g.shortest_path(df, "s", "q", undirected=False) == ([], False)
    assert g.shortest_path(df, "s", "g", max_nodes=1)[1]
    assert g.shortest_path(df, "s", "s") == (["s"], False)
