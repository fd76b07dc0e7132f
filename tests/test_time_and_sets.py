"""As-of joins, frames, multisets, skewed joins, sketches, medians: odd rows, brute force, and how work is spread."""

import datetime as dt
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sieveline.operators import medians, multiset, sketches, skew, temporal

START = dt.datetime(2024, 1, 1)


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


@pytest.fixture(scope="module")
def sides():
    rng = random.Random(1)
    left = [(i, rng.choice(["a", "b", "hot", None]), at(rng.randrange(40) * 50) if rng.random() > 0.05 else None) for i in range(300)]
    right = [(i, rng.choice(["a", "hot", "hot", None]), at(rng.randrange(40) * 50) if rng.random() > 0.05 else None, rng.random()) for i in range(200)]
    return left, right


@pytest.mark.parametrize("strict", [True, False])
@pytest.mark.parametrize("width", [60, 500, 100_000])
def test_asof_join_is_brute_force(spark, sides, strict, width):
    left, right = sides
    a, b = spark.createDataFrame(left, "id long, k string, ts timestamp"), spark.createDataFrame(right, "rid long, k string, ts timestamp, v double")
    got = {r.id: (r.rid_asof, r.v_asof) for r in temporal.asof_join(a, b, ["k"], "ts", ["rid", "v"], tie="rid", strict=strict, width=width).collect()}
    want = {}
    for i, k, ts in left:
        fit = [(r[2], r[0], r[3]) for r in right if k is not None and ts is not None and r[1] == k and r[2] is not None and (r[2] < ts or (not strict and r[2] == ts))]
        want[i] = max(fit)[1:] if fit else (None, None)
    assert got == want


def test_asof_join_of_nothing(spark, sides):
    left, right = sides
    a, b = spark.createDataFrame(left, "id long, k string, ts timestamp"), spark.createDataFrame(right, "rid long, k string, ts timestamp, v double")
    assert temporal.asof_join(a.where("false"), b, ["k"], "ts", ["v"], tie="rid").count() == 0
    assert temporal.asof_join(a, b.where("false"), ["k"], "ts", ["v"], tie="rid").where("v_asof is null").count() == 300


def test_asof_join_has_no_range_join_and_splits_a_hot_key(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("user_id", F.lit(1))
    width = temporal.bucket_width(e, ["user_id"], "ts", most=100)
    cells = e.groupBy("user_id", temporal.bucket("ts", width)).count()
    assert cells.agg(F.max("count")).first()[0] < 300 < e.count()
    plan = temporal.asof_join(e, e, ["user_id"], "ts", ["event_id"], tie="event_id", width=width)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_frames_and_bursts(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice("ab"), at(rng.randrange(3000)), rng.randrange(9)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, k string, ts timestamp, v long")
    for width in (100, 1000):
        got = {r.id: (r.n, r.s) for r in temporal.time_frame(df, ["k"], "ts", 100, {"n": F.count("*"), "s": F.sum("v")}, width=width).collect()}
        want = {}
        for i, k, ts, _ in rows:
            fit = [r[3] for r in rows if r[1] == k and dt.timedelta(0) <= ts - r[2] <= dt.timedelta(seconds=100)]
            want[i] = (len(fit), sum(fit))
        assert got == want
    by = defaultdict(list)
    for i, k, ts, _ in rows:
        by[k].append(ts)
    want = []
    for k, times in by.items():
        run = []
        for ts in sorted(times) + [None]:
            if run and (ts is None or ts - run[-1] > dt.timedelta(seconds=20)):
                want.append((k, run[0], run[-1], len(run)))
                run = []
            run.append(ts)
    assert sorted(tuple(r) for r in temporal.bursts(df, ["k"], "ts", "id", 20, width=64).collect()) == sorted(want)


def test_multisets_count_repeats(spark):
    a, b = [("x", 1)] * 5 + [("y", None)] * 2 + [(None, None)], [("x", 1)] * 2 + [("y", None)] * 3 + [("z", 0)]
    left, right = spark.createDataFrame(a, "p string, n int"), spark.createDataFrame(b, "p string, n int")
    for got, want in (
        (multiset.except_all(left, right), Counter(a) - Counter(b)), (multiset.except_all(right, left), Counter(b) - Counter(a)),
        (multiset.intersect_all(left, right), Counter(a) & Counter(b)), (multiset.union_max(left, right), Counter(a) | Counter(b)),
    ):
        assert Counter(tuple(r) for r in got.collect()) == want
    assert sorted(map(str, multiset.changes(left, right).collect())) == sorted(
        ["Row(p='x', n=1, change='removed', times=3)", "Row(p='y', n=None, change='added', times=1)", "Row(p=None, n=None, change='removed', times=1)", "Row(p='z', n=0, change='added', times=1)"]
    )
    plan = multiset.except_all(left, right)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_a_hot_key_is_spread_and_the_result_is_the_plain_join(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.when(F.col("l_linenumber") >= 3, 7).otherwise(F.col("l_suppkey")).cast("long").alias("k"), F.col("l_orderkey").alias("o"))
    orders = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_custkey").cast("long").alias("k"), "o_orderkey")
    n = 16
    joined, choice = skew.adaptive_join(li, orders, ["k"], partitions=n, broadcast_bytes=0)
    assert choice.way == "salted"
    plain = li.join(orders, "k").groupBy("k").agg(F.count("*").alias("n"), F.sum(F.xxhash64("o", "o_orderkey") % 1000).alias("h"))
    assert sorted(joined.groupBy("k").agg(F.count("*").alias("n"), F.sum(F.xxhash64("o", "o_orderkey") % 1000).alias("h")).collect()) == sorted(plain.collect())
    hot = li.where("k = 7").count()
    assert hot > li.count() / 2
    parts = [r.n for r in skew.dealt_rows(li, ["k"], choice.heavy, n).collect()]
    assert max(parts) < hot / 2 and len(parts) > n / 3
    assert skew.adaptive_join(li, orders, ["k"], partitions=n)[1].way == "broadcast right"


def test_skewed_joins_with_nulls_repeats_and_two_hot_sides(spark):
    rng = random.Random(4)
    a = [(rng.choice([1, 1, 1, 2, 3, None]), "s", i % 3) for i in range(200)]
    b = [(rng.choice([1, 2, 2, 2, 4, None]), "s", i % 2) for i in range(150)]
    left, right = spark.createDataFrame(a, "k int, t string, x int"), spark.createDataFrame(b, "k int, t string, y int")
    got, choice = skew.adaptive_join(left, right, ["k", "t"], partitions=8, broadcast_bytes=0)
    assert choice.way == "salted"
    want = Counter((k, t, x, y) for k, t, x in a for q, u, y in b if k is not None and (k, t) == (q, u))
    assert Counter((r.k, r.t, r.x, r.y) for r in got.collect()) == want
    assert skew.adaptive_join(left.where("false"), right, ["k", "t"], broadcast_bytes=0)[0].count() == 0


def test_sketches_merge_to_the_days_without_the_rows(spark, tmp_path):
    rows = spark.range(60_000).select((F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 7)).alias("ts"), F.pmod(F.xxhash64("id"), F.lit(9000)).alias("user"), (F.pmod(F.xxhash64("id", F.lit(2)), F.lit(10_007)) / 7.0).alias("v"), F.lit("x").alias("kind"))
    path = str(tmp_path / "rollup")
    for _ in range(2):  # writing a day again replaces it
        sketches.append_hours(rows, path, ["kind"], ts="ts", distinct="user", value="v")
    rollup = spark.read.parquet(path)
    days = sketches.estimates(sketches.merged(rollup, [F.col("day")]), {"p50": 0.5, "p99": 0.99})
    exact = rows.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.count_distinct("user").alias("users"))
    for r in days.join(exact.withColumnRenamed("n", "m"), "day").collect():
        assert r.n == r.m and abs(r.distinct_count - r.users) <= 0.06 * r.users
    error = sketches.rank_error(rows.withColumn("day", F.to_date("ts")), ["day"], "v", days, "p50", 0.5)
    assert error.agg(F.max("error")).first()[0] <= 0.035
    assert days.count() == rollup.select("day").distinct().count() == exact.count()


def test_weighted_medians_are_exact(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), rng.choice([rng.random(), rng.randrange(5)]), rng.choice([1.0, 2.5, 0.0, -1.0, None, 7])) for _ in range(6000)]
    rows += [("one", 3.0, 1.0), ("nulls", None, 1.0), ("nan", float("nan"), 1.0), ("heavy", 1.0, 1e9), ("heavy", 2.0, 1.0), ("heavy", 0.0, 1.0)]
    df = spark.createDataFrame([(k, v if v is None else float(v), w if w is None else float(w), 0) for k, v, w in rows], "k string, v double, w double, key int").repartition(6)
    want = {}
    held = defaultdict(list)
    for k, v, w in rows:
        if v is not None and v == v and w is not None and w > 0:
            held[k].append((v, w))
    for k, pairs in held.items():
        total, run = sum(w for _, w in pairs), 0.0
        for v, w in sorted(pairs):
            run += w
            if run >= total / 2:
                want[k] = v
                break
    for cells in (4, 64):
        got = {r.k: r.median for r in medians.weighted_median(df, ["k"], "v", "w", cells=cells).collect()}
        assert got == want
    assert medians.weighted_median(df.where("false"), ["k"], "v", "w").count() == 0


def test_partial_states_are_bounded(spark):
    rows = spark.range(50_000).select(F.lit("hot").alias("key"), F.rand(1).alias("value"), F.lit(1.0).alias("weight")).repartition(5)
    parts = medians.states(rows, 16)
    assert parts.count() <= 5 * 16
    assert medians.merge(parts, 16).count() <= 16


def test_rows_are_numbered_over_ranges(spark):
    from sieveline.operators import numbering

    rng = random.Random(9)
    rows = [(i, rng.choice([None, *range(20)])) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, v int").repartition(7)
    got = {r.id: r.number for r in numbering.numbered(df, ["v", "id"], partitions=9).collect()}
    assert got == {i: n for n, (i, _) in enumerate(sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0])), 1)}
    assert numbering.numbered(df.where("false"), ["v"]).count() == 0
    members = Counter(r.member for r in numbering.round_robin(df, ["v", "id"], 3).collect())
    assert members == {0: 167, 1: 167, 2: 166}


def test_providers_are_asked_in_order(spark):
    from sieveline.operators import writepath

    rows = [(1, "a", 1, False, 5.0, False, False), (1, "b", 2, True, 500.0, False, False), (1, "c", 3, True, 5.0, False, False), (1, "d", 4, True, 5.0, True, False), (2, "a", 1, True, 5.0, False, True), (2, "l", 2, True, 5.0, True, True), (3, "a", 1, True, 5.0, False, True)]
    got = {r.key: tuple(r)[1:] for r in writepath.provider_choice(spark.createDataFrame(rows, "key int, provider string, place int, ok boolean, ms double, local boolean, sensitive boolean"), 100).collect()}
    assert got == {1: ("c", 3, 1, 0), 2: ("l", 1, 0, 1), 3: (None, 0, 0, 1)}
