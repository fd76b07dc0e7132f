"""Stream-stream joins, sliding windows, timers and the commit log: streams against their batch forms."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sieveline.operators.lineage import shared_folder
from sieveline.sources import commit_log
from sieveline.streaming import pairing, sliding, timers

START = dt.datetime(2024, 1, 1)


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def put(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_requests_meet_responses_and_late_ones_are_counted(spark, tmp_path):
    shared_folder(spark)
    rng = random.Random(1)
    requests = [(i, rng.randrange(5), at(rng.randrange(3600) + 3600 * (i // 50))) for i in range(150)]
    responses = [(i, rng.randrange(5), at(rng.randrange(3600) + 3600 * (i // 50))) for i in range(150)]
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    for k in range(3):
        put(spark, requests[50 * k : 50 * k + 50], pairing.REQUEST, a)
        put(spark, responses[50 * k : 50 * k + 50], pairing.RESPONSE, b)
    bounds = {"within": "10 minutes", "watermark": "70 minutes"}
    far = at(10**6)

    def go():
        q = pairing.run_pairing(*(pairing.file_stream(spark, p, s, 1) for p, s in ((a, pairing.REQUEST), (b, pairing.RESPONSE))), str(tmp_path / "out"), str(tmp_path / "check"), **bounds)
        q.awaitTermination()
        return q

    go()
    put(spark, [(-1, -1, far)], pairing.REQUEST, a)
    put(spark, [(-1, -1, far)], pairing.RESPONSE, b)
    q = go()  # goes on from the checkpoint; the far rows close all that is open
    assert pairing.late_rows(q) == 0
    put(spark, [(-5, 1, at(5))], pairing.REQUEST, a)  # a week late
    put(spark, [(-6, 1, at(6)), (-7, 1, at(7))], pairing.RESPONSE, b)
    q = go()
    assert pairing.late_rows(q) == 3
    got = spark.read.schema("request_id long, key long, sent timestamp, response_id long, answered timestamp").parquet(str(tmp_path / "out")).where("request_id >= 0")
    want = pairing.paired(spark.createDataFrame(requests, pairing.REQUEST), spark.createDataFrame(responses, pairing.RESPONSE), **bounds)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert want.where("response_id is null").count() > 0 and want.where("response_id is not null").count() > 20


def test_sliding_windows_final_and_provisional(spark, tmp_path):
    shared_folder(spark)
    schema, path, folder = "ts timestamp, kind string, value long", str(tmp_path / "in"), str(tmp_path / "out")
    rng = random.Random(2)
    early, late = [(at(rng.randrange(7200)), rng.choice("ab"), i) for i in range(60)], [(at(7200 + rng.randrange(7200)), rng.choice("ab"), i) for i in range(60)]
    put(spark, early, schema, path)
    put(spark, late, schema, path)
    report = sliding.run_sliding(pairing.file_stream(spark, path, schema, 1), ["kind"], folder)
    state = sliding.state(spark, folder, ["kind"])
    key = lambda r: (r.started, r.ended, r.kind)
    whole = {key(r): (r.n, r.total) for r in sliding.sliding_counts(spark.createDataFrame(early + late, schema), ["kind"]).collect()}
    assert report.late == 0 and {key(r): (r.n, r.total) for r in state.collect()} == whole
    assert {r.status for r in state.select("status").collect()} == {"final", "provisional"}
    put(spark, [(at(10), "a", 1)] * 4, schema, path)  # behind the watermark
    put(spark, [(at(10**6), "close", 0)], schema, path)
    report = sliding.run_sliding(pairing.file_stream(spark, path, schema, 1), ["kind"], folder)
    final = spark.read.parquet(f"{folder}/final").where("kind <> 'close'")
    assert {key(r): (r.n, r.total) for r in final.collect()} == whole
    assert report.late > 0


JOB = "key long, at timestamp, kind string, seq long"


def simulate(rows, step, span_ms, attempts, end_ms):
    """The same machine over each key's whole history, then whatever runs out."""
    out, keys = [], {}
    for key, when, kind, seq in rows:
        keys.setdefault(key, []).append((round((when - START).total_seconds() * 1000) + int(START.replace(tzinfo=dt.timezone.utc).timestamp() * 1000), seq, kind))
    for key, held in keys.items():
        state = None
        for ms, _, kind in sorted(held):
            state, new = step(state, ms, kind, span_ms, attempts)
            out += [(key, *n) for n in new]
        while state and state[2] and state[2] <= end_ms:
            state, new = step(state, state[2], None, span_ms, attempts)
            out += [(key, *n) for n in new]
    return sorted(out, key=str)


def run_machine(spark, path, out, plan):
    plan(pairing.file_stream(timers.with_rocksdb(spark), path, JOB, 1)).writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/check").trigger(availableNow=True).start().awaitTermination()


def changes(spark, out):
    return sorted(((r.key, round(r.ms), r.change, r.attempt) for r in spark.read.schema(timers.CHANGE).parquet(f"{out}/rows").select("key", F.unix_millis("at").alias("ms"), "change", "attempt").collect()), key=str)


@pytest.mark.parametrize("kinds, plan, step, span, attempts", [
    (["enqueue", "claim", "claim", "heartbeat", "fail", "done"], lambda s: timers.job_leases(s, lease_seconds=200, attempts=2, watermark="1 second"), timers.step_job, 200_000, 2),
    (["put", "put", "put", "drop"], lambda s: timers.cache_entries(s, ttl_seconds=150, watermark="1 second"), timers.step_entry, 150_000, 0),
])
def test_machines_go_on_after_a_restart(spark, tmp_path, kinds, plan, step, span, attempts):
    shared_folder(spark)
    rng = random.Random(3)
    rows = [(rng.randrange(8), at(12 * i), rng.choice(kinds), i) for i in range(240)]
    close = (99, at(10**6), "heartbeat", 10**6)
    path, once, twice = str(tmp_path / "in"), str(tmp_path / "once"), str(tmp_path / "twice")
    for k in range(2):
        put(spark, rows[60 * k : 60 * k + 60], JOB, path)
    run_machine(spark, path, twice, plan)  # stops here; the next run has only the checkpoint
    for k in range(2, 4):
        put(spark, rows[60 * k : 60 * k + 60], JOB, path)
    put(spark, [close], JOB, path)
    run_machine(spark, path, twice, plan)
    run_machine(spark, path, once, plan)
    end = int(at(10**6).replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    want = simulate(rows, step, span, attempts, end)
    assert changes(spark, once) == changes(spark, twice) == want
    assert {"expired"} <= {c for _, _, c, _ in want}


def test_machine_steps():
    lease = timers.step_job(None, 0, "enqueue", 100, 1)[0]
    running, out = timers.step_job(lease, 5, "claim", 100, 1)
    assert running == ("running", 1, 105, 5) and out == [(5, "running", 1)]
    assert timers.step_job(running, 3, "done", 100, 1)[1] == [(3, "late", 1)]
    assert timers.step_job(running, 300, "heartbeat", 100, 1) == (None, [(105, "expired", 1), (105, "dead", 1)])
    assert timers.step_job(running, 105, None, 100, 2)[0][0] == "queued"
    live, out = timers.step_entry(None, 7, "put", 10, 0)
    assert out == [(7, "stored", 1)] and timers.step_entry(live, 17, "put", 10, 0)[1] == [(17, "expired", 1), (17, "stored", 1)]


@pytest.fixture
def log(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(commit_log, "RUN", 50)
    rows = [(i, f"c{i}", None if i % 9 == 0 else f"é{i}", at(60 * i + 0.25), f"subject {i}", f"+a\ncommit x 1\n\n-b{i}\n" if i % 2 else None) for i in range(430)]
    folder = str(tmp_path / "log")
    df = spark.createDataFrame(rows, commit_log.SCHEMA)
    assert commit_log.write_log(df.where("seq < 300"), folder, 3) == 3
    return commit_log.register(spark), folder, df


def same(a, b):
    return sorted(map(str, a.na.fill("").collect())) == sorted(map(str, b.na.fill("").collect()))


def test_the_log_reads_what_was_written(log):
    spark, folder, df = log
    whole = spark.read.format("commit_log").load(folder)
    pushing = lambda text: spark.read.format("commit_log").option("pushdown", "true").load(folder).where(text)
    assert same(whole, df.where("seq < 300"))
    for text in ("seq >= 250", "seq > 40 and seq < 60", "seq = 7", "seq <= 3 and author = 'é2'", "seq between 100 and 149", "seq = 900"):
        want = df.where("seq < 300").where(text)
        assert same(whole.where(text), want) and same(pushing(text), want), text
    assert commit_log.runs_read(whole) >= 6 > 1 == commit_log.runs_read(pushing("seq = 7"))
    since = at(60 * 280)
    late = commit_log.read_log(spark, folder, since=since)
    assert same(late, df.where("seq < 300").where(F.col("committed") >= F.lit(since))) and commit_log.runs_read(late) < commit_log.runs_read(whole)
    assert same(commit_log.read_log(spark, folder, first=20, last=130, until=at(60 * 99 + 1)), df.where("seq between 20 and 99"))
    assert spark.read.format("commit_log").load(folder + "-none").count() == 0


def test_the_stream_reads_a_growing_log_once(log, tmp_path):
    spark, folder, df = log
    shared_folder(spark)

    def go():
        stream = spark.readStream.format("commit_log").load(folder)
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(commit_log.SCHEMA).parquet(str(tmp_path / "out"))

    assert same(go(), df.where("seq < 300"))
    commit_log.write_log(df.where("seq >= 300"), folder, 2)
    assert same(go(), df) and same(spark.read.format("commit_log").load(folder), df)


def test_a_damaged_log_is_an_error():
    with pytest.raises(ValueError, match="damaged entry in s.log"):
        list(commit_log.parse("commit abc 3\nno author\n", "s.log"))
