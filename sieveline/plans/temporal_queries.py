"""Joins and frames over time, multisets, skewed joins, sketches, medians, inverted lists and places, streams and logs (§2.15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ann, medians, multiset, positional, ranking, sketches, skew, temporal
from ..operators.lineage import cut, fresh_path
from ..sources import commit_log
from ..streaming import pairing, sliding, timers
from .registry import query

_CENTS_SQL = "CAST(round(value * 100) AS BIGINT)"


def _cents():
    return F.round(F.col("value") * 100).cast("long")


@query("X1_asof_previous", """WITH r AS (SELECT user_id, event_type, ts, max(event_id) AS event_id FROM events GROUP BY ALL)
 SELECT e.event_id, coalesce(r.event_id, -1) AS previous_id, v.value AS previous_value FROM events e ASOF LEFT JOIN r ON e.user_id = r.user_id AND e.event_type = r.event_type AND e.ts > r.ts LEFT JOIN events v ON v.event_id = r.event_id""")
def _(spark, t):
    found = temporal.asof_join(t("events"), t("events"), ["user_id", "event_type"], "ts", ["event_id", "value"], tie="event_id")
    return found.select("event_id", F.coalesce("event_id_asof", F.lit(-1)).alias("previous_id"), F.col("value_asof").alias("previous_value"))


@query("X1_asof_orders", """WITH o AS (SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL), e AS (SELECT event_id, user_id, CAST(ts AS DATE) - INTERVAL 9000 DAY AS d FROM events)
 SELECT e.event_id, coalesce(o.o_orderkey, -1) AS order_id FROM e ASOF LEFT JOIN o ON e.user_id = o.o_custkey AND e.d >= o.o_orderdate""")
def _(spark, t):
    """The customer's last order up to a day that lies among the orders."""
    e = t("events").select("event_id", F.col("user_id").alias("o_custkey"), F.date_sub(F.to_date("ts"), 9000).cast("timestamp").alias("day"))
    o = t("orders").select("o_custkey", F.col("o_orderdate").cast("timestamp").alias("day"), "o_orderkey")
    return temporal.asof_join(e, o, ["o_custkey"], "day", ["o_orderkey"], tie="o_orderkey", strict=False).select("event_id", F.coalesce("o_orderkey_asof", F.lit(-1)).alias("order_id"))


@query("X9_week_frames", f"""SELECT event_id, count(*) OVER w AS n_week, CAST(sum({_CENTS_SQL}) OVER w AS BIGINT) AS cents_week, max({_CENTS_SQL}) OVER w AS top_week
 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND CURRENT ROW)""")
def _(spark, t):
    e = t("events").select("event_id", "user_id", "ts", _cents().alias("cents"))
    framed = temporal.time_frame(e, ["user_id"], "ts", 7 * 86_400, {"n_week": F.count("*"), "cents_week": F.sum("cents"), "top_week": F.max("cents")})
    return framed.select("event_id", "n_week", "cents_week", "top_week")


@query("X9_bursts", """WITH l AS (SELECT user_id, event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events),
 b AS (SELECT *, sum(CASE WHEN p IS NULL OR epoch_us(ts) - epoch_us(p) > 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM l)
 SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM b GROUP BY user_id, run""")
def _(spark, t):
    return temporal.bursts(t("events"), ["user_id"], "ts", "event_id", 6 * 3600)


_OPEN, _SHUT = ("SELECT l_suppkey, l_linenumber, l_returnflag FROM lineitem WHERE l_linestatus = '%s'" % x for x in "OF")


def _manifests(t):
    """Two manifests in which most rows occur several times."""
    rows = t("lineitem").select("l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus")
    return (rows.where(F.col("l_linestatus") == x).drop("l_linestatus") for x in "OF")


@query("X10_except_all", f"SELECT l_suppkey, l_linenumber FROM ({_OPEN.replace(', l_returnflag', '')} EXCEPT ALL {_SHUT.replace(', l_returnflag', '')})")
def _(spark, t):
    a, b = _manifests(t)
    return multiset.except_all(a.drop("l_returnflag"), b.drop("l_returnflag"))


@query("X10_intersect_all", f"SELECT l_suppkey, l_linenumber FROM ({_OPEN.replace(', l_returnflag', '')} INTERSECT ALL {_SHUT.replace(', l_returnflag', '')})")
def _(spark, t):
    a, b = _manifests(t)
    return multiset.intersect_all(a.drop("l_returnflag"), b.drop("l_returnflag"))


@query("X10_changes", f"""WITH a AS ({_OPEN}), b AS ({_SHUT}), c AS (SELECT l_suppkey, l_linenumber, l_returnflag, count(*) AS n FROM b GROUP BY ALL UNION ALL SELECT l_suppkey, l_linenumber, l_returnflag, -count(*) FROM a GROUP BY ALL),
 s AS (SELECT l_suppkey, l_linenumber, l_returnflag, CAST(sum(n) AS BIGINT) AS d FROM c GROUP BY ALL) SELECT l_suppkey, l_linenumber, l_returnflag, CASE WHEN d > 0 THEN 'added' ELSE 'removed' END AS change, abs(d) AS times FROM s WHERE d <> 0""")
def _(spark, t):
    return multiset.changes(*_manifests(t))


@query("X7_skewed_join", """WITH l AS (SELECT CASE WHEN l_linenumber >= 3 THEN 7 ELSE l_suppkey END AS k, CAST(l_quantity AS BIGINT) AS q FROM lineitem)
 SELECT k, count(*) AS n, CAST(sum(q) AS BIGINT) AS quantity, count(DISTINCT o_orderkey) AS orders FROM l JOIN orders ON o_custkey = k GROUP BY k""")
def _(spark, t):
    """One key holds over half of lineitem; it meets all orders of that customer."""
    left = t("lineitem").select(F.when(F.col("l_linenumber") >= 3, F.lit(7).cast("long")).otherwise(F.col("l_suppkey").cast("long")).alias("k"), F.col("l_quantity").cast("long").alias("q"))
    right = t("orders").select(F.col("o_custkey").cast("long").alias("k"), "o_orderkey")
    joined, _ = skew.adaptive_join(left, right, ["k"], broadcast_bytes=1 << 14)
    return joined.groupBy("k").agg(F.count("*").alias("n"), F.sum("q").alias("quantity"), F.count_distinct("o_orderkey").alias("orders"))


@query("X6_sketch_days", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, true AS distinct_within, true AS median_within, true AS p95_within FROM events GROUP BY ALL")
def _(spark, t):
    """Hourly sketches merged into days; how far they are from exact results."""
    e = t("events").select("ts", "event_type", "user_id", "value")
    days = sketches.merged(cut(sketches.hourly(e, ["event_type"], ts="ts", distinct="user_id", value="value")), [F.date_format("hour", "yyyy-MM-dd").alias("day"), F.col("event_type")])
    return _within(e.withColumn("day", F.date_format("ts", "yyyy-MM-dd")), ["day", "event_type"], "user_id", "value", days).select("day", "event_type", "n", "distinct_within", "median_within", "p95_within")


@query("X6_sketch_years", "SELECT year(l_shipdate) AS year, l_returnflag, count(*) AS n, true AS distinct_within, true AS median_within, true AS p95_within FROM lineitem GROUP BY ALL")
def _(spark, t):
    li = t("lineitem").select("l_shipdate", "l_returnflag", "l_partkey", "l_extendedprice")
    months = cut(sketches.hourly(li, ["l_returnflag"], ts="l_shipdate", distinct="l_partkey", value="l_extendedprice", width="month"))
    years = sketches.merged(months, [F.year("month").cast("long").alias("year"), F.col("l_returnflag")])
    return _within(li.withColumn("year", F.year("l_shipdate").cast("long")), ["year", "l_returnflag"], "l_partkey", "l_extendedprice", years).select("year", "l_returnflag", "n", "distinct_within", "median_within", "p95_within")


def _within(rows, by, distinct, value, rollup):
    """Estimates beside exact results: distinct counts within 6 %, ranks within 0.035."""
    found = cut(sketches.estimates(rollup, {"p50": 0.5, "p95": 0.95}))
    exact = rows.groupBy(*by).agg(F.count_distinct(distinct).alias("exact"))
    near = F.abs(F.col("distinct_count") - F.col("exact")) <= F.greatest(F.lit(1.0), 0.06 * F.col("exact"))
    out = found.join(exact, by).withColumn("distinct_within", near)
    for name, column, rank in (("median_within", "p50", 0.5), ("p95_within", "p95", 0.95)):
        error = sketches.rank_error(rows, by, value, found, column, rank)
        out = out.join(error.select(*by, (F.col("error") <= 0.035).alias(name)), by)
    return out


@query("X12_weighted_median", """WITH c AS (SELECT l_suppkey AS project, l_extendedprice AS v, sum(l_quantity) AS w FROM lineitem GROUP BY ALL), r AS (SELECT project, v, sum(w) OVER (PARTITION BY project ORDER BY v) AS c, sum(w) OVER (PARTITION BY project) AS t FROM c)
 SELECT project, min(v) AS median, any_value(t) AS total_weight FROM r WHERE c >= t / 2 GROUP BY project""")
def _(spark, t):
    return medians.weighted_median(t("lineitem").withColumnRenamed("l_suppkey", "project"), ["project"], "l_extendedprice", "l_quantity")


@query("X12_hot_median", """WITH c AS (SELECT l_returnflag AS project, l_extendedprice AS v, sum(l_quantity) AS w FROM lineitem GROUP BY ALL), r AS (SELECT project, v, sum(w) OVER (PARTITION BY project ORDER BY v) AS c, sum(w) OVER (PARTITION BY project) AS t FROM c)
 SELECT project, min(v) AS median, any_value(t) AS total_weight FROM r WHERE c >= t / 2 GROUP BY project""")
def _(spark, t):
    """Three keys hold all of lineitem."""
    return medians.weighted_median(t("lineitem").withColumnRenamed("l_returnflag", "project"), ["project"], "l_extendedprice", "l_quantity")


_TOK = """tok AS (SELECT doc_id, list_filter(string_split_regex(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS ts FROM documents),
 p AS (SELECT doc_id, unnest(ts) AS term, generate_subscripts(ts, 1) AS pos FROM tok)"""
_COVERS = f"""{_TOK}, h AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS nth FROM p WHERE term IN ('the', 'and', 'of')),
 l AS (SELECT doc_id, pos, nth, max(CASE WHEN term = 'the' THEN pos END) OVER w AS a, max(CASE WHEN term = 'and' THEN pos END) OVER w AS b, max(CASE WHEN term = 'of' THEN pos END) OVER w AS c FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
 c AS (SELECT doc_id, least(a, b, c) AS s, min(pos) AS e, min(nth) AS nth FROM l WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL GROUP BY 1, 2)"""


def _index(spark, t, terms):
    """The documents' positional index, written by term and read for these terms."""
    path = fresh_path(spark, "places")
    positional.write(positional.build(t("documents"), text="text", key="doc_id"), path)
    return positional.read(spark, path, terms)


@query("X3_cover_density", f"WITH {_COVERS} SELECT c.doc_id AS key, count(*) AS covers, min(e - s + 1) AS shortest, round(sum(0.1 / (1 + (e - s) - (c.nth - h.nth))), 6) AS rank FROM c JOIN h ON h.doc_id = c.doc_id AND h.pos = c.s GROUP BY 1")
def _(spark, t):
    terms = ["the", "and", "of"]
    return positional.cover_rank(_index(spark, t, terms), terms).select("key", F.col("covers").cast("long").alias("covers"), F.col("shortest").cast("long").alias("shortest"), F.round("rank", 6).alias("rank"))


@query("W5_keyword_rank", f"""WITH {_TOK}, h AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS nth FROM p WHERE term IN ('the', 'of')),
 l AS (SELECT doc_id, pos, nth, max(CASE WHEN term = 'the' THEN pos END) OVER w AS a, max(CASE WHEN term = 'of' THEN pos END) OVER w AS b FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
 c AS (SELECT doc_id, least(a, b) AS s, min(pos) AS e, min(nth) AS nth FROM l WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1, 2),
 r AS (SELECT c.doc_id, sum(0.1 / (1 + (e - s) - (c.nth - h.nth))) AS rank FROM c JOIN h ON h.doc_id = c.doc_id AND h.pos = c.s GROUP BY 1),
 k AS (SELECT doc_id, CASE WHEN text ILIKE '%the%' THEN 1 ELSE 0 END + CASE WHEN text ILIKE '%of%' THEN 1 ELSE 0 END AS held FROM documents)
 SELECT doc_id, round(held + CASE WHEN held = 2 THEN coalesce(rank, 0) ELSE 0 END, 6) AS score FROM k LEFT JOIN r USING (doc_id) WHERE held > 0 ORDER BY score DESC, doc_id LIMIT 30""")
def _(spark, t):
    return positional.keyword_rank(t("documents"), ["the", "of"], 30, text="text", key="doc_id")


@query("X3_phrase", f"WITH {_TOK} SELECT a.doc_id AS key, a.pos AS place FROM p a JOIN p b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term = 'of' AND b.term = 'the'")
def _(spark, t):
    return positional.phrase(_index(spark, t, ["of", "the"]), ["of", "the"]).select("key", F.explode("places").alias("place")).withColumn("place", F.col("place").cast("long"))


def _ivf(spark, t):
    e = t("embeddings")
    dims = e.select(F.size("embedding").alias("n")).first().n
    centroids = ann.fit(e, vector="embedding", key="vec_id", dims=dims)
    path = fresh_path(spark, "lists")
    ann.write_index(e, centroids, path, vector="embedding", key="vec_id")
    asked = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    probes = ann.calibrated(e, centroids, path, 10, vector="embedding", key="vec_id")
    return ann.search(spark, path, centroids, asked, 10, probes=probes), asked


@query("X2_ivf_neighbors")
def _(spark, t):
    return _ivf(spark, t)[0].select("qid", "key", "score", "rank")


@query("X2_ivf_recall", "SELECT count(*) AS queries, true AS reached FROM embeddings WHERE vec_id % 50 = 0")
def _(spark, t):
    """The approximate search held against the exact one over all rows: recall at 10 of 0.9 or more."""
    found, asked = _ivf(spark, t)
    return ann.recall(found, ranking.knn(t("embeddings"), asked, 10, key="vec_id")).select("queries", (F.col("recall") >= 0.9).alias("reached"))


def _at(ts="ts"):
    return F.col(ts).cast("timestamp")


def _plain(df, *columns):
    """Times without a zone again, as the given tables have them."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


def _streamed(spark, df, ts, name, last, group=None):
    """A table as a stream of files in the order of time; ``last``: a row far ahead, so that every window before it closes."""
    path = fresh_path(spark, name)
    files = pairing.in_order_files(df, ts, path, group=group)
    spark.createDataFrame([last], df.schema).coalesce(1).write.mode("append").parquet(path)
    return path, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema), files


def _far(t):
    return t("events").agg(F.max("ts") + F.expr("INTERVAL 30 DAY")).first()[0]


@query("X4_stream_pairs", """SELECT r.event_id AS request_id, r.user_id AS key, r.ts AS sent, coalesce(s.event_id, -1) AS response_id, s.ts AS answered FROM (SELECT * FROM events WHERE event_type = 'view') r
 LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') s ON s.user_id = r.user_id AND s.ts >= r.ts AND s.ts <= r.ts + INTERVAL 6 HOUR""")
def _(spark, t):
    e, far = t("events"), _far(t)
    requests = e.where("event_type = 'view'").select(F.col("event_id").alias("request_id"), F.col("user_id").alias("key"), _at().alias("sent"))
    responses = e.where("event_type = 'click'").select(F.col("event_id").alias("response_id"), F.col("user_id").alias("key"), _at().alias("answered"))
    left, right = _streamed(spark, requests, "sent", "requests", (None, -1, far)), _streamed(spark, responses, "answered", "responses", (None, -1, far))
    out = fresh_path(spark, "pairs")
    q = pairing.run_pairing(*(pairing.file_stream(spark, *x) for x in (left, right)), f"{out}/rows", f"{out}/checkpoint", within="6 hours")
    q.awaitTermination()
    return _plain(spark.read.parquet(f"{out}/rows").where("request_id is not null").fillna(-1, ["response_id"]), "sent", "answered")


@query("X8_sliding_windows", f"""SELECT s AS started, s + INTERVAL 1 HOUR AS ended, event_type, count(*) AS n, CAST(sum(c) AS BIGINT) AS total, 'final' AS status FROM (SELECT time_bucket(INTERVAL 15 MINUTE, ts) - to_minutes(15 * k) AS s, event_type, {_CENTS_SQL} AS c FROM events, (SELECT unnest([0, 1, 2, 3]) AS k)) GROUP BY ALL""")
def _(spark, t):
    rows = t("events").select(_at().alias("ts"), "event_type", _cents().alias("value"))
    source = _streamed(spark, rows, "ts", "windows", (_far(t), "close", 0))
    folder = fresh_path(spark, "sliding")
    sliding.run_sliding(pairing.file_stream(spark, *source), ["event_type"], folder)
    return _plain(sliding.state(spark, folder, ["event_type"]).where("event_type <> 'close'"), "started", "ended")


@query("X5_job_leases")
def _(spark, t):
    """Jobs of users: views queue them, clicks claim, purchases finish, errors fail; leases of two days run out."""
    kind = F.create_map(*[F.lit(x) for pair in (("view", "enqueue"), ("click", "claim"), ("purchase", "done"), ("error", "fail")) for x in pair])[F.col("event_type")]
    rows = t("events").select(F.col("user_id").alias("key"), _at().alias("at"), F.coalesce(kind, F.lit("heartbeat")).alias("kind"), F.col("event_id").alias("seq"))
    buckets = timers.buckets_for(rows, "key")
    source = _streamed(spark, rows, "at", "jobs", (-1, _far(t), "heartbeat", 0), group=timers.bucket("key", buckets))
    out = fresh_path(spark, "leases")
    changes = timers.job_leases(pairing.file_stream(timers.with_rocksdb(spark), *source), lease_seconds=2 * 86_400, buckets=buckets)
    changes.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return _plain(spark.read.parquet(f"{out}/rows"), "at")


@query("X11_commit_log", "SELECT event_id AS seq, md5(CAST(event_id AS VARCHAR)) AS commit, 'user' || user_id AS author, ts AS committed, event_type AS subject, props AS patch FROM events WHERE event_id >= (SELECT max(event_id) // 2 FROM events)")
def _(spark, t):
    e = t("events")
    commits = e.select(F.col("event_id").alias("seq"), F.md5(F.col("event_id").cast("string")).alias("commit"), F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("author"), _at().alias("committed"), F.col("event_type").alias("subject"), F.col("props").alias("patch"))
    folder = fresh_path(spark, "log")
    commit_log.write_log(commits, folder)
    half = e.agg(F.max("event_id")).first()[0] // 2
    return commit_log.register(spark).read.format("commit_log").option("pushdown", "true").load(folder).where(F.col("seq") >= half).transform(_plain, "committed")
