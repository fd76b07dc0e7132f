"""Write path, scopes, queues, alerts, routes and caches (M*, P2, P11, J5, J15-J21, U*, S25, T2, T4-T6, V7, W*): entries of their own."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as s
from ..operators import codeintel, evaluation, graph, numbering, ranking, usage, writepath
from ..operators.lineage import fresh_path
from ..streaming import continuous
from .evaluation_queries import _METRICS, _RUN, _metrics, _tables
from .registry import query
from .search_queries import _LEGS, _VEC, legs
from .tables import EDGES_SQL, FILES_SQL, edges, files

_TWO = "u AS (SELECT source_file AS a, target_file AS b FROM edges UNION SELECT target_file, source_file FROM edges)"


@query("M1_embedder", "SELECT p_partkey AS id, length(p_name) AS a, p_size AS b FROM part")
def _(spark, t):
    texts = F.concat("p_name", F.lit("|"), F.col("p_size").cast("string"))
    v = t("part").select(F.col("p_partkey").alias("id"), writepath.embed(texts, lambda x: [float(len(x.split("|")[0])), float(x.split("|")[1])]).alias("v"))
    return v.select("id", F.col("v")[0].cast("long").alias("a"), F.col("v")[1].cast("long").alias("b"))


@query("M2_provider_chain", "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'cloud' WHEN p_partkey % 3 = 1 THEN 'local' END AS used FROM part")
def _(spark, t):
    kind = F.col("p_partkey") % 3
    return t("part").select(F.col("p_partkey").alias("id"), writepath.provider_chain(F.when(kind == 0, "cloud"), F.when(kind == 1, "local"), F.lit(None).cast("string")).alias("used"))


@query("M2_provider_attempts", """WITH a AS (SELECT l_orderkey AS key, 'p' || l_linenumber AS provider, l_linenumber AS place, l_returnflag <> 'R' AS ok, l_quantity AS ms, l_linenumber % 3 = 0 AS local, l_orderkey % 4 = 0 AS sensitive FROM lineitem),
 g AS (SELECT key, min(place) AS f, arg_min(provider, place) AS used FROM a WHERE (local OR NOT sensitive) AND ok AND ms <= 40 GROUP BY 1)
 SELECT a.key, any_value(used) AS used, count(*) FILTER (WHERE local OR NOT sensitive) AS tried, count(*) FILTER (WHERE (local OR NOT sensitive) AND ms > 40) AS timed_out, count(*) FILTER (WHERE NOT (local OR NOT sensitive)) AS skipped FROM a LEFT JOIN g ON a.key = g.key WHERE f IS NULL OR place <= f GROUP BY 1""")
def _(spark, t):
    n = F.col("l_linenumber")
    attempts = t("lineitem").select(F.col("l_orderkey").alias("key"), F.concat(F.lit("p"), n.cast("string")).alias("provider"), n.alias("place"), (F.col("l_returnflag") != "R").alias("ok"), F.col("l_quantity").alias("ms"), (n % 3 == 0).alias("local"), (F.col("l_orderkey") % 4 == 0).alias("sensitive"))
    return writepath.provider_choice(attempts, 40)


@query("M4_round_robin", "SELECT event_id, CAST((row_number() OVER (ORDER BY ts, event_id) - 1) % 4 AS INTEGER) AS member FROM events")
def _(spark, t):
    return numbering.round_robin(t("events").select("event_id", "ts"), ["ts", "event_id"], 4).select("event_id", "member")


@query("M3_breaker", """WITH e AS (SELECT user_id AS provider, ts, event_type <> 'error' AS ok FROM events), g AS (SELECT provider, max(ts) FILTER (WHERE ok) AS good FROM e GROUP BY 1),
 b AS (SELECT provider, count(*) AS n, max(ts) AS failed_at FROM e JOIN g USING (provider) WHERE NOT ok AND (good IS NULL OR ts > good) GROUP BY 1), m AS (SELECT max(ts) AS now FROM events)
 SELECT provider, CASE WHEN coalesce(n, 0) < 2 THEN 'closed' WHEN now >= failed_at + INTERVAL 1 HOUR THEN 'half-open' ELSE 'open' END AS state FROM g LEFT JOIN b USING (provider), m""")
def _(spark, t):
    e = t("events").select(F.col("user_id").alias("provider"), "ts", (F.col("event_type") != "error").alias("ok"))
    now = t("events").agg(F.max("ts").alias("now")).first().now
    return writepath.breaker_state(e, F.lit(now), threshold=2, cooldown_seconds=3600)


@query("M4_pool", "SELECT count(*) AS keys, 4 AS members, true AS even FROM customer")
def _(spark, t):
    of = t("customer").select(writepath.pool_member(F.col("c_custkey"), 4).alias("member")).groupBy("member").agg(F.count("*").alias("n"))
    return of.agg(F.sum("n").alias("keys"), F.count("*").cast("int").alias("members"), (F.max("n") < 2 * F.min("n")).alias("even"))


@query("M8_embedding_route", """SELECT p_partkey AS id, CASE WHEN m = 'edge' THEN 'local' WHEN p_partkey % 3 < 2 THEN CASE WHEN m = 'cloud' THEN 'none' ELSE 'local' END ELSE 'cloud' END AS route
 FROM (SELECT p_partkey, ['cloud', 'hybrid', 'edge'][1 + p_partkey // 3 % 3] AS m FROM part)""")
def _(spark, t):
    k = F.col("p_partkey")
    path = F.when(k % 3 == 0, "conf/secret.yaml").otherwise("src/a.go")
    content = F.when(k % 3 == 1, 'api_key = "abcdefghijklmnop"').otherwise("nothing here")
    mode = F.element_at(F.array(F.lit("cloud"), F.lit("hybrid"), F.lit("edge")), (F.floor(k / 3) % 3 + 1).cast("int"))
    return t("part").select(k.alias("id"), writepath.embedding_route(path, content, mode).alias("route"))


@query("M9_set_worktree", "SELECT o_custkey % 7 AS project_id, o_orderstatus AS worktree, o_orderkey AS path, 'old' AS hash FROM orders WHERE o_custkey % 7 <> 2 OR o_orderstatus <> 'F' UNION ALL SELECT 2, 'F', p_partkey, 'new' FROM part")
def _(spark, t):
    old = t("orders").select((F.col("o_custkey") % 7).alias("project_id"), F.col("o_orderstatus").alias("worktree"), F.col("o_orderkey").alias("path"), F.lit("old").alias("hash"))
    new = t("part").select(F.lit(2).cast("long").alias("project_id"), F.lit("F").alias("worktree"), F.col("p_partkey").alias("path"), F.lit("new").alias("hash"))
    return writepath.set_worktree(old, new)


@query("P2_worktree_scope", "SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 2 = 0")
def _(spark, t):
    o = t("orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 7).alias("project_id"), F.col("o_orderkey").cast("string").alias("path"), F.col("o_orderstatus").alias("hash"), "o_custkey")
    manifest = o.where("o_custkey % 2 = 0").select("project_id", "path", "hash", F.when(F.col("hash") == "F", "main").otherwise("other").alias("worktree"))
    return writepath.in_worktree(o, manifest.unionByName(manifest), "main").select("id")


@query("P11_without_sensitive", "SELECT p_partkey AS id FROM part WHERE p_partkey % 4 > 1")
def _(spark, t):
    names = F.array(*map(F.lit, ("conf/auth_token.go", "keys/a.pem", "src/a.go", "docs/authors.md")))
    return ranking.without_sensitive(t("part").select(F.col("p_partkey").alias("id"), F.element_at(names, (F.col("p_partkey") % 4 + 1).cast("int")).alias("path"))).select("id")


@query("J5_full_outer_legs", f"WITH {_LEGS} SELECT coalesce(v.path, w.path) AS path, CASE WHEN r1 IS NOT NULL THEN 'vector' ELSE 'keyword' END AS source FROM v FULL JOIN w ON v.path = w.path")
def _(spark, t):
    v, w = legs(t)
    return ranking.fuse_rrf(v, w, 1000, keys=("path",)).select("path", "source")


@query("J13_frontier", f"WITH {EDGES_SQL}, {_TWO} SELECT DISTINCT b AS path FROM u WHERE a IN ('pkg1/', 'pkg2/') AND b NOT IN ('pkg1/', 'pkg2/')")
def _(spark, t):
    return graph.bfs(edges(t), spark.createDataFrame([("pkg1/",), ("pkg2/",)], "path string"), 1).select("path")


@query("J15_symbol_changes", """WITH l AS (SELECT 'f' || l_orderkey || '.go' AS path, 'func:F' || l_partkey AS key, max(l_linenumber % 4) AS m, min(l_linenumber % 4) AS k FROM lineitem GROUP BY ALL)
 SELECT path, key, CASE WHEN m = 0 THEN 'removed' WHEN k = 3 THEN 'new' ELSE 'changed' END AS change FROM l WHERE m = 0 OR k = 3 OR (m = k AND m = 2)""")
def _(spark, t):
    """A file for each order, a declaration for each line; the newer version lacks some, has others, and others with another signature."""
    li = t("lineitem").groupBy(F.concat(F.lit("f"), F.col("l_orderkey").cast("string"), F.lit(".go")).alias("path"), "l_partkey").agg(F.max(F.col("l_linenumber") % 4).alias("m"), F.min(F.col("l_linenumber") % 4).alias("k"))
    name = F.concat(F.lit("func F"), F.col("l_partkey").cast("string"))
    version = lambda rows, text: rows.groupBy("path").agg(F.array_join(F.sort_array(F.collect_list(text)), "\n}\n").alias("content"))  # noqa: E731  a file's lines, as many as an order has
    old = version(li.where("k <> 3"), F.concat(name, F.lit("() {")))
    new = version(li.where("m <> 0"), F.concat(name, F.when(F.expr("m = k and m = 2"), "(x int) {").otherwise("() {")))
    return codeintel.symbol_diff(old, new).select("path", "key", "change")


@query("J17_importers", f"WITH {EDGES_SQL} SELECT source_file AS path FROM edges WHERE target_file = 'pkg5/'")
def _(spark, t):
    return graph.callers(edges(t), "pkg5/f5.go").where("kind = 'direct'").select("path")


@query("J19_scope", """SELECT o_orderkey AS id FROM orders WHERE (o_custkey % 5 NOT IN (SELECT c_custkey % 5 FROM customer WHERE c_custkey % 5 < 3) OR o_custkey % 5 IN (0, 1)) AND o_custkey % 5 IN (1, 3)""")
def _(spark, t):
    rows = t("orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 5).alias("workspace"))
    members = t("customer").where("c_custkey % 5 < 3").select((F.col("c_custkey") % 5).alias("workspace"), F.when(F.col("c_custkey") % 5 < 2, "me").otherwise("you").alias("user"))
    tokens = spark.createDataFrame([("me", 1), ("me", 3), ("you", 0)], "user string, workspace long")
    return usage.in_scope(rows, members, tokens, "me").select("id")


@query("J20_judged", f"WITH {_RUN}, f AS (SELECT *, row_number() OVER (PARTITION BY qid, file ORDER BY rank) AS k FROM run) SELECT f.qid, f.rank, f.file, CASE WHEN k = 1 THEN coalesce(grade, 0) ELSE 0 END AS grade FROM f LEFT JOIN qrels q ON q.qid = f.qid AND q.file = f.file")
def _(spark, t):
    return evaluation.judged(*_tables(spark, t)).select("qid", "rank", "file", F.col("grade").cast("long").alias("grade"))


for _name in ("mrr", "precision"):

    @query({"mrr": "V2_mrr", "precision": "V3_precision"}[_name], f"WITH {_RUN}, {_METRICS} SELECT qid, {_name} FROM m")
    def _(spark, t, name=_name):
        return _metrics(spark, t).select("qid", name)


_BY_PRICE = _RUN.replace("ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice", "ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_quantity")


def _summary_sql(run: str, latency: str, routes: str) -> str:
    return f"""(WITH {run}, {_METRICS}, o AS (SELECT qid, {latency} AS latency_ms, {routes} AS route, l_tax = 0.08 AS failed, ndcg, mrr, precision, recall FROM lineitem JOIN m ON qid = l_suppkey),
 p AS (SELECT qid, median(latency_ms) AS lat, avg(ndcg) AS ndcg, avg(mrr) AS mrr, avg(precision) AS precision, avg(recall) AS recall FROM o WHERE NOT failed GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY lat) AS rn, count(*) OVER () AS n FROM p)
 SELECT avg(ndcg) AS ndcg, avg(mrr) AS mrr, avg(precision) AS precision, avg(recall) AS recall, min(CASE WHEN rn >= ceil(0.95 * n) THEN lat END) AS p95, (SELECT count(*) FROM o WHERE failed) AS failed, (SELECT count(*) FROM o WHERE route <> 'vector') AS fallbacks FROM r)"""


@query("V7_gate", f"""WITH a AS {_summary_sql(_RUN, "l_quantity", "'vector'")}, b AS {_summary_sql(_BY_PRICE, "l_quantity * 40", "CASE WHEN l_linenumber = 7 THEN 'keyword' ELSE 'vector' END")}
 SELECT unnest(list_filter([CASE WHEN a.ndcg - b.ndcg > 0.01 THEN 'ndcg' END, CASE WHEN a.mrr - b.mrr > 0.01 THEN 'mrr' END, CASE WHEN a.precision - b.precision > 0.01 THEN 'precision' END, CASE WHEN a.recall - b.recall > 0.01 THEN 'recall' END,
 CASE WHEN b.p95 - a.p95 > 50 THEN 'p95_ms' END, CASE WHEN b.failed > 0 THEN 'failed' END, CASE WHEN b.fallbacks > 0 THEN 'fallbacks' END], lambda x: x IS NOT NULL)) AS violated FROM a, b""")
def _(spark, t):
    """Two runs over all of lineitem: by order, and by price with slower answers and fallbacks."""
    run, qrels = _tables(spark, t)
    w = Window.partitionBy("l_suppkey").orderBy(F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    other = t("lineitem").select(F.col("l_suppkey").alias("qid"), (F.col("l_partkey") % 40).alias("file"), F.row_number().over(w).alias("rank")).where("rank <= 30")

    def summary(run, slower, route):
        m = evaluation.metrics(run, qrels, 10)
        m = m.select("qid", *[F.round(c, 9).alias(c) for c in m.columns[1:]])
        o = t("lineitem").select(F.col("l_suppkey").alias("qid"), F.col("l_linenumber").alias("run"), (F.col("l_quantity") * slower).alias("latency_ms"), route.alias("route"), (F.col("l_tax") == 0.08).alias("failed"))
        return evaluation.summarize(o.join(m, "qid"))

    return evaluation.gate(summary(run, 1, F.lit("vector")), summary(other, 40, F.when(F.col("l_linenumber") == 7, "keyword").otherwise("vector")))


@query("A11_least_depth", f"""WITH RECURSIVE {EDGES_SQL}, {_TWO}, r(path, depth) AS (SELECT 'pkg7/', 0 UNION SELECT u.b, r.depth + 1 FROM r JOIN u ON u.a = r.path WHERE r.depth < 2), m AS (SELECT path, min(depth) AS depth FROM r GROUP BY path) SELECT depth, count(*) AS n FROM m WHERE depth > 0 GROUP BY depth""")
def _(spark, t):
    return graph.bfs(edges(t), spark.createDataFrame([("pkg7/",)], "path string"), 2).groupBy("depth").agg(F.count("*").alias("n"))


@query("A19_medians", """WITH p AS (SELECT l_suppkey AS qid, median(l_quantity) AS lat FROM lineitem WHERE l_tax <> 0.08 GROUP BY 1), r AS (SELECT lat, row_number() OVER (ORDER BY lat) AS rn, count(*) OVER () AS n FROM p)
 SELECT count(*) AS queries, min(CASE WHEN rn >= ceil(0.5 * n) THEN lat END) AS p50, min(CASE WHEN rn >= ceil(0.99 * n) THEN lat END) AS p99 FROM r""")
def _(spark, t):
    o = t("lineitem").select(F.col("l_suppkey").alias("qid"), F.col("l_linenumber").alias("run"), F.col("l_quantity").alias("latency_ms"), F.lit("vector").alias("route"), (F.col("l_tax") == 0.08).alias("failed"), *[F.lit(0.0).alias(c) for c in ("ndcg", "mrr", "precision", "recall")])
    return evaluation.summarize(o).select("queries", "p50", "p99")


_HASHED = "SELECT query, sha256(string_agg(h, chr(10) ORDER BY p, h)) AS fingerprint FROM {src} GROUP BY query"


def _levels(src: str) -> str:
    """SQL of the fingerprint's levels over ``query, h`` rows."""
    out, last = [f"z AS (SELECT query, h AS p, h FROM {src})"], "z"
    for i, d in enumerate(usage.FINGERPRINT_LEVELS[:-1]):
        out.append(f"z{i} AS (SELECT query, left(p, {d}) AS p, sha256(string_agg(h, chr(10) ORDER BY p, h)) AS h FROM {last} GROUP BY query, left(p, {d}))")
        last = f"z{i}"
    return ", ".join(out) + ", zz AS (" + _HASHED.format(src=last) + ")"


_RESULTS = "r AS (SELECT l_returnflag AS query, sha256(CAST(l_partkey AS VARCHAR) || chr(0) || CAST(l_linenumber AS VARCHAR) || chr(0) || CAST(l_orderkey AS VARCHAR)) AS h FROM lineitem)"


def _results(t):
    return t("lineitem").select(F.col("l_returnflag").alias("query"), F.col("l_partkey").alias("path"), F.col("l_linenumber").alias("start_line"), F.col("l_orderkey").alias("end_line"))


@query("A17_result_hash", f"WITH {_RESULTS}, {_levels('r')} SELECT query, fingerprint FROM zz")
def _(spark, t):
    return usage.fingerprint(_results(t), ["path", "start_line", "end_line"], ["query"])


@query("T5_changed_alerts", f"WITH {_RESULTS}, {_levels('r')} SELECT query, fingerprint FROM zz WHERE query <> 'A'")
def _(spark, t):
    now = usage.fingerprint(_results(t), ["path", "start_line", "end_line"], ["query"])
    known = now.where("query = 'A'").unionByName(now.where("query = 'N'").withColumn("fingerprint", F.lit("stale")))
    return continuous.changed_alerts(_results(t), known)


@query("A23_strongest_outcome", "SELECT CASE m WHEN 3 THEN 'indexed' WHEN 2 THEN 'unchanged' WHEN 1 THEN 'empty' ELSE 'error' END AS outcome, count(*) AS n FROM (SELECT l_orderkey, max(l_linenumber % 4) AS m FROM lineitem GROUP BY 1) GROUP BY 1")
def _(spark, t):
    names = F.array(*map(F.lit, ("error", "empty", "unchanged", "indexed")))
    return usage.outcome_stats(t("lineitem").select(F.col("l_orderkey").alias("path"), F.element_at(names, (F.col("l_linenumber") % 4 + 1).cast("int")).alias("outcome")))


@query("W2_exact_cosine", """SELECT vec_id, 'self' AS kind, 1.0::DOUBLE AS score FROM embeddings UNION ALL SELECT vec_id, 'short', 0.0 FROM embeddings UNION ALL SELECT vec_id, 'zero', 0.0 FROM embeddings UNION ALL SELECT vec_id, 'against', -1.0 FROM embeddings""")
def _(spark, t):
    v = F.col("embedding")
    kinds = {"self": v, "short": F.slice(v, 1, 3), "zero": F.transform(v, lambda x: x * F.lit(0).cast("float")), "against": F.transform(v, lambda x: -x)}
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), o.cast("array<float>").alias("other")) for k, o in kinds.items()]))
    return t("embeddings").select("vec_id", "embedding", pairs.alias("p")).select("vec_id", "p.kind", F.round(s.cosine(v, F.col("p.other")), 6).alias("score"))


@query("W3_all_similar", f"SELECT e.vec_id, {_VEC} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q")
def _(spark, t):
    q = list(t("embeddings").where("vec_id = 0").first().embedding)
    return ranking.similar(t("embeddings"), q, 0, key="vec_id").select("vec_id", F.round("score", 9).alias("score"))


_FUSED = f"""{_LEGS}, f AS (SELECT coalesce(v.path, w.path) AS path, r1, r2, round(coalesce(1.0 / (60 + r1), 0) + coalesce(1.0 / (60 + r2), 0) + CASE WHEN r1 IS NOT NULL AND r2 IS NOT NULL THEN 0.02 ELSE 0 END, 9) AS raw FROM v FULL JOIN w ON v.path = w.path)"""


@query("W9_hybrid_routes", f"""WITH {_FUSED} SELECT path, route FROM (SELECT path, 'hybrid' AS route, row_number() OVER (ORDER BY raw DESC, r1 NULLS LAST, r2 NULLS LAST) AS n FROM f UNION ALL SELECT path, 'vector', r1 FROM v UNION ALL SELECT path, 'keyword', r2 FROM w) WHERE n <= 10""")
def _(spark, t):
    v, w = legs(t)
    routes = [ranking.hybrid_route(a, b, 10, keys=("path",)).select("path", "route") for a, b in ((v, w), (v, None), (None, w))]
    return routes[0].unionByName(routes[1]).unionByName(routes[2])


@query("W16_paginate", "SELECT o_orderkey AS id FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 25 OFFSET 50")
def _(spark, t):
    from ..sources.files import page

    return page(t("orders").select(F.col("o_orderkey").alias("id"), "o_orderdate"), [F.col("o_orderdate").desc(), F.col("id")], 25, 50).select("id")


@query("W20_result_cache", """WITH m AS (SELECT max(ts) AS now FROM events), q AS (SELECT user_id AS query, max(ts) AS "at" FROM events GROUP BY 1) SELECT query, "at" FROM q, m WHERE "at" > now - INTERVAL 2 DAY ORDER BY "at" DESC, query LIMIT 50""")
def _(spark, t):
    e = t("events").select(F.col("user_id").alias("query"), F.col("ts").alias("at"), F.col("event_id").alias("answer"))
    now = t("events").agg(F.max("ts").alias("now")).first().now
    half = F.col("answer") % 2 == 0
    return ranking.cached_results(e.where(half), e.where(~half), F.lit(now), 2 * 86_400, 50).select("query", "at")


@query("U1_union_distinct", f"WITH {EDGES_SQL}, {_TWO} SELECT count(*) AS n FROM u")
def _(spark, t):
    return graph.both_ways(edges(t)).agg(F.count("*").alias("n"))


@query("U2_dimensions", "SELECT len(embedding) AS dims FROM embeddings LIMIT 1")
def _(spark, t):
    none = t("embeddings").withColumn("embedding", F.lit(None).cast("array<float>"))
    return ranking.probe_dimensions([none, t("embeddings"), t("embeddings").withColumn("embedding", F.slice("embedding", 1, 3))]).select(F.col("dims").cast("long").alias("dims"))


@query("U4_node_union", f"WITH {EDGES_SQL} SELECT source_file AS node FROM edges UNION SELECT target_file FROM edges")
def _(spark, t):
    return graph.degrees(edges(t)).select("node")


@query("U6_stale_deleted", f"WITH {FILES_SQL} SELECT path, CASE WHEN id % 5 = 1 THEN 'deleted' ELSE 'stale' END AS state FROM files WHERE id % 5 < 4 AND id % 5 > 0")
def _(spark, t):
    f = files(t).select("id", "path", F.sha2("path", 256).alias("hash"))
    client = f.where("id % 5 <> 1").select("path", F.when(F.col("id") % 5 == 2, "changed").otherwise(F.col("hash")).alias("hash"))
    return usage.file_diff(client, f.where("id % 5 <> 3").select("path", "hash"))


@query("G22_trace", f"""WITH RECURSIVE {EDGES_SQL}, {_TWO}, r(path, depth) AS (SELECT 'pkg9/', 0 UNION SELECT u.b, r.depth + 1 FROM r JOIN u ON u.a = r.path WHERE r.depth < 1) SELECT path, min(depth) AS depth FROM r GROUP BY path HAVING min(depth) > 0""")
def _(spark, t):
    return graph.bfs(edges(t), spark.createDataFrame([("pkg9/",)], "path string"), max(1, min(1, graph.WALK_DEPTH)))


@query("S25_text_scan", "SELECT doc_id FROM documents WHERE source = 'src1' AND (contains(lower(text), 'the') OR contains(lower(text), 'pour'))")
def _(spark, t):
    chunks = t("documents").select("doc_id", F.col("source").alias("project"), F.col("text").alias("content"))
    return ranking.text_scan(chunks, "src1", ["The", "pour"]).select("doc_id")


@query("T2_stale_jobs", "SELECT event_id AS id, CASE WHEN event_type = 'view' AND ts < (SELECT max(ts) FROM events) - INTERVAL 30 MINUTE THEN 'queued' WHEN event_type = 'view' THEN 'running' ELSE 'done' END AS status FROM events")
def _(spark, t):
    jobs = t("events").select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "view", "running").otherwise("done").alias("status"), F.col("ts").alias("started_at"))
    now = t("events").agg(F.max("ts").alias("now")).first().now
    return continuous.stale_jobs(jobs, F.lit(now)).select("id", "status")


@query("T4_edge_counters", "SELECT o_custkey AS source, CAST(count(*) AS BIGINT) AS request_count, CAST(sum(o_orderkey % 2) AS BIGINT) AS error_count, min(o_orderdate) AS first_seen, max(o_orderdate) AS last_seen FROM orders GROUP BY 1")
def _(spark, t):
    calls = t("orders").select(F.col("o_custkey").alias("source"), F.lit(1).cast("long").alias("request_count"), (F.col("o_orderkey") % 2).cast("long").alias("error_count"), F.lit(1.0).alias("p95_latency_ms"), F.col("o_orderdate").alias("first_seen"), F.col("o_orderdate").alias("last_seen"))
    first, second = calls.where("error_count = 0"), calls.where("error_count = 1")
    keys = ["source"]
    seq = F.monotonically_increasing_id()
    old = usage.merge_runtime_edges(calls.limit(0), first.withColumn("seq", seq), keys).select(*calls.columns)
    return usage.merge_runtime_edges(old, second.withColumn("seq", seq), keys).select("source", "request_count", "error_count", "first_seen", "last_seen")


@query("T6_insights", "SELECT o_orderpriority AS query, count(*) AS match_count FROM orders GROUP BY 1")
def _(spark, t):
    path = fresh_path(spark, "insights")
    points = t("orders").groupBy(F.col("o_orderpriority").alias("query")).agg(F.count("*").alias("match_count")).withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    for batch in (0, 1, 1):  # a second batch adds points; repeated, it replaces its own
        continuous.append_insight(points, path, batch)
    back = spark.read.parquet(path)
    return back.groupBy("query").agg(F.max("match_count").alias("match_count"), F.count("*").alias("_n")).where("_n = 2").drop("_n")
