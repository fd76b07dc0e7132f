"""Usage analytics and aggregates (A*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import usage as ops
from ..streaming import continuous
from .registry import query
from .tables import FILES_SQL, USAGE_SQL, files, usage


@query("A1_counts", "SELECT (SELECT count(*) FROM documents) AS n_files, (SELECT count(*) FROM embeddings) AS n_chunks")
def _(spark, t):
    return t("documents").agg(F.count("*").alias("n_files")).join(t("embeddings").agg(F.count("*").alias("n_chunks")), F.lit(True))


@query("A2_usage_by_project", f"WITH {USAGE_SQL} SELECT project AS key, count(*) AS n FROM usage GROUP BY 1 ORDER BY n DESC, key LIMIT 10")
def _(spark, t):
    return ops.group_counts(usage(t), "project")


@query("A2_usage_by_outcome", f"WITH {USAGE_SQL} SELECT outcome AS key, count(*) AS n FROM usage GROUP BY 1 ORDER BY n DESC, key LIMIT 10")
def _(spark, t):
    return ops.group_counts(usage(t), "outcome")


@query("A3_usage_grouping_sets", f"""WITH {USAGE_SQL} SELECT 'project' AS "grouping", project AS key, count(*) AS n FROM usage GROUP BY project
 UNION ALL SELECT 'source', source, count(*) FROM usage GROUP BY source UNION ALL SELECT 'outcome', outcome, count(*) FROM usage GROUP BY outcome
 UNION ALL SELECT 'all', '', count(*) FROM usage""")
def _(spark, t):
    return ops.grouping_sets(usage(t), ["project", "source", "outcome"])


@query("A4_latency_interpolated", f"WITH {USAGE_SQL} SELECT round(coalesce(quantile_cont(latency_ms, 0.5), 0), 6) AS p50, round(coalesce(quantile_cont(latency_ms, 0.95), 0), 6) AS p95 FROM usage")
def _(spark, t):
    return ops.latency_interpolated(usage(t)).select(*[F.round(c, 6).alias(c) for c in ("p50", "p95")])


@query("A5_latency_nearest", f"""WITH {USAGE_SQL}, r AS (SELECT latency_ms AS v, row_number() OVER (ORDER BY latency_ms) AS rn, count(*) OVER () AS n FROM usage WHERE latency_ms IS NOT NULL)
 SELECT min(CASE WHEN rn >= ceil(0.5 * n) THEN v END) AS p50, min(CASE WHEN rn >= ceil(0.95 * n) THEN v END) AS p95 FROM r""")
def _(spark, t):
    return ops.latency_nearest(usage(t))


_RATES = ", ".join(f"round(count(*) FILTER (WHERE {c} = '{k}') / count(*), 9) AS {k}_rate" for k, c in (("ok", "outcome"), ("empty", "outcome"), ("fallback", "outcome"), ("error", "outcome"), ("mcp", "source"), ("cli", "source")))


@query("A6_usage_rates", f"WITH {USAGE_SQL} SELECT count(*) AS total, {_RATES} FROM usage")
def _(spark, t):
    r = ops.rates(usage(t))
    return r.select("total", *[F.round(c, 9).alias(c) for c in r.columns[1:]])


@query("A7_usage_findings", f"""WITH {USAGE_SQL}, r AS (SELECT project, count(*) AS total, {_RATES} FROM usage GROUP BY project)
 SELECT finding, count(*) AS n FROM (SELECT 'many_empty' AS finding FROM r WHERE empty_rate >= 0.5 UNION ALL SELECT 'many_fallbacks' FROM r WHERE fallback_rate >= 0.4
 UNION ALL SELECT 'many_errors' FROM r WHERE error_rate >= 0.1 UNION ALL SELECT 'no_agent_usage' FROM r WHERE mcp_rate = 0 AND cli_rate = 0) GROUP BY finding""")
def _(spark, t):
    n = F.count("*")
    kinds = [("ok", "outcome"), ("empty", "outcome"), ("fallback", "outcome"), ("error", "outcome"), ("mcp", "source"), ("cli", "source")]
    per = usage(t).groupBy("project").agg(n.alias("total"), *[F.round(F.count_if(F.col(c) == k) / n, 9).alias(f"{k}_rate") for k, c in kinds])
    return ops.findings(per).groupBy("finding").agg(F.count("*").alias("n"))


@query("A8_runtime_edges", """SELECT l_suppkey % 20 AS source_id, l_partkey % 20 AS target_id, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS request_count, count(*) FILTER (WHERE l_returnflag = 'R') AS error_count,
 max_by(l_extendedprice, (l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) AS p95_latency_ms, min(l_shipdate) AS first_seen, max(l_shipdate) AS last_seen FROM lineitem GROUP BY 1, 2""")
def _(spark, t):
    new = t("lineitem").select((F.col("l_suppkey") % 20).alias("source_id"), (F.col("l_partkey") % 20).alias("target_id"), F.col("l_quantity").cast("long").alias("request_count"), (F.col("l_returnflag") == "R").cast("long").alias("error_count"), F.col("l_extendedprice").alias("p95_latency_ms"), F.col("l_shipdate").alias("first_seen"), F.col("l_shipdate").alias("last_seen"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100000 + F.col("l_partkey")).alias("seq"))
    return ops.merge_runtime_edges(new.drop("seq").limit(0), new, ["source_id", "target_id"])


@query("A13_extensions", "SELECT CASE WHEN e = '' OR e = '.' OR strlen(e) > 12 THEN 'other' ELSE e END AS extension, count(*) AS n FROM (SELECT lower(regexp_extract(regexp_extract(url, '[^/]*$'), '(\\.[^.]*)$', 1)) AS e FROM pages) GROUP BY 1")
def _(spark, t):
    return ops.extension_breakdown(t("pages").select(F.col("url").alias("path")))


@query("A15_dependency_dedupe", """WITH d AS (SELECT 'npm' AS ecosystem, 'part-' || CAST(l_partkey % 300 AS VARCHAR) AS name, CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE CAST(l_quantity AS VARCHAR) END AS constraint_text,
 CASE WHEN l_linenumber % 3 = 0 THEN CAST(l_tax AS VARCHAR) ELSE '' END AS resolved_version, l_returnflag AS scope, (l_orderkey * 10 + l_linenumber) * 100000 + l_partkey AS seq FROM lineitem)
 SELECT ecosystem, name, scope, arg_min(seq, seq) AS seq, coalesce(arg_min(constraint_text, seq) FILTER (WHERE constraint_text <> ''), '') AS constraint_text,
 coalesce(arg_min(resolved_version, seq) FILTER (WHERE resolved_version <> ''), '') AS resolved_version FROM d GROUP BY 1, 2, 3""")
def _(spark, t):
    name = F.concat(F.lit("part-"), (F.col("l_partkey") % 300).cast("string"))
    d = t("lineitem").select(F.lit("npm").alias("ecosystem"), name.alias("name"), name.alias("normalized_name"), F.when(F.col("l_linenumber") % 2 == 0, "").otherwise(F.col("l_quantity").cast("string")).alias("constraint_text"), F.when(F.col("l_linenumber") % 3 == 0, F.col("l_tax").cast("string")).otherwise("").alias("resolved_version"), F.col("l_returnflag").alias("scope"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100000 + F.col("l_partkey")).alias("seq"))
    return ops.fill_duplicates(d, F.col("seq")).select("ecosystem", "name", "scope", "seq", "constraint_text", "resolved_version")


_LEVEL = "SELECT project, left(p, {d}) AS p, sha256(string_agg(h, chr(10) ORDER BY p, h)) AS h FROM {src} GROUP BY project, left(p, {d})"


@query("A16_corpus_fingerprint", f"""WITH {FILES_SQL}, z AS (SELECT project, sha256(coalesce(path, '') || chr(0) || coalesce(content, '')) AS p FROM files), z0 AS (SELECT project, p, p AS h FROM z),
 a AS ({_LEVEL.format(d=5, src='z0')}), b AS ({_LEVEL.format(d=3, src='a')}), c AS ({_LEVEL.format(d=1, src='b')}), d AS ({_LEVEL.format(d=0, src='c')}) SELECT project, h AS fingerprint FROM d""")
def _(spark, t):
    return ops.fingerprint(files(t), ["path", "content"], ["project"])


@query("A18_latest_version", "SELECT o_custkey AS project_id, o_orderpriority AS path, o_orderkey AS id, o_orderdate AS indexed_at FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def _(spark, t):
    from ..sources.files import latest_versions

    return latest_versions(t("orders").select(F.col("o_custkey").alias("project_id"), F.col("o_orderpriority").alias("path"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("indexed_at")))


@query("A20_monthly_series", "SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS month, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1")
def _(spark, t):
    return ops.monthly_series(t("orders").select(F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("match_count"))).withColumn("mean", F.round("mean", 4))


@query("A20_trend", """WITH p AS (SELECT o_custkey AS query, arg_min(o_totalprice, o_orderdate + to_microseconds(o_orderkey)) AS first, arg_max(o_totalprice, o_orderdate + to_microseconds(o_orderkey)) AS last FROM orders GROUP BY 1)
 SELECT query, first, last, round(100.0 * (last - first) / first, 6) AS percent FROM p""")
def _(spark, t):
    points = t("orders").select(F.col("o_custkey").alias("query"), F.struct("o_orderdate", "o_orderkey").alias("ts"), F.col("o_totalprice").alias("match_count"))
    return ops.trend(points).withColumn("percent", F.round("percent", 6))


@query("A21_unique_by_identity", "SELECT min(s_suppkey) AS id, CAST(s_nationkey AS VARCHAR) AS identity FROM supplier GROUP BY s_nationkey")
def _(spark, t):
    return ops.unique_by_identity(t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("string").alias("identity")))


@query("A22_outcomes", """SELECT outcome, count(*) AS n FROM (SELECT user_id, max(CASE event_type WHEN 'purchase' THEN 3 WHEN 'click' THEN 2 ELSE 1 END) AS r FROM events GROUP BY 1)
 JOIN (VALUES (3, 'indexed'), (2, 'unchanged'), (1, 'empty')) AS v(r, outcome) USING (r) GROUP BY 1""")
def _(spark, t):
    unit = F.when(F.col("event_type") == "purchase", "indexed").when(F.col("event_type") == "click", "unchanged").otherwise("empty")
    return ops.outcome_stats(t("events").select(F.col("user_id").alias("path"), unit.alias("outcome")))


@query("A24_citations", "SELECT l_partkey AS path, l_linenumber AS start_line, l_linenumber AS end_line, max(l_extendedprice) AS score FROM lineitem GROUP BY 1, 2")
def _(spark, t):
    return ops.citations(t("lineitem").select(F.col("l_partkey").alias("path"), F.col("l_linenumber").alias("start_line"), F.col("l_linenumber").alias("end_line"), F.col("l_extendedprice").alias("score")))


@query("T1_debounce", """WITH e AS (SELECT ts, user_id AS path, event_type AS op, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS fresh FROM events),
 s AS (SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY ts, event_id) AS session FROM e) SELECT path, max(ts) AS ts FROM s GROUP BY path, session""")
def _(spark, t):
    return continuous.debounced(t("events").select("ts", F.col("user_id").alias("path"), F.col("event_type").alias("op")), "6 hours").select("path", "ts")


@query("T3_usage_rollup", f"WITH {USAGE_SQL} SELECT time_bucket(INTERVAL 1 HOUR, ts) AS since, source, outcome, count(*) AS n, round(avg(latency_ms), 6) AS mean_ms FROM usage GROUP BY 1, 2, 3")
def _(spark, t):
    return continuous.usage_rollup(usage(t)).withColumn("mean_ms", F.round("mean_ms", 6))


@query("T7_over_limit", "SELECT time_bucket(INTERVAL 1 SECOND, ts) AS second, event_type AS key, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 0")
def _(spark, t):
    return continuous.over_limit(t("events").select("ts", F.col("event_type").alias("key")), 0)


@query("F20_props", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k FROM events")
def _(spark, t):
    from ..functions.scalars import json_map

    return t("events").select("event_id", json_map(F.col("props"))["k"].alias("k"))
