"""Retrieval evaluation (V*): embeddings as queries, equal labels as relevance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as v
from .registry import query

_RUN = "run AS (SELECT l_suppkey AS qid, l_partkey % 40 AS file, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS rank FROM lineitem QUALIFY rank <= 30), qrels AS (SELECT s_suppkey AS qid, f AS file, 1 + (s_suppkey + f) % 3 AS grade FROM supplier, (SELECT unnest(range(6)) AS f))"
_METRICS = """first AS (SELECT *, row_number() OVER (PARTITION BY qid, file ORDER BY rank) AS k FROM run), j AS (SELECT f.qid, f.rank, CASE WHEN k = 1 THEN coalesce(grade, 0) ELSE 0 END AS grade FROM first f LEFT JOIN qrels q ON q.qid = f.qid AND q.file = f.file),
 n AS (SELECT qid, count(*) AS n, least(10, count(*)) AS m FROM run GROUP BY 1), got AS (SELECT qid, any_value(n) AS n, any_value(m) AS m, sum(CASE WHEN rank <= m THEN (pow(2, grade) - 1) / log2(rank + 1) ELSE 0 END) AS dcg, min(CASE WHEN grade > 0 THEN rank END) AS best, count(*) FILTER (WHERE grade > 0 AND rank <= m) AS hits FROM j JOIN n USING (qid) GROUP BY 1),
 ideal AS (SELECT q.qid, sum(CASE WHEN i <= least(10, coalesce(n, 0)) THEN (pow(2, grade) - 1) / log2(i + 1) ELSE 0 END) AS idcg, count(*) AS relevant FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY grade DESC, file) AS i FROM qrels) q LEFT JOIN n USING (qid) GROUP BY 1),
 m AS (SELECT i.qid, round(CASE WHEN idcg > 0 THEN coalesce(dcg, 0) / idcg ELSE 0 END, 9) AS ndcg, round(coalesce(1.0 / best, 0), 9) AS mrr, round(CASE WHEN coalesce(n, 0) > 0 THEN hits / least(10, n) ELSE 0 END, 9) AS precision, round(coalesce(hits, 0) / relevant, 9) AS recall FROM ideal i LEFT JOIN got USING (qid))"""


def _tables(spark, t):
    from pyspark.sql import Window

    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    run = t("lineitem").select(F.col("l_suppkey").alias("qid"), (F.col("l_partkey") % 40).alias("file"), F.row_number().over(w).alias("rank")).where("rank <= 30")
    qrels = t("supplier").select(F.col("s_suppkey").alias("qid"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("file")).withColumn("grade", 1 + (F.col("qid") + F.col("file")) % 3)
    return run, qrels.withColumn("file", F.col("file").cast("long"))


def _metrics(spark, t):
    m = v.metrics(*_tables(spark, t), 10)
    return m.select("qid", *[F.round(c, 9).alias(c) for c in m.columns[1:]])


@query("V1_V4_metrics", f"WITH {_RUN}, {_METRICS} SELECT * FROM m")
def _(spark, t):
    return _metrics(spark, t)


@query("V5_summary", f"""WITH {_RUN}, {_METRICS}, o AS (SELECT qid, l_linenumber AS run, l_quantity AS latency_ms, CASE WHEN l_linenumber = 7 THEN 'keyword' ELSE 'vector' END AS route, l_tax = 0.08 AS failed, ndcg, mrr, precision, recall FROM lineitem JOIN m ON qid = l_suppkey),
 p AS (SELECT qid, median(latency_ms) AS lat, avg(ndcg) AS ndcg, avg(mrr) AS mrr FROM o WHERE NOT failed GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY lat) AS rn, count(*) OVER () AS n FROM p)
 SELECT count(*) AS queries, round(avg(ndcg), 9) AS ndcg, round(avg(mrr), 9) AS mrr, min(CASE WHEN rn >= ceil(0.5 * n) THEN lat END) AS p50, min(CASE WHEN rn >= ceil(0.95 * n) THEN lat END) AS p95, (SELECT count(*) FROM o WHERE failed) AS failed, (SELECT count(*) FROM o WHERE route <> 'vector') AS fallbacks FROM r""")
def _(spark, t):
    o = t("lineitem").select(F.col("l_suppkey").alias("qid"), F.col("l_linenumber").alias("run"), F.col("l_quantity").alias("latency_ms"), F.when(F.col("l_linenumber") == 7, "keyword").otherwise("vector").alias("route"), (F.col("l_tax") == 0.08).alias("failed")).join(_metrics(spark, t), "qid")
    return v.summarize(o).select("queries", F.round("ndcg", 9).alias("ndcg"), F.round("mrr", 9).alias("mrr"), "p50", "p95", "failed", "fallbacks")


@query("V5_routes", "SELECT event_type AS route, count(*) AS n FROM events GROUP BY 1")
def _(spark, t):
    return v.route_counts(t("events").select(F.col("event_type").alias("route")))


@query("V6_compare", f"WITH {_RUN}, {_METRICS} SELECT qid, round(least(1, ndcg + 0.1) - ndcg, 9) AS d_ndcg, 0.0::DOUBLE AS d_mrr FROM m")
def _(spark, t):
    a = _metrics(spark, t)
    b = a.withColumn("ndcg", F.least(F.lit(1.0), F.col("ndcg") + 0.1))
    return v.compare(a, b).select("qid", F.round("d_ndcg", 9).alias("d_ndcg"), "d_mrr")


@query("V6_transitions", "SELECT o_orderstatus AS before, CASE WHEN o_orderkey % 2 = 0 THEN 'F' ELSE 'O' END AS after, count(*) AS n FROM orders WHERE o_orderstatus <> CASE WHEN o_orderkey % 2 = 0 THEN 'F' ELSE 'O' END GROUP BY 1, 2")
def _(spark, t):
    o = t("orders").select(F.col("o_orderkey").alias("qid"), F.col("o_orderstatus").alias("route"))
    return v.route_transitions(o, o.select("qid", F.when(F.col("qid") % 2 == 0, "F").otherwise("O").alias("route")))


@query("V8_validate", "SELECT CAST(event_id AS VARCHAR) AS qid, 'grade outside 1 to 3' AS problem FROM events WHERE event_id % 5 = 0 OR event_id % 5 = 4")
def _(spark, t):
    e = t("events")
    q = e.select(F.col("event_id").cast("string").alias("qid"), F.lit("x").alias("query"))
    return v.validate(q, e.select(F.col("event_id").cast("string").alias("qid"), F.lit("a/b.go").alias("file"), (F.col("event_id") % 5).alias("grade")))
