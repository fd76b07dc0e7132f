"""How the given tables stand in for the engine's own (Spark side and the same in SQL)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

USAGE_SQL = """usage AS (SELECT event_id, ts, CAST(user_id AS VARCHAR) AS project,
 CASE user_id % 5 WHEN 0 THEN 'cli' WHEN 1 THEN 'mcp' WHEN 2 THEN 'admin' WHEN 3 THEN 'sdk' ELSE 'unknown' END AS source,
 CASE event_type WHEN 'view' THEN 'empty' WHEN 'click' THEN 'fallback' WHEN 'error' THEN 'error' ELSE 'ok' END AS outcome,
 value AS latency_ms, props FROM events)"""


def usage(t) -> DataFrame:
    e = t("events")
    source = F.element_at(F.array(*map(F.lit, ("cli", "mcp", "admin", "sdk", "unknown"))), (F.col("user_id") % 5 + 1).cast("int"))
    outcome = F.when(F.col("event_type") == "view", "empty").when(F.col("event_type") == "click", "fallback").when(F.col("event_type") == "error", "error").otherwise("ok")
    return e.select("event_id", "ts", F.col("user_id").cast("string").alias("project"), source.alias("source"), outcome.alias("outcome"), F.col("value").alias("latency_ms"), "props")


FILES_SQL = "files AS (SELECT doc_id AS id, source AS project, source || '/' || CAST(doc_id AS VARCHAR) || '.md' AS path, text AS content FROM documents)"


def files(t) -> DataFrame:
    return t("documents").select(F.col("doc_id").alias("id"), F.col("source").alias("project"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.col("text").alias("content"))


EDGES_SQL = "edges AS (SELECT DISTINCT 'pkg' || CAST(l_suppkey // 2 AS VARCHAR) || '/f' || CAST(l_suppkey AS VARCHAR) || '.go' AS source_file, 'pkg' || CAST(l_suppkey // 2 + l_linenumber * (1 + l_partkey % 2) AS VARCHAR) || '/' AS target_file FROM lineitem)"


def edges(t) -> DataFrame:
    """Import edges: each supplier is a file, two of them a directory; a file imports directories up to 14 numbers on.

    Directories grow with the suppliers, no node has more than some 28 neighbours, and walks go as far as there are suppliers.
    """
    li = t("lineitem")
    own = F.floor(F.col("l_suppkey") / 2)
    source = F.concat(F.lit("pkg"), own.cast("string"), F.lit("/f"), F.col("l_suppkey").cast("string"), F.lit(".go"))
    return li.select(source.alias("source_file"), F.concat(F.lit("pkg"), (own + F.col("l_linenumber") * (1 + F.col("l_partkey") % 2)).cast("string"), F.lit("/")).alias("target_file")).distinct()


DEPS_SQL = "deps AS (SELECT DISTINCT 1 AS tenant_id, l_suppkey AS project_id, 'npm' AS ecosystem, 'part-' || CAST(l_partkey AS VARCHAR) AS normalized_name FROM lineitem)"


def deps(t) -> DataFrame:
    return t("lineitem").select(F.lit(1).alias("tenant_id"), F.col("l_suppkey").alias("project_id"), F.lit("npm").alias("ecosystem"), F.concat(F.lit("part-"), F.col("l_partkey").cast("string")).alias("normalized_name")).distinct()
