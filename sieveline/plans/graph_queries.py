"""Graph operators (G*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as g
from .registry import query
from .tables import EDGES_SQL, edges

_TWO = "u AS (SELECT source_file AS a, target_file AS b FROM edges UNION SELECT target_file, source_file FROM edges)"


@query("G12_adjacency", f"WITH {EDGES_SQL} SELECT source_file, string_agg(target_file, ',' ORDER BY target_file) AS targets FROM edges GROUP BY 1")
def _(spark, t):
    return g.adjacency(edges(t)).select("source_file", F.array_join("targets", ",").alias("targets"))


@query("G13_bfs", f"""WITH RECURSIVE {EDGES_SQL}, {_TWO}, r(path, depth) AS (SELECT 'pkg1/', 0 UNION SELECT u.b, r.depth + 1 FROM r JOIN u ON u.a = r.path WHERE r.depth < 6)
 SELECT path, min(depth) AS depth FROM r GROUP BY path HAVING min(depth) > 0""")
def _(spark, t):
    return g.bfs(edges(t), spark.createDataFrame([("pkg1/",)], "path string"), 6)


#: Import edges of few, widely imported directories: each supplier is a file, each part's directory is imported by its suppliers.
_WIDE_SQL = "edges AS (SELECT DISTINCT 'pkg' || CAST(l_suppkey % 40 AS VARCHAR) || '/f' || CAST(l_suppkey AS VARCHAR) || '.go' AS source_file, 'pkg' || CAST(l_partkey % 40 AS VARCHAR) || '/' AS target_file FROM lineitem)"


def _wide(t):
    source = F.concat(F.lit("pkg"), (F.col("l_suppkey") % 40).cast("string"), F.lit("/f"), F.col("l_suppkey").cast("string"), F.lit(".go"))
    return t("lineitem").select(source.alias("source_file"), F.concat(F.lit("pkg"), (F.col("l_partkey") % 40).cast("string"), F.lit("/")).alias("target_file")).distinct()


@query("G14_expand", f"""WITH RECURSIVE {_WIDE_SQL}, {_TWO}, r(path, depth, score) AS (SELECT 'pkg1/', 0, 1.0::DOUBLE UNION SELECT u.b, r.depth + 1, r.score * 0.85 FROM r JOIN u ON u.a = r.path WHERE r.depth < 2)
 SELECT path, round(max(score), 9) AS score, min(depth) AS depth FROM r WHERE path <> 'pkg1/' GROUP BY path ORDER BY score DESC, path LIMIT 100""")
def _(spark, t):
    return g.expand(_wide(t), spark.createDataFrame([("pkg1/", 1.0, 1)], "path string, score double, rank int"), 2).withColumn("score", F.round("score", 9))


@query("G16_built_graph", f"""WITH {EDGES_SQL} SELECT source_file AS source, target_file AS target, 'imports' AS kind FROM edges UNION SELECT regexp_replace(source_file, '[^/]*$', ''), source_file, 'contains' FROM edges""")
def _(spark, t):
    return g.build(edges(t))


@query("A9_degrees", f"""WITH {EDGES_SQL}, d AS (SELECT source_file AS node, 1 AS o, 0 AS i FROM edges UNION ALL SELECT target_file, 0, 1 FROM edges) SELECT node, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM d GROUP BY node""")
def _(spark, t):
    return g.degrees(edges(t))


@query("A9_graph_stats", f"WITH {EDGES_SQL} SELECT (SELECT count(*) FROM (SELECT source_file FROM edges UNION SELECT target_file FROM edges)) AS nodes, (SELECT count(*) FROM edges) AS edges")
def _(spark, t):
    return g.graph_stats(edges(t))


@query("A10_degrees_with_contains", f"""WITH {EDGES_SQL}, b AS (SELECT source_file AS s, target_file AS t FROM edges UNION ALL SELECT DISTINCT regexp_replace(source_file, '[^/]*$', ''), source_file FROM edges), d AS (SELECT s AS node, 1 AS o, 0 AS i FROM b UNION ALL SELECT t, 0, 1 FROM b)
 SELECT node, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM d GROUP BY node""")
def _(spark, t):
    return g.degrees(g.build(edges(t)), "source", "target")


@query("G17_shortest_path", f"""WITH RECURSIVE {EDGES_SQL}, b AS (SELECT source_file AS s, target_file AS t FROM edges UNION SELECT regexp_replace(source_file, '[^/]*$', ''), source_file FROM edges),
 r(node, way, depth) AS (SELECT 'pkg1/f2.go', ['pkg1/f2.go'], 0 UNION ALL SELECT b.t, list_append(r.way, b.t), r.depth + 1 FROM r JOIN b ON b.s = r.node WHERE r.depth < 3 AND NOT list_contains(r.way, b.t) AND r.node <> 'pkg12/')
 SELECT way[i + 1] AS node, i AS place FROM (SELECT way FROM r WHERE node = 'pkg12/' ORDER BY depth, way LIMIT 1), LATERAL (SELECT unnest(range(len(way))) AS i)""")
def _(spark, t):
    way, _ = g.shortest_path(g.build(edges(t)), "pkg1/f2.go", "pkg12/")
    return spark.createDataFrame([(n, i) for i, n in enumerate(way)], "node string, place long")


@query("G18_subgraph_nodes", f"""WITH RECURSIVE {EDGES_SQL}, b AS (SELECT source_file AS s, target_file AS t FROM edges UNION SELECT regexp_replace(source_file, '[^/]*$', ''), source_file FROM edges),
 r(path, depth) AS (SELECT 'pkg2/', 0 UNION SELECT b.t, r.depth + 1 FROM r JOIN b ON b.s = r.path WHERE r.depth < 2) SELECT path, min(depth) AS depth FROM r GROUP BY path""")
def _(spark, t):
    nodes, _, _ = g.subgraph(g.build(edges(t)), spark.createDataFrame([("pkg2/",)], "path string"))
    return nodes.select("path", "depth")


@query("G19_impact", f"""WITH RECURSIVE {EDGES_SQL}, r(path, depth) AS (SELECT 'pkg3/f6.go', 0 UNION SELECT e.source_file, r.depth + 1 FROM r JOIN edges e ON e.target_file = regexp_replace(r.path, '[^/]*$', '') WHERE r.depth < 3)
 SELECT path, min(depth) AS depth FROM r GROUP BY path HAVING min(depth) > 0""")
def _(spark, t):
    return g.impact(edges(t), "pkg3/f6.go", 3)


@query("G20_callers", f"""WITH {EDGES_SQL}, d AS (SELECT DISTINCT source_file AS path FROM edges WHERE target_file = 'pkg3/'), i AS (SELECT DISTINCT source_file AS path FROM edges WHERE target_file IN (SELECT regexp_replace(path, '[^/]*$', '') FROM d))
 SELECT path, 'direct' AS kind FROM d UNION ALL SELECT path, 'transitive' FROM i WHERE path NOT IN (SELECT path FROM d) AND path <> 'pkg3/f6.go'""")
def _(spark, t):
    return g.callers(edges(t), "pkg3/f6.go")


@query("G21_neighbors", f"WITH {EDGES_SQL} SELECT DISTINCT target_file AS node, 'imports' AS kind FROM edges WHERE source_file = 'pkg3/' UNION SELECT source_file, 'imported_by' FROM edges WHERE target_file = 'pkg3/'")
def _(spark, t):
    return g.neighbors(edges(t), "pkg3/")


@query("G23_directory_callers", f"WITH {EDGES_SQL} SELECT DISTINCT source_file FROM edges WHERE rtrim(target_file, '/') = 'pkg4'")
def _(spark, t):
    return g.directory_callers(edges(t), "pkg4/")


@query("G11_replace_edges", f"WITH {EDGES_SQL} SELECT source_file, target_file FROM edges WHERE NOT starts_with(source_file, 'pkg1/') UNION ALL SELECT DISTINCT source_file, 'new/' FROM edges WHERE starts_with(source_file, 'pkg1/')")
def _(spark, t):
    e = edges(t)
    return g.replace_edges(e, e.where(F.col("source_file").startswith("pkg1/")).select("source_file", F.lit("new/").alias("target_file")))


@query("G15_expanded_chunks", """WITH c AS (SELECT source || '/' AS path, source || '/' || doc_id AS file_path, doc_id AS chunk_index FROM documents) SELECT path, file_path, chunk_index FROM c QUALIFY row_number() OVER (PARTITION BY path ORDER BY chunk_index, file_path) <= 3""")
def _(spark, t):
    chunks = t("documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.col("doc_id").alias("chunk_index"), F.lit("").alias("content"))
    paths = t("documents").select(F.concat("source", F.lit("/")).alias("path")).distinct().select("path", F.lit(0.5).alias("score"), F.lit(1).alias("depth"))
    return g.expanded_chunks(paths, chunks).select("path", "file_path", "chunk_index")


@query("J16_importless", f"WITH {EDGES_SQL}, f AS (SELECT DISTINCT source_file AS path FROM edges) SELECT path FROM f WHERE regexp_replace(path, '[^/]*$', '') NOT IN (SELECT target_file FROM edges WHERE target_file < 'pkg3/')")
def _(spark, t):
    e = edges(t)
    return g.importless_files(e.select(F.col("source_file").alias("path")).distinct(), e.where("target_file < 'pkg3/'"))


@query("G24_runtime_graph", "SELECT o_orderkey AS edge, s.n_name AS source_name, coalesce(t.n_name, 'target') AS target_name FROM orders JOIN nation s ON s.n_nationkey = o_orderkey % 25 LEFT JOIN nation t ON t.n_nationkey = o_custkey % 40")
def _(spark, t):
    e = t("orders").select(F.col("o_orderkey").alias("edge"), (F.col("o_orderkey") % 25).alias("source_project_id"), (F.col("o_custkey") % 40).alias("target_project_id"), F.lit("target").alias("target_name"), F.col("o_orderdate").alias("last_seen"))
    return g.runtime_graph(e, t("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))).select("edge", "source_name", "target_name")
