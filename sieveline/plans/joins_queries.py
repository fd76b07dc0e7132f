"""Joins, merges and set operations (J*, U*, M*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import codeintel, graph, joins, usage, writepath
from ..sources import files as sources
from .registry import query
from .tables import DEPS_SQL, FILES_SQL, deps, files


@query("J1_chunks_files", "SELECT o.o_orderkey AS chunk, c.c_name AS path FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey")
def _(spark, t):
    return t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("chunk"), F.col("c_name").alias("path"))


@query("J2_worktree_semi", "SELECT o_orderkey AS id FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def _(spark, t):
    f = t("orders").select(F.col("o_orderkey").alias("id"), F.lit(1).alias("project_id"), F.col("o_orderkey").alias("path"), F.lit("h").alias("hash"))
    m = t("lineitem").select(F.lit(1).alias("project_id"), F.col("l_orderkey").alias("path"), F.lit("h").alias("hash"), F.col("l_returnflag").alias("worktree"))
    return writepath.in_worktree(f, m, "R").select("id")


@query("J3_vector_dictionary", "SELECT d.doc_id, e.label IS NOT NULL AS has_vector FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id")
def _(spark, t):
    chunks = t("documents").select("doc_id", F.col("doc_id").cast("string").alias("emb_hash"))
    return writepath.with_vectors(chunks, t("embeddings").select(F.col("vec_id").cast("string").alias("emb_hash"), "embedding")).select("doc_id", F.col("embedding").isNotNull().alias("has_vector"))


@query("J4_cache_lookup", """WITH c AS (SELECT DISTINCT sha256(text) AS input_hash FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings))
 SELECT doc_id AS key, coalesce(sha256(text) IN (SELECT input_hash FROM c WHERE input_hash IS NOT NULL), false) AS hit FROM documents""")
def _(spark, t):
    d = t("documents").select(F.col("doc_id").alias("key"), "text")
    held = t("embeddings").select(F.col("vec_id").alias("key"), "embedding")
    cache = d.join(held, "key").groupBy(F.sha2("text", 256).alias("input_hash")).agg(F.any_value("embedding").alias("embedding")).withColumn("model", F.lit("m"))
    hits, misses = writepath.split_by_cache(d, cache, "m")
    return hits.select("key", F.lit(True).alias("hit")).unionByName(misses.select("key", F.lit(False).alias("hit")))


@query("J6_shared_dependencies", f"WITH {DEPS_SQL} SELECT DISTINCT a.project_id, b.project_id AS other_id, a.normalized_name FROM deps a JOIN deps b USING (tenant_id, ecosystem, normalized_name) WHERE a.project_id <> b.project_id AND a.project_id = 1")
def _(spark, t):
    return usage.shared_dependencies(deps(t), 1).select("project_id", "other_id", "normalized_name")


@query("E10_dependency_use", f"WITH {DEPS_SQL} SELECT normalized_name, count(*) AS projects, min(project_id) AS first_project FROM deps GROUP BY tenant_id, ecosystem, normalized_name HAVING count(*) > 1")
def _(spark, t):
    return usage.dependency_use(deps(t)).select("normalized_name", "projects", "first_project")


@query("J7_runtime_projects", "SELECT o_orderkey AS edge, s.n_name AS source_name, coalesce(r.r_name, 'external') AS target_name FROM orders JOIN nation s ON s.n_nationkey = o_orderkey % 25 LEFT JOIN region r ON r.r_regionkey = o_orderkey % 9")
def _(spark, t):
    e = t("orders").select(F.col("o_orderkey").alias("edge"), (F.col("o_orderkey") % 25).alias("source_project_id"), (100 + F.col("o_orderkey") % 9).alias("target_project_id"), F.lit("external").alias("target_name"), F.col("o_orderdate").alias("last_seen"))
    projects = t("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")).unionByName(t("region").select((100 + F.col("r_regionkey")).alias("id"), F.col("r_name").alias("name")))
    return graph.runtime_graph(e, projects).select("edge", "source_name", "target_name")


@query("J8_prune_files", "SELECT p_partkey AS id FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")
def _(spark, t):
    f = t("part").select(F.col("p_partkey").alias("id"), F.lit(1).alias("project_id"), F.col("p_partkey").cast("string").alias("path"), F.lit("h").alias("hash"))
    m = t("lineitem").where("l_quantity > 45").select(F.lit(1).alias("project_id"), F.col("l_partkey").cast("string").alias("path"), F.lit("h").alias("hash"))
    return writepath.prune_files(f, m).select("id")


@query("J9_prune_edges", "SELECT DISTINCT l_suppkey AS source_file, l_partkey AS target_file FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def _(spark, t):
    edges = t("lineitem").select(F.col("l_suppkey").alias("source_file"), F.col("l_partkey").alias("target_file")).distinct()
    return writepath.prune_edges(edges, t("supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("path")))


@query("J10_orphan_vectors", "SELECT c_custkey AS emb_hash FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def _(spark, t):
    return writepath.orphan_vectors(t("customer").select(F.col("c_custkey").alias("emb_hash")), t("orders").select(F.col("o_custkey").cast("long").alias("emb_hash")))


_SPANS = "c AS (SELECT p_partkey AS chunk, p_brand AS path, p_size * 10 AS start_line, p_size * 10 + 8 AS end_line FROM part), s AS (SELECT p_name AS name, p_partkey AS sym, p_brand AS path, p_size * 7 AS start_line, p_size * 7 + p_partkey % 5 AS end_line FROM part)"


def _spans(t):
    p = t("part")
    c = p.select(F.col("p_partkey").alias("chunk"), F.col("p_brand").alias("path"), (F.col("p_size") * 10).alias("start_line"), (F.col("p_size") * 10 + 8).alias("end_line"))
    s = p.select(F.concat("p_name", F.lit("#"), F.col("p_partkey").cast("string")).alias("name"), F.col("p_partkey").alias("sym"), F.col("p_brand").alias("path"), (F.col("p_size") * 7).alias("start_line"), (F.col("p_size") * 7 + F.col("p_partkey") % 5).cast("int").alias("end_line"))
    return c, s


@query("J11_interval_overlap", f"WITH {_SPANS} SELECT chunk, sym FROM c JOIN s ON c.path = s.path AND s.start_line <= c.end_line AND s.end_line >= c.start_line")
def _(spark, t):
    c, s = _spans(t)
    return joins.interval_overlap(c, s).select("chunk", "sym")


@query("J12_symbol_at_line", f"""WITH {_SPANS}, p AS (SELECT DISTINCT path, start_line + 3 AS line FROM c), n AS (SELECT *, name || '#' || CAST(sym AS VARCHAR) AS full_name FROM s)
 SELECT p.path, p.line, n.full_name AS name FROM p JOIN n ON p.path = n.path QUALIFY row_number() OVER (PARTITION BY p.path, p.line ORDER BY (n.start_line <= p.line AND n.end_line >= p.line) DESC, (n.start_line <= p.line) DESC,
 CASE WHEN n.start_line <= p.line THEN -n.start_line ELSE n.start_line END, n.full_name) = 1""")
def _(spark, t):
    c, s = _spans(t)
    return codeintel.symbol_at(c.select("path", (F.col("start_line") + 3).alias("line")).distinct(), s).select("path", "line", "name")


@query("J14_file_diff", f"""WITH {FILES_SQL}, a AS (SELECT path, sha256(content) AS hash FROM files), b AS (SELECT source || '/' || CAST(doc_id + 1 AS VARCHAR) || '.md' AS path, sha256(text) AS hash FROM documents)
 SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'deleted' ELSE 'stale' END AS state FROM a FULL JOIN b ON a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR a.hash <> b.hash""")
def _(spark, t):
    client = files(t).select("path", F.sha2("content", 256).alias("hash"))
    index = t("documents").select(F.concat("source", F.lit("/"), (F.col("doc_id") + 1).cast("string"), F.lit(".md")).alias("path"), F.sha2("text", 256).alias("hash"))
    return usage.file_diff(client, index)


@query("J18_staleness", "SELECT d.doc_id, (e.vec_id IS NULL OR e.label <> d.doc_id % 10) AS stale FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id")
def _(spark, t):
    d = t("documents").select("doc_id", F.col("doc_id").alias("path"))
    indexed = d.select("path", (F.col("path") % 10).cast("string").alias("hash"), F.lit(0).alias("indexed_at"))
    return usage.staleness(d, indexed, t("embeddings").select(F.col("vec_id").alias("path"), F.col("label").cast("string").alias("hash"))).select("doc_id", "stale")


@query("J22_enclosing_project", """WITH p AS (SELECT DISTINCT regexp_extract(url, '^(https?://[^/]+)', 1) AS root FROM pages) SELECT DISTINCT url AS path, root AS project FROM pages JOIN p ON url LIKE root || '/%' OR url = root""")
def _(spark, t):
    projects = t("pages").select(F.regexp_extract("url", r"^(https?://[^/]+)", 1).alias("path")).distinct().withColumn("name", F.col("path"))
    return usage.enclosing_project(t("pages").select(F.col("url").alias("path")).distinct(), projects)


@query("J23_ambiguous_names", "SELECT lower(p_name) AS name, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def _(spark, t):
    return usage.ambiguous_names(t("part").select(F.col("p_name").alias("name")))


@query("U5_merge_original_expanded", """WITH a AS (SELECT l_partkey AS path, max(l_tax) AS score FROM lineitem WHERE l_linenumber = 1 GROUP BY 1), b AS (SELECT l_partkey AS path, max(l_discount) AS score FROM lineitem WHERE l_linenumber = 2 GROUP BY 1)
 SELECT path, score FROM a UNION ALL SELECT path, score FROM b WHERE path NOT IN (SELECT path FROM a)""")
def _(spark, t):
    from ..operators.ranking import merge_expanded

    of = lambda n, c: t("lineitem").where(F.col("l_linenumber") == n).groupBy(F.col("l_partkey").alias("path")).agg(F.max(c).alias("score"))
    return merge_expanded(of(1, "l_tax"), of(2, "l_discount").withColumn("chunk_index", F.lit(0)))


@query("M6_not_up_to_date", "SELECT p_partkey AS path FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_linenumber = 1)")
def _(spark, t):
    f = t("part").select(F.col("p_partkey").alias("path"), F.lit("h").alias("hash"))
    stored = t("part").select(F.col("p_partkey").alias("path"), F.lit("h").alias("hash"), F.col("p_partkey").alias("id"))
    return writepath.not_up_to_date(f, stored, t("lineitem").where("l_linenumber = 1").select(F.col("l_partkey").alias("file_id"))).select("path")


@query("M7_upsert", """SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
 UNION ALL SELECT DISTINCT l_orderkey, 'returned' FROM lineitem WHERE l_returnflag = 'R'""")
def _(spark, t):
    old = t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    new = t("lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"), F.lit("returned").alias("status")).distinct()
    return writepath.upsert(old, new, ["id"])


@query("M5_embed_missing", "SELECT doc_id AS key, sha256(coalesce(text, '')) AS input_hash, CAST(256 AS BIGINT) AS dims FROM documents")
def _(spark, t):
    cache = t("documents").where("lang = 'en'").select(F.sha2("text", 256).alias("input_hash"), F.lit("hash").alias("model"), writepath.embed(F.col("text")).alias("embedding")).dropDuplicates(["input_hash"])
    out, _ = writepath.embed_missing(t("documents").select(F.col("doc_id").alias("key"), F.coalesce("text", F.lit("")).alias("text")), cache, "hash")
    return out.select("key", "input_hash", F.size("embedding").cast("long").alias("dims"))


@query("U7_models", "SELECT event_type AS model, min(event_id) AS at FROM events GROUP BY 1")
def _(spark, t):
    return t("events").groupBy(F.col("event_type").alias("model")).agg(F.min("event_id").alias("at"))


@query("S24_duplicate_paths", "SELECT o_orderstatus AS project, o_orderpriority AS path, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 1")
def _(spark, t):
    batches = t("orders").groupBy(F.col("o_orderstatus").alias("project")).agg(F.collect_list(F.struct(F.col("o_orderpriority").alias("path"), F.lit("").alias("content"))).alias("files"))
    return sources.duplicate_paths(batches)


@query("S27_page", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 50 OFFSET 100")
def _(spark, t):
    return sources.page(t("events").select("event_id", "ts"), [F.col("ts").desc(), F.col("event_id")], 50, 100)


@query("S26_export", "SELECT vec_id, label FROM embeddings WHERE label = 3 ORDER BY vec_id")
def _(spark, t):
    e = t("embeddings")
    chunks = e.select("vec_id", "label", F.col("label").alias("project_id"), F.col("vec_id").alias("file_id"), F.size("embedding").cast("long").alias("dims"), F.lit(0).alias("chunk_index"))
    return sources.export_chunks(chunks, e.select(F.col("vec_id").alias("id"), F.col("vec_id").cast("string").alias("path"), F.lit("").alias("hash")), 3).select("vec_id", "label")
