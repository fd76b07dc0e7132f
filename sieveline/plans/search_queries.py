"""Retrieval, fusion and ranking (W*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import cosine, norm
from ..operators import graph as g
from ..operators import ranking as r
from .registry import query
from .tables import EDGES_SQL, edges

_COS = "round(list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])) / (sqrt(list_dot_product(CAST({a} AS DOUBLE[]), CAST({a} AS DOUBLE[]))) * sqrt(list_dot_product(CAST({b} AS DOUBLE[]), CAST({b} AS DOUBLE[])))), 9)"
_VEC = _COS.format(a="e.embedding", b="q.embedding")
WORDS = ["with", "that", "pour", "und", "los"]
_COVER = " + ".join(f"CASE WHEN text ILIKE '%{w}%' THEN 1 ELSE 0 END" for w in WORDS)
#: The two legs of the flagship query: cosine to the first vector, coverage of a few words; 50 rows each.
_LEGS = f"""v AS (SELECT e.vec_id AS path, {_VEC} AS score, row_number() OVER (ORDER BY {_VEC} DESC, e.vec_id) AS r1 FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q QUALIFY r1 <= 50),
 w AS (SELECT doc_id AS path, CAST({_COVER} AS DOUBLE) AS score, row_number() OVER (ORDER BY {_COVER} DESC, doc_id) AS r2 FROM documents WHERE {_COVER} > 0 QUALIFY r2 <= 50)"""


def first_vector(t):
    return t("embeddings").where("vec_id = 0").select(F.col("embedding").alias("qvec"), norm(F.col("embedding")).alias("qnorm"))


def legs(t):
    e = t("embeddings").join(F.broadcast(first_vector(t)), F.lit(True))
    v = e.select(F.col("vec_id").alias("path"), F.round(cosine(F.col("embedding"), F.col("qvec"), norm_b=F.col("qnorm")), 9).alias("score")).orderBy(F.col("score").desc(), "path").limit(50)
    d = t("documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    w = r.keyword_coverage(d, WORDS, 50, key="path").select("path", "score")
    return r.with_rank(v, F.col("score").desc(), F.col("path")), r.with_rank(w, F.col("score").desc(), F.col("path"))


@query("W8_hybrid_rrf", f"""WITH {_LEGS}, f AS (SELECT coalesce(v.path, w.path) AS path, r1, r2, round(coalesce(1.0 / (60 + r1), 0) + coalesce(1.0 / (60 + r2), 0) + CASE WHEN r1 IS NOT NULL AND r2 IS NOT NULL THEN 0.02 ELSE 0 END, 9) AS raw FROM v FULL JOIN w ON v.path = w.path)
 SELECT path, round(raw / max(raw) OVER (), 9) AS score, CASE WHEN r1 IS NOT NULL THEN 'vector' ELSE 'keyword' END AS source, row_number() OVER (ORDER BY raw DESC, r1 NULLS LAST, r2 NULLS LAST) AS rank FROM f QUALIFY rank <= 10""")
def _(spark, t):
    v, w = legs(t)
    return r.fuse_rrf(v, w, 10, keys=("path",)).withColumn("score", F.round("score", 9))


@query("W1_similar", f"SELECT e.vec_id, {_VEC} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY score DESC, e.vec_id LIMIT 20")
def _(spark, t):
    q = list(t("embeddings").where("vec_id = 0").first().embedding)
    return r.similar(t("embeddings"), q, 20, key="vec_id").select("vec_id", F.round("score", 9).alias("score"))


@query("W4_batch_knn", f"SELECT q.vec_id AS qid, e.vec_id AS key, {_VEC} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_VEC} DESC, e.vec_id) AS rank FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q QUALIFY rank <= 10")
def _(spark, t):
    q = t("embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    return r.knn(t("embeddings"), q, 10, key="vec_id")


@query("W5_keyword_coverage", f"SELECT doc_id, CAST({_COVER} AS DOUBLE) AS score FROM documents WHERE {_COVER} > 0 ORDER BY score DESC, doc_id LIMIT 30")
def _(spark, t):
    return r.keyword_coverage(t("documents"), WORDS, 30, text="text", key="doc_id").select("doc_id", "score")


_TERMS = "['with','pour','und']"


@query("W6_bm25", f"""WITH tok AS (SELECT doc_id, list_filter(string_split_regex(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS ts FROM documents),
 p AS (SELECT doc_id, len(ts) AS dl, unnest(ts) AS term FROM tok), f AS (SELECT doc_id, dl, term, count(*) AS tf FROM p WHERE term IN ('with', 'pour', 'und') GROUP BY ALL),
 n AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM tok), df AS (SELECT term, count(*) AS df FROM f GROUP BY term)
 SELECT doc_id AS key, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM f JOIN df USING (term), n GROUP BY doc_id ORDER BY score DESC, key LIMIT 40""")
def _(spark, t):
    d = t("documents")
    totals = d.agg(F.count("*").alias("n"), F.avg(F.size(r.tokens_of(F.col("text")))).alias("avgdl"))
    terms = ["with", "pour", "und"]
    scored = r.bm25(r.postings(d, text="text", key="doc_id", terms=terms), totals, terms).withColumn("score", F.round("score", 6))
    return scored.orderBy(F.col("score").desc(), "key").limit(40)


@query("W7_ranks", "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS rank FROM lineitem")
def _(spark, t):
    return r.with_rank(t("lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), F.col("l_extendedprice").desc(), F.col("l_linenumber"), partition=["l_orderkey"]).drop("l_extendedprice")


_RES = "res AS (SELECT l_suppkey AS project, l_partkey % 50 AS path, l_linenumber AS start_line, l_linenumber AS end_line, l_extendedprice AS score, (l_orderkey * 10 + l_linenumber) * 100000 + l_partkey AS source_rank FROM lineitem)"


def results(t):
    li = t("lineitem")
    return li.select(F.col("l_suppkey").alias("project"), (F.col("l_partkey") % 50).alias("path"), F.col("l_linenumber").alias("start_line"), F.col("l_linenumber").alias("end_line"), F.col("l_extendedprice").alias("score"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100000 + F.col("l_partkey")).alias("source_rank"))


@query("W10_fuse_projects", f"""WITH {_RES}, k AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY source_rank) AS r FROM res)
 SELECT project, path, start_line, end_line, round(sum(1.0 / (60 + r)), 4) AS fusion, max(score) AS score, arg_min(source_rank, r) AS source_rank FROM k GROUP BY 1, 2, 3, 4""")
def _(spark, t):
    return r.fuse_projects(results(t)).withColumn("fusion", F.round("fusion", 4))


@query("W11_over_fetch", f"WITH {_RES} SELECT project, path, start_line, score, row_number() OVER (PARTITION BY project ORDER BY score DESC, path, start_line) AS source_rank FROM res QUALIFY row_number() OVER (PARTITION BY project ORDER BY score DESC, path, start_line) <= 10")
def _(spark, t):
    return r.over_fetch(results(t), 5).select("project", "path", "start_line", "score", "source_rank")


@query("W12_diversity", f"""WITH {_RES}, a AS (SELECT *, row_number() OVER (PARTITION BY project, path ORDER BY source_rank) AS f FROM res QUALIFY f <= 2), b AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY source_rank) AS p FROM a QUALIFY p <= 5)
 SELECT project, path, source_rank AS rank FROM b ORDER BY source_rank LIMIT 60""")
def _(spark, t):
    return r.diversify(results(t).select("project", "path", F.col("source_rank").alias("rank")), 2, 5, 60)


@query("W13_rerank", f"""WITH {_LEGS}, h AS (SELECT w.path, w.score, r2, lower(text) AS low FROM w JOIN documents ON doc_id = path), b AS (SELECT path, r2, score, round(0.7 * score + 0.3 * len(list_filter({_TERMS}, lambda x: contains(low, x))) / 3, 9) AS blend FROM h)
 SELECT path, score, blend, row_number() OVER (ORDER BY blend DESC, r2) AS rank FROM b""")
def _(spark, t):
    d = t("documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    return r.lexical_rerank(legs(t)[1].join(d, "path"), "with pour und").select("path", "score", "blend", "rank")


@query("W15_hubs", f"WITH {EDGES_SQL} SELECT source_file AS node, count(*) AS out_degree FROM edges GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 16")
def _(spark, t):
    return g.hubs(edges(t)).select("node", "out_degree")


@query("W17_chunks_by_prefix", """WITH c AS (SELECT 'docs/' || coalesce(source, 'none') || '/' || doc_id || '.md' AS file_path, doc_id AS chunk_index FROM documents)
 SELECT 'docs/src1/' AS path, file_path, chunk_index FROM (SELECT * FROM c WHERE starts_with(file_path, 'docs/src1/') ORDER BY chunk_index, file_path LIMIT 3)
 UNION ALL SELECT 'docs/', file_path, chunk_index FROM (SELECT * FROM c ORDER BY chunk_index, file_path LIMIT 3) UNION ALL SELECT 'docs/none.md', 'docs/none.md', 0""")
def _(spark, t):
    file = F.concat(F.lit("docs/"), F.coalesce("source", F.lit("none")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    chunks = t("documents").select(file.alias("path"), F.col("doc_id").alias("chunk_index"), F.lit("").alias("content"))
    paths = spark.createDataFrame([("docs/src1/", 0.5, 1), ("docs/", 0.5, 1), ("docs/none.md", 0.5, 1)], "path string, score double, depth int")
    return g.expanded_chunks(paths, chunks).select("path", "file_path", "chunk_index")


@query("W18_pack_context", f"""WITH {_LEGS}, b AS (SELECT r2 AS rank, strlen(text) AS n FROM w JOIN documents ON doc_id = path), s AS (SELECT rank, n, sum(n) OVER (ORDER BY rank) AS total FROM b)
 SELECT rank FROM s WHERE n <= 32000 - (total - n) OR 32000 - (total - n) >= 60""")
def _(spark, t):
    d = t("documents").select(F.col("doc_id").alias("path"), F.col("text").alias("block"))
    return r.pack_context(legs(t)[1].join(d, "path"), 32_000).select("rank")


@query("W19_chat_window", """WITH c AS (SELECT *, count(*) FILTER (WHERE role = 'user') OVER (PARTITION BY conv_id ORDER BY turn DESC) AS users, count(*) FILTER (WHERE role <> 'system') OVER (PARTITION BY conv_id ORDER BY turn) AS other FROM conversations)
 SELECT conv_id, turn FROM c WHERE other = 0 OR users < 2 OR (users = 2 AND role = 'user')""")
def _(spark, t):
    return r.chat_window(t("conversations"), 2).select("conv_id", "turn")


@query("U3_append_legs", f"WITH {_LEGS} SELECT path, score, leg FROM (SELECT path, score, 0 AS leg FROM v UNION ALL SELECT path, 0.0, 1 FROM w WHERE path NOT IN (SELECT path FROM v)) ORDER BY leg, score DESC, path LIMIT 70")
def _(spark, t):
    v, w = legs(t)
    return r.append_leg(v.select("path", "score"), w.select("path", "score"), 70, key="path")
