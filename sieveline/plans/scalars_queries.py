"""Scalar functions and predicates over whole tables (F*, P*, W14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as s
from ..operators.usage import merge_runtime_edges
from ..sources.files import eligible, is_code_file, should_index
from .registry import query
from .tables import FILES_SQL, files

_EXTS = "['.md','.go','.py','.png','.env','.tsx','.pem','','.html','.unknown']"
_NAMES_SQL = f"paths AS (SELECT p_partkey AS id, replace(p_type, ' ', '/') || CASE p_partkey % 4 WHEN 0 THEN '/vendor' WHEN 1 THEN '/auth_token' ELSE '/src' END || '/' || CASE WHEN p_partkey % 10 = 7 THEN 'Makefile' ELSE 'f' || CAST(p_partkey AS VARCHAR) END || {_EXTS}[1 + p_partkey % 10] AS path FROM part)"


def _paths(t):
    k = F.col("p_partkey")
    ext = F.element_at(F.array(*map(F.lit, (".md", ".go", ".py", ".png", ".env", ".tsx", ".pem", "", ".html", ".unknown"))), (k % 10 + 1).cast("int"))
    mid = F.when(k % 4 == 0, "/vendor").when(k % 4 == 1, "/auth_token").otherwise("/src")
    name = F.when(k % 10 == 7, "Makefile").otherwise(F.concat(F.lit("f"), k.cast("string")))
    return t("part").select(k.alias("id"), F.concat(F.replace("p_type", F.lit(" "), F.lit("/")), mid, F.lit("/"), name, ext).alias("path"))


@query("F1_hashes", "SELECT doc_id, sha256(text) AS h, CASE WHEN trim(text) = '' THEN '' ELSE sha256(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) END AS q FROM documents")
def _(spark, t):
    return t("documents").select("doc_id", s.sha256_hex(F.col("text")).alias("h"), s.query_hash(F.col("text")).alias("q"))


@query("F2_fields", "SELECT doc_id, len(regexp_extract_all(text, '\\S+')) AS n FROM documents")
def _(spark, t):
    return t("documents").select("doc_id", F.size(s.fields(F.col("text"))).cast("long").alias("n"))


@query("F3_paths", f"WITH {_NAMES_SQL} SELECT id, regexp_replace(path, '/[^/]*$', '') AS dir, regexp_extract(path, '[^/]*$') AS base, lower(regexp_extract(path, '(\\.[^./]*)$', 1)) AS ext FROM paths")
def _(spark, t):
    p = F.col("path")
    return _paths(t).select("id", s.dirname(p).alias("dir"), s.basename(p).alias("base"), s.extension(p).alias("ext"))


@query("F4_lines", "SELECT doc_id, 1 + length(text) - length(replace(text, chr(10), '')) AS n FROM documents")
def _(spark, t):
    return t("documents").select("doc_id", s.line_of(F.col("text"), F.octet_length("text")).cast("long").alias("n"))


@query("F5_first_line", "SELECT doc_id, coalesce(trim(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')[1]), '') AS line, doc_id || ':' || 3 || '-' || 9 AS loc FROM documents")
def _(spark, t):
    return t("documents").select("doc_id", s.first_non_empty_line(F.col("text")).alias("line"), s.location(F.col("doc_id").cast("string"), F.lit(3), F.lit(9)).alias("loc"))


@query("F6_grep_rows", "SELECT source || ':' || doc_id || ':' || coalesce(trim(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')[1]), '') AS row FROM documents")
def _(spark, t):
    return t("documents").select(s.grep_row(F.col("source"), F.col("doc_id"), F.col("text")).alias("row"))


@query("F6_rfc3339", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at FROM events")
def _(spark, t):
    return t("events").select("event_id", s.rfc3339(F.col("ts")).alias("at"))


@query("F7_retry_seconds", "SELECT event_id, greatest(1, CAST(ceil(value * 100 / 1000.0) AS BIGINT)) AS seconds FROM events")
def _(spark, t):
    return t("events").select("event_id", s.retry_seconds(F.col("value") * 100).alias("seconds"))


@query("F8_vector_norms", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 6) AS n FROM embeddings")
def _(spark, t):
    return t("embeddings").select("vec_id", F.round(s.norm(F.col("embedding")), 6).alias("n"))


@query("F9_vector_codec", "SELECT vec_id, CAST(4 * len(embedding) AS BIGINT) AS n_bytes, true AS same FROM embeddings")
def _(spark, t):
    from ..operators.writepath import decode_vector, encode_vector

    raw = encode_vector(F.col("embedding"))
    return t("embeddings").select("vec_id", F.octet_length(raw).cast("long").alias("n_bytes"), (decode_vector(raw) == F.col("embedding")).alias("same"))


@query("F10_gain_discount", "SELECT event_id, round(pow(2, event_id % 4) - 1, 9) AS gain, round(log2(event_id % 10 + 2), 9) AS discount FROM events")
def _(spark, t):
    return t("events").select("event_id", F.round(s.gain(F.col("event_id") % 4), 9).alias("gain"), F.round(s.discount(F.col("event_id") % 10 + 1), 9).alias("discount"))


@query("F11_dims", "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 768 WHEN p_partkey % 3 = 1 THEN 3072 ELSE 0 END AS dims FROM part")
def _(spark, t):
    model = F.when(F.col("p_partkey") % 3 == 0, "Nomic-embed").when(F.col("p_partkey") % 3 == 1, "text-embedding-3-large").otherwise(F.col("p_name"))
    return t("part").select(F.col("p_partkey").alias("id"), s.infer_dims(model).alias("dims"))


@query("F12_outcomes", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'empty' WHEN event_id % 3 = 0 OR event_id % 5 = 0 THEN 'fallback' ELSE 'ok' END AS outcome FROM events")
def _(spark, t):
    e = F.col("event_id")
    return t("events").select("event_id", s.classify_outcome(e % 4, e % 3 == 0, e % 5 == 0).alias("outcome"))


@query("F13_hosts", "SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host, lower(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '/+$', '')) AS remote FROM pages")
def _(spark, t):
    return t("pages").select("page_id", s.host_of(F.col("url")).alias("host"), s.normalize_remote(F.col("url")).alias("remote"))


@query("F14_languages", f"WITH {_NAMES_SQL} SELECT id, CASE lower(regexp_extract(path, '(\\.[^./]*)$', 1)) WHEN '.md' THEN 'markdown' WHEN '.go' THEN 'go' WHEN '.py' THEN 'python' WHEN '.tsx' THEN 'tsx' WHEN '.html' THEN 'html' ELSE '' END AS lang FROM paths")
def _(spark, t):
    return _paths(t).select("id", s.detect_language(F.col("path")).alias("lang"))


@query("F15_since", "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAYS")
def _(spark, t):
    last = t("events").agg(F.max("ts").alias("now"))
    return t("events").join(F.broadcast(last), F.lit(True)).where(F.col("ts") >= s.since(F.col("now"), F.lit(7))).select("event_id")


@query("F16_file_line", "SELECT doc_id, source AS path, doc_id AS line FROM documents WHERE doc_id > 0")
def _(spark, t):
    parsed = s.parse_file_line(F.concat("source", F.lit(":"), F.col("doc_id").cast("string")))
    return t("documents").select("doc_id", parsed.alias("p")).where("p is not null").select("doc_id", "p.path", F.col("p.line").cast("long").alias("line"))


@query("F17_ranges", """SELECT l_partkey AS part, CAST(sum(l_orderkey % 9 - 1) AS BIGINT) AS request_count, min(least(l_quantity, l_tax * 100)) AS first_seen, max(greatest(l_quantity, l_tax * 100)) AS last_seen
 FROM lineitem WHERE l_orderkey % 9 >= 1 GROUP BY 1""")
def _(spark, t):
    calls = t("lineitem").select(
        F.col("l_partkey").alias("part"), (F.col("l_orderkey") % 9 - 1).cast("long").alias("request_count"), F.lit(0).cast("long").alias("error_count"), F.lit(1.0).alias("p95_latency_ms"),
        F.col("l_quantity").cast("double").alias("first_seen"), (F.col("l_tax") * 100).cast("double").alias("last_seen"), F.monotonically_increasing_id().alias("seq"),
    )
    merged = merge_runtime_edges(calls.drop("seq").limit(0), calls, ["part"])
    return merged.select("part", "request_count", "first_seen", "last_seen")


@query("F18_rerank_terms", "SELECT item_id, len(list_distinct(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: strlen(x) >= 2))) AS n FROM benchmark")
def _(spark, t):
    return t("benchmark").select("item_id", F.size(s.rerank_terms(F.col("text"))).cast("long").alias("n"))


@query("P1_scope", "SELECT c_custkey FROM customer WHERE c_nationkey = 3")
def _(spark, t):
    return t("customer").where(s.scope(F.col("c_nationkey"), F.lit(0), 3)).select("c_custkey")


@query("P3_has_vector", "SELECT count(*) AS n FROM embeddings WHERE embedding IS NOT NULL")
def _(spark, t):
    return t("embeddings").where(F.col("embedding").isNotNull()).agg(F.count("*").alias("n"))


@query("P4_any_word", "SELECT doc_id FROM documents WHERE text ILIKE '%with%' OR text ILIKE '%dans%' OR text ILIKE '%und_r%'")
def _(spark, t):
    return t("documents").where(s.any_word_like(F.col("text"), ["with", "dans", "und_r"])).select("doc_id")


@query("P5_prefix", f"WITH {_NAMES_SQL} SELECT id FROM paths WHERE path LIKE 'STANDARD%'")
def _(spark, t):
    return _paths(t).where(s.under_prefix(F.col("path"), F.lit("STANDARD"))).select("id")


_SENS = "['env','secret','key','password','credential','token','auth','config','db','database','private','pem','jwks','cert','ssl']"


@query("P6_sensitive", f"WITH {_NAMES_SQL} SELECT id, (list_has_any(string_split_regex(lower(path), '[/._\\-]'), {_SENS}) OR lower(regexp_extract(path, '(\\.[^./]*)$', 1)) IN ('.env','.pem','.key','.conf','.config')) AS sensitive FROM paths")
def _(spark, t):
    return _paths(t).select("id", s.is_sensitive(F.col("path")).alias("sensitive"))


@query("P7_privacy_mode", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'cloud' WHEN 1 THEN 'hybrid' WHEN 2 THEN 'edge' END AS mode FROM events")
def _(spark, t):
    raw = F.element_at(F.array(*map(F.lit, (" Cloud", "", "EDGE ", "other"))), (F.col("event_id") % 4 + 1).cast("int"))
    return t("events").select("event_id", s.privacy_mode(raw).alias("mode"))


@query("P8_search_words", """WITH w AS (SELECT item_id, u.word, u.pos FROM (SELECT item_id, string_split_regex(text, '\\s+') AS ws FROM benchmark), LATERAL (SELECT unnest(ws) AS word, generate_subscripts(ws, 1) AS pos) u),
 f AS (SELECT item_id, word, pos, row_number() OVER (PARTITION BY item_id, lower(word) ORDER BY pos) AS k FROM w WHERE strlen(word) BETWEEN 3 AND 256),
 r AS (SELECT item_id, word, row_number() OVER (PARTITION BY item_id ORDER BY pos) AS rn FROM f WHERE k = 1) SELECT item_id, string_agg(word, ' ' ORDER BY rn) AS words FROM r WHERE rn <= 20 GROUP BY 1""")
def _(spark, t):
    return t("benchmark").select("item_id", F.array_join(s.search_words(F.col("text")), " ").alias("words"))


_Q = "q AS (SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN '\"' || p_name || '\"' WHEN 1 THEN replace(p_name, ' ', '/') WHEN 2 THEN p_name WHEN 3 THEN replace(p_name, ' ', '_') ELSE '' END AS q FROM part)"


@query("P9_classify_query", f"""WITH {_Q}, k AS (SELECT id, q, CASE WHEN q = '' THEN 'unknown' WHEN q LIKE '"%"' AND length(q) >= 2 THEN 'exact' WHEN contains(q, '/') THEN 'path' WHEN regexp_matches(q, '[ \\t\\n]') THEN 'natural_language'
 WHEN regexp_full_match(q, '[A-Za-z_][A-Za-z0-9_.]*') THEN 'identifier' ELSE 'natural_language' END AS kind FROM q)
 SELECT id, kind, kind IN ('identifier', 'path', 'exact') AS by_keyword, CASE WHEN kind = 'exact' THEN substr(q, 2, length(q) - 2) ELSE q END AS keyword_query FROM k""")
def _(spark, t):
    k, n = F.col("p_partkey"), F.col("p_name")
    q = F.when(k % 5 == 0, F.concat(F.lit('"'), n, F.lit('"'))).when(k % 5 == 1, F.replace(n, F.lit(" "), F.lit("/"))).when(k % 5 == 2, n).when(k % 5 == 3, F.replace(n, F.lit(" "), F.lit("_"))).otherwise("")
    rows = t("part").select(k.alias("id"), q.alias("q"))
    kind = s.classify_query(F.col("q"))
    return rows.select("id", kind.alias("kind"), s.routes_to_keyword(kind).alias("by_keyword"), s.keyword_query(F.col("q")).alias("keyword_query"))


@query("P10_list_files", f"WITH {FILES_SQL} SELECT path FROM files WHERE starts_with(path, 'src1') AND contains(lower(path), '3') ORDER BY path LIMIT 25 OFFSET 5")
def _(spark, t):
    from ..sources.files import list_files

    return list_files(files(t).select("path"), "src1", "3", 25, 5)


@query("P12_relative_paths", "SELECT p_partkey AS id, p_partkey % 3 = 1 AS ok FROM part")
def _(spark, t):
    raw = F.element_at(F.array(*map(F.lit, ("../up/x.go", "a/../b.go", "/abs.go"))), (F.col("p_partkey") % 3 + 1).cast("int"))
    return t("part").select(F.col("p_partkey").alias("id"), s.valid_relative_path(raw).alias("ok"))


@query("P13_package_dirs", f"WITH {_NAMES_SQL} SELECT id, regexp_replace(path, '/[^/]*$', '') || '/' AS dir FROM paths")
def _(spark, t):
    return _paths(t).select("id", s.package_dir(F.col("path")).alias("dir"))


@query("S2_should_index", f"WITH {_NAMES_SQL} SELECT id, NOT contains(path, '/vendor/') AND (CASE WHEN id % 10 = 7 THEN true ELSE lower(regexp_extract(path, '(\\.[^./]*)$', 1)) IN ('.md', '.go', '.py', '.tsx') END) AS ok, lower(regexp_extract(path, '(\\.[^./]*)$', 1)) IN ('.go', '.py', '.tsx') OR id % 10 = 7 AS code FROM paths")
def _(spark, t):
    p = F.col("path")
    return _paths(t).select("id", should_index(p).alias("ok"), is_code_file(p).alias("code"))


@query("S3_eligible", f"WITH {_NAMES_SQL} SELECT id FROM paths WHERE (NOT contains(path, '/vendor/') AND (id % 10 = 7 OR lower(regexp_extract(path, '(\\.[^./]*)$', 1)) IN ('.md', '.go', '.py', '.tsx'))) OR lower(path) LIKE '%.html'")
def _(spark, t):
    return _paths(t).where(eligible(F.col("path"))).select("id")


@query("W14_clamps", "SELECT event_id, CASE WHEN event_id % 2000 = 0 THEN 5 ELSE least(event_id % 2000, 1000) END AS k, CASE WHEN event_id % 9 = 0 THEN 2 ELSE least(event_id % 9, 5) END AS depth FROM events")
def _(spark, t):
    return t("events").select("event_id", s.clamp_top_k(F.col("event_id") % 2000).alias("k"), s.clamp_depth(F.col("event_id") % 9).alias("depth"))
