"""Extraction, chunking, code intelligence and catalogs (S*, C*, E*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.imports import import_edges
from ..functions.symbols import symbols
from ..operators import codeintel
from ..operators.graph import importless_files  # noqa: F401  part of E3's plan
from ..sources import chunking, extract
from .registry import query
from .tables import EDGES_SQL, FILES_SQL, edges, files


@query("S5_extract_pages")
def _(spark, t):
    raw = t("pages").select(F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.encode("html", "utf-8").alias("content"))
    return extract.extracted(raw).select("path", F.char_length("text").alias("n_chars"), "error")


@query("S7_html_text")
def _(spark, t):
    raw = t("pages").select(F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.encode("html", "utf-8").alias("content"))
    return extract.extracted(raw).select("path", F.sha2("text", 256).alias("hash"))


@query("S8_normalize", "SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(text, '[ \\t\\r]+(\\n|\\z)', '\\1', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+\\z', '', 'g')) AS h FROM documents")
def _(spark, t):
    return t("documents").select("doc_id", F.sha2(extract.normalize_column(F.col("text")), 256).alias("h"))


@query("S18_declarations", "SELECT p_partkey AS id, 'Messages: ' || p_name || chr(10) || 'message ' || p_name || ' {}' AS text FROM (SELECT p_partkey, regexp_extract(p_name, '\\w+') AS p_name FROM part)")
def _(spark, t):
    name = F.regexp_extract("p_name", r"\w+", 0)
    return t("part").select(F.col("p_partkey").alias("id"), extract.declared_column("proto", F.concat(F.lit("message "), name, F.lit(" {}"))).alias("text"))


@query("S19_strip_markup", "SELECT page_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->|<\\?.*?\\?>', '', 'g'), '<[^>]+>', ' ', 'g'), '[ \\t\\r]+(\\n|\\z)', '\\1', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+\\z', '', 'g')) AS h FROM pages")
def _(spark, t):
    return t("pages").select("page_id", F.sha2(extract.stripped_column("xml", F.col("html")), 256).alias("h"))


@query("C2_paragraphs", "SELECT doc_id, len(list_filter(list_transform(string_split_regex(text, '\\n[ \\t\\r]*\\n'), lambda x: trim(x)), lambda x: x <> '')) AS n FROM documents")
def _(spark, t):
    return t("documents").select("doc_id", F.size(chunking.paragraphs(F.col("text"))).cast("long").alias("n"))


@query("C1_chunks")
def _(spark, t):
    return chunking.explode_chunks(files(t)).select("id", "chunk_index", "start_line", "end_line", F.octet_length("content").alias("n_bytes"))


@query("C3_prose_chunks")
def _(spark, t):
    return chunking.explode_chunks(files(t), 1000, "prose").select("id", "chunk_index", "start_line", "end_line", F.octet_length("content").alias("n_bytes"))


@query("C5_symbol_chunks", """SELECT p_partkey AS id, i AS chunk_index, [1, 3, 6][i + 1] AS start_line, [1, 4, 7][i + 1] AS end_line,
 ['import os', '[function] f' || p_partkey || chr(10) || 'def f' || p_partkey || '():' || chr(10) || '    return ' || chr(39) || p_name || chr(39), '[class] C' || chr(10) || 'class C:' || chr(10) || '    x = 1'][i + 1] AS content FROM part, (SELECT unnest(range(3))::INTEGER AS i)""")
def _(spark, t):
    code = t("part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("f"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("path"), F.concat(F.lit("import os\n\ndef f"), F.col("p_partkey").cast("string"), F.lit("():\n    return '"), F.col("p_name"), F.lit("'\n\nclass C:\n    x = 1\n")).alias("content"))
    return chunking.explode_chunks(code, 4000, "symbols").select("id", "chunk_index", "start_line", "end_line", "content")


@query("C6_capped_chunks", """WITH c AS (SELECT l_returnflag AS project, CAST(l_partkey AS VARCHAR) AS path, l_orderkey * 10 + l_linenumber AS chunk_index FROM lineitem), k AS (SELECT *, row_number() OVER (PARTITION BY project, path ORDER BY chunk_index) AS k FROM c),
 n AS (SELECT project, path, count(*) AS n FROM c GROUP BY 1, 2), b AS (SELECT *, sum(n) OVER (PARTITION BY project ORDER BY path) - n AS before FROM n) SELECT project, path, chunk_index FROM k JOIN b USING (project, path) WHERE before + k <= 500""")
def _(spark, t):
    c = t("lineitem").select(F.col("l_returnflag").alias("project"), F.col("l_partkey").cast("string").alias("path"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("chunk_index"))
    return chunking.cap_chunks(c, 1 << 40, 500)


_SYMS = "s AS (SELECT p_brand AS path, list(struct_pack(name := p_name, kind := p_type, start_line := p_size, end_line := p_size + 3) ORDER BY p_partkey) AS syms FROM part GROUP BY 1)"


def _chunks_and_symbols(t):
    p = t("part").where("p_brand is not null")
    symbols = p.select(F.col("p_brand").alias("path"), F.col("p_partkey").alias("at"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"), F.col("p_size").alias("start_line"), (F.col("p_size") + 3).alias("end_line"))
    return p.select("p_partkey", F.col("p_brand").alias("path"), F.col("p_name").alias("content"), (F.col("p_size") + 1).alias("start_line"), (F.col("p_size") + 4).alias("end_line")), symbols


@query("C7_chunk_inputs", f"""WITH {_SYMS}, h AS (SELECT p_partkey, p_name, list_filter(syms, lambda x: x.start_line <= p_size + 4 AND x.end_line >= p_size + 1) AS here FROM part JOIN s ON path = p_brand)
 SELECT p_partkey, sha256('Symbols: ' || list_aggregate(list_transform(here[1:20], lambda x: x.kind || ' ' || x.name), 'string_agg', ', ') || CASE WHEN len(here) > 20 THEN '...' ELSE '' END || chr(10) || p_name) AS h FROM h""")
def _(spark, t):
    return chunking.listed_inputs(*_chunks_and_symbols(t)).select("p_partkey", F.sha2("input", 256).alias("h"))


@query("C8_classify_chunks", f"""WITH {_SYMS}, c AS (SELECT p_partkey, list_filter(syms, lambda x: x.start_line BETWEEN p_size + 1 AND p_size + 4)[1].name AS d, list_filter(syms, lambda x: x.start_line <= p_size + 4 AND x.end_line >= p_size + 1)[1].name AS o,
 list_filter(syms, lambda x: contains(p_name, x.name))[1].name AS m FROM part JOIN s ON path = p_brand) SELECT p_partkey, CASE WHEN d IS NOT NULL THEN 'EXTRACTED' WHEN coalesce(o, m) IS NOT NULL THEN 'INFERRED' ELSE 'AMBIGUOUS' END AS confidence, coalesce(d, o, m, '') AS symbol FROM c""")
def _(spark, t):
    return chunking.classify_chunks(*_chunks_and_symbols(t)).select("p_partkey", "confidence", "symbol")


@query("G1_import_edges", "SELECT 'src/f' || p_partkey || '.py' AS source_file, 'app/part' || p_partkey % 9 || '/' AS target_file FROM part")
def _(spark, t):
    k = F.col("p_partkey")
    f = t("part").select(F.concat(F.lit("src/f"), k.cast("string"), F.lit(".py")).alias("path"), F.concat(F.lit("import os\nfrom app.part"), (k % 9).cast("string"), F.lit(" import x\nfrom json import loads\n")).alias("content"))
    return import_edges(f)


@query("E1_symbols", "SELECT p_partkey AS id, 'F' || p_partkey AS name, 'function' AS kind, 3 AS start_line, 5 AS end_line FROM part UNION ALL SELECT p_partkey, 'T' || p_partkey, 'type', 7, 8 FROM part")
def _(spark, t):
    k = F.col("p_partkey").cast("string")
    f = t("part").select(F.col("p_partkey").alias("id"), F.lit("a.go").alias("path"), F.concat(F.lit("package a\n\nfunc F"), k, F.lit("() {\n\treturn\n}\n\ntype T"), k, F.lit(" struct {\n}\n")).alias("content"))
    return f.select("id", F.explode(symbols(F.col("path"), F.col("content"))).alias("s")).select("id", "s.*")


@query("E3_dead_code", f"""WITH {EDGES_SQL}, f AS (SELECT DISTINCT source_file AS path, CASE WHEN length(source_file) % 2 = 0 THEN 'Run' ELSE 'run' END AS name FROM edges)
 SELECT path, name, CASE WHEN name = 'Run' THEN 'public-api' ELSE 'confirmed' END AS confidence FROM f WHERE regexp_replace(path, '[^/]*$', '') NOT IN (SELECT target_file FROM edges WHERE target_file < 'pkg3/')""")
def _(spark, t):
    e = edges(t)
    s = e.select(F.col("source_file").alias("path")).distinct().select("path", F.when(F.length("path") % 2 == 0, "Run").otherwise("run").alias("name"), F.lit("function").alias("kind"), F.lit(1).alias("start_line"))
    return codeintel.dead_code(s, e.where("target_file < 'pkg3/'")).select("path", "name", "confidence")


@query("E4_symbol_diff", "SELECT p_partkey % 3 AS r, CASE p_partkey % 3 WHEN 0 THEN 'changed' WHEN 1 THEN 'removed' ELSE 'new' END AS change, count(*) AS n FROM part GROUP BY 1, 2")
def _(spark, t):
    k = F.col("p_partkey")
    line = lambda suffix: F.concat(F.lit("func F"), k.cast("string"), F.lit(suffix))
    path = F.concat(F.lit("f"), k.cast("string"), F.lit("_"), (k % 3).cast("string"))
    old = t("part").select(path.alias("path"), F.when(k % 3 == 2, "").otherwise(line("() {")).alias("content"))
    new = t("part").select(path.alias("path"), F.when(k % 3 == 1, "").otherwise(line("(x int) {")).alias("content"))
    return codeintel.symbol_diff(old, new).groupBy(F.substring_index("path", "_", -1).cast("int").alias("r"), "change").agg(F.count("*").alias("n"))


@query("E5_licenses", """SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)SPDX-License-Identifier:\\s*([\\w.-]+)') THEN regexp_extract(text, '(?i)SPDX-License-Identifier:\\s*([\\w.-]+)', 1)
 WHEN regexp_matches(text, '(?im)^\\s*[#*/\\-\\s]*Licensed under the Apache License, Version 2.0') THEN 'Apache-2.0' END AS spdx_id FROM (SELECT doc_id, array_to_string(string_split(text, chr(10))[1:30], chr(10)) AS text FROM documents)
 WHERE regexp_matches(text, '(?i)SPDX-License-Identifier:\\s*([\\w.-]+)') OR regexp_matches(text, '(?im)^\\s*[#*/\\-\\s]*Licensed under the Apache License, Version 2.0')""")
def _(spark, t):
    info = codeintel.detect_license(F.concat(F.col("source"), F.lit("/a.md")), F.col("text"))
    return t("documents").select("doc_id", info.alias("i")).where("i is not null").select("doc_id", "i.spdx_id")


@query("E6_permissive", "SELECT event_id, event_id % 3 <> 1 AS ok FROM events")
def _(spark, t):
    spdx = F.element_at(F.array(*map(F.lit, ("MIT", "GPL-3.0-only", "ISC"))), (F.col("event_id") % 3 + 1).cast("int"))
    return t("events").select("event_id", codeintel.is_permissive(spdx).alias("ok"))


@query("E7_manifests", "SELECT 'p' || p_partkey || '/package.json' AS manifest, 'lib-' || p_partkey % 20 AS name, '^' || p_size AS constraint_text, 'runtime' AS scope FROM part UNION ALL SELECT 'p' || p_partkey || '/package.json', 'tool', '*', 'development' FROM part")
def _(spark, t):
    k = F.col("p_partkey").cast("string")
    doc = F.concat(F.lit('{"dependencies": {"lib-'), (F.col("p_partkey") % 20).cast("string"), F.lit('": "^'), F.col("p_size").cast("string"), F.lit('"}, "devDependencies": {"tool": "*"}}'))
    return codeintel.catalog(t("part").select(F.concat(F.lit("p"), k, F.lit("/package.json")).alias("path"), doc.alias("content"))).select("manifest", "name", "constraint_text", "scope")


@query("A14_sbom", f"WITH {EDGES_SQL}, c AS (SELECT DISTINCT rtrim(target_file, '/') AS name FROM edges) SELECT 'module' AS name, 'v1' AS version UNION ALL SELECT name, CASE WHEN name = 'pkg1' THEN 'v2' ELSE '' END FROM c")
def _(spark, t):
    return codeintel.sbom_components(edges(t), spark.createDataFrame([("pkg1", "v2")], "name string, version string"), "module", "v1")


@query("E12_secrets", f"WITH {FILES_SQL} SELECT id FROM files WHERE regexp_matches(content, '-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----') OR regexp_matches(content, '\\b(?:AKIA|ASIA)[0-9A-Z]{{16}}\\b') OR regexp_matches(content, '\\b[Bb]earer\\s+[A-Za-z0-9._~+/-]{{20,}}') OR regexp_matches(content, '(?i)\\b(?:api[_-]?key|secret|token|passwd|password)\\b\\s*[:=]\\s*[\"''][^\"''\\s]{{12,}}[\"'']') OR regexp_matches(content, '\\beyJ[A-Za-z0-9_-]{{10,}}\\.[A-Za-z0-9_-]{{10,}}\\.[A-Za-z0-9_-]{{5,}}')")
def _(spark, t):
    return files(t).where(F.size(codeintel.secret_findings(F.col("content"))) > 0).select("id")


@query("S22_history", "SELECT 'git:' || o_orderkey AS path FROM orders")
def _(spark, t):
    from ..sources.files import git_history

    log = t("orders").groupBy("o_custkey").agg(F.array_join(F.collect_list(F.concat(F.lit("commit "), F.col("o_orderkey").cast("string"), F.lit("\nbody"))), "\n").alias("value"))
    return git_history(log).select(F.regexp_replace("path", "^git:commit ", "git:").alias("path"))


@query("S23_changed", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def _(spark, t):
    from ..sources.files import git_changed

    f = t("orders").select("o_orderkey", F.col("o_custkey").cast("long").alias("path"))
    return git_changed(f, t("customer").where("c_acctbal < 0").select(F.col("c_custkey").cast("long").alias("path"))).select("o_orderkey")


@query("S1_scan_files", "SELECT coalesce(source, 'none') AS folder, CAST(count(*) AS BIGINT) AS texts, CAST(sum(octet_length(encode(coalesce(text, ''))) + 1) AS BIGINT) AS n_bytes FROM documents GROUP BY 1")
def _(spark, t):
    """The documents written as text files by source, among files that aren't eligible, and found again."""
    from ..operators.lineage import fresh_path
    from ..sources.files import scan_files

    root = fresh_path(spark, "tree")
    docs = t("documents").select(F.coalesce("source", F.lit("none")).alias("folder"), F.coalesce("text", F.lit("")).alias("value"))
    docs.write.partitionBy("folder").option("maxRecordsPerFile", 6).text(root)
    t("documents").select("doc_id").coalesce(1).write.mode("append").csv(f"{root}/node_modules")
    found = scan_files(spark, root).select(F.regexp_extract("path", "folder=([^/]*)/", 1).alias("folder"), "size_bytes")
    counts = docs.groupBy("folder").agg(F.count("*").alias("texts"))
    return found.groupBy("folder").agg(F.sum("size_bytes").alias("n_bytes")).join(counts, "folder").select("folder", "texts", "n_bytes")


@query("C4_character_pieces", "SELECT doc_id, true AS whole, true AS fits, true AS sound FROM documents")
def _(spark, t):
    """Texts cut into pieces of at most 997 bytes: together they are the text, none is too long, and none cuts a character."""
    pieces = t("documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("p", chunking.pieces_of(F.col("text"), 997))
    whole = F.array_join(F.transform("p", lambda x: F.decode(x, "utf-8")), "") == F.col("text")
    sound = F.forall("p", lambda x: F.is_valid_utf8(F.decode(x, "utf-8")) & (F.encode(F.decode(x, "utf-8"), "utf-8") == x))
    return pieces.select("doc_id", whole.alias("whole"), F.forall("p", lambda x: F.octet_length(x) <= 997).alias("fits"), sound.alias("sound"))


@query("M10_sql_functions", """SELECT vec_id, round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 3) AS dot FROM embeddings""")
def _(spark, t):
    """The engine's functions by name in SQL text."""
    from ..functions.surface import register_functions

    register_functions(spark)
    t("embeddings").createOrReplaceTempView("sieveline_embeddings")
    return spark.sql("SELECT vec_id, round(sieve_cosine(embedding, embedding) * sieve_norm(embedding) * sieve_norm(embedding), 3) AS dot FROM sieveline_embeddings")


@query("M10_chunk_table", "SELECT doc_id, CAST(count(*) AS BIGINT) AS words FROM (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')) FROM documents) GROUP BY 1")
def _(spark, t):
    """A table function in SQL text: the chunks of each document, whose words are the document's."""
    from ..functions.surface import register_functions

    register_functions(spark)
    t("documents").createOrReplaceTempView("sieveline_documents")
    rows = spark.sql("SELECT doc_id, c.chunk_index, c.content FROM sieveline_documents, LATERAL sieve_paragraphs(text) c")
    words = F.size(F.filter(F.split(F.lower("content"), r"\s+"), lambda x: x != ""))
    return rows.groupBy("doc_id").agg(F.sum(words).cast("long").alias("words"))
