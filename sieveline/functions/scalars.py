"""Scalar expressions (F*, P*): built-in functions only, so they stay in generated code.

Lengths that the engine measures in bytes use ``octet_length``; text searched or
matched without regard to case is lower-cased first. White space is Unicode's.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Search terms have 3 to 256 bytes, 20 at most.
MIN_TERM_BYTES, MAX_TERM_BYTES, MAX_TERMS = 3, 256, 20
#: Limits of requests.
DEFAULT_TOP_K, MAX_TOP_K = 5, 1000
DEFAULT_GRAPH_DEPTH, MAX_GRAPH_DEPTH = 2, 5


def fields(x: Column) -> Column:
    """words between runs of Unicode white space."""
    return F.filter(F.split(x, r"(?U)\s+"), lambda w: w != "")


def trim_space(x: Column) -> Column:
    """without Unicode white space at either end."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def sha256_hex(x: Column) -> Column:
    """F1."""
    return F.sha2(x, 256)


def query_hash(query: Column) -> Column:
    """of the trimmed query; empty for an empty one."""
    q = trim_space(F.coalesce(query, F.lit("")))
    return F.when(q == "", "").otherwise(F.sha2(q, 256))


def dirname(path: Column) -> Column:
    """the part before the last slash; ``.`` for a bare name."""
    return F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*$", "")).otherwise(".")


def basename(path: Column) -> Column:
    """F3."""
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """from the last dot of the last segment, lower case; empty without a dot."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def clean_path(path: Column) -> Column:
    """``.`` and ``..`` segments resolved, for relative and absolute paths alike."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))

    def step(acc: Column, p: Column) -> Column:
        up = (p == "..") & (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("")) != "..")
        return F.when(up, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when((p == "..") & path.startswith("/"), acc).otherwise(F.concat(acc, F.array(p)))

    joined = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    return F.when(path.startswith("/"), F.concat(F.lit("/"), joined)).otherwise(F.when(joined == "", ".").otherwise(joined))


def line_of(text: Column, offset: Column) -> Column:
    """1 and the number of line feeds before a byte offset."""
    before = F.substring(text.cast("binary"), F.lit(1), F.greatest(F.lit(0), F.least(offset, F.octet_length(text))).cast("int")).cast("string")
    return F.lit(1) + F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit("")))


def first_non_empty_line(text: Column) -> Column:
    """trimmed; empty if there is none."""
    lines = F.filter(F.transform(F.split(text, "\n"), trim_space), lambda x: x != "")
    return F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit(""))


def preview(text: Column, limit: int) -> Column:
    """cut to ``limit`` characters, with an ellipsis if something was cut."""
    return F.when(F.char_length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("…"))).otherwise(text)


def location(path: Column, start: Column, end: Column) -> Column:
    """``path``, ``path:line`` or ``path:from-to``."""
    return F.when(start <= 0, path).when(end > start, F.concat(path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))).otherwise(F.concat(path, F.lit(":"), start.cast("string")))


def numbered_lines(text: Column, start: Column) -> Column:
    """each line behind its number."""
    return F.array_join(F.transform(F.split(text, "\n"), lambda x, i: F.concat((start + i).cast("string"), F.lit(": "), x)), "\n")


def grep_row(path: Column, line: Column, text: Column) -> Column:
    """F6."""
    return F.concat_ws(":", path, line.cast("string"), first_non_empty_line(text))


def rfc3339(ts: Column) -> Column:
    """in UTC sessions."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def retry_seconds(ms: Column) -> Column:
    """F7."""
    return F.greatest(F.lit(1), F.ceil(ms / 1000.0)).cast("long")


def dot(a: Column, b: Column) -> Column:
    """F8: in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """F8."""
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """0 for vectors of different or no length, or of norm 0. Pass norms that are known."""
    na, nb = norm_a if norm_a is not None else norm(a), norm_b if norm_b is not None else norm(b)
    odd = a.isNull() | b.isNull() | (F.size(a) != F.size(b)) | (F.size(a) == 0) | (na == 0) | (nb == 0)
    return F.when(odd, 0.0).otherwise(dot(a, b) / (na * nb))


def gain(grade: Column) -> Column:
    """F10."""
    return F.pow(F.lit(2.0), grade) - 1


def discount(rank: Column) -> Column:
    """F10."""
    return F.log2(rank + 1.0)


#: Vector sizes by part of a model's name, first match first.
MODEL_DIMS = [
    ("nomic", 768), ("bge-m3", 1024), ("mxbai", 1024), ("qwen3", 1024),
    ("gemini-embedding-2", 3072), ("text-embedding-3-large", 3072),
    ("text-embedding-3-small", 1536), ("text-embedding-ada-002", 1536), ("gemini-embedding-001", 1536),
]


def infer_dims(model: Column) -> Column:
    """0 if unknown."""
    return F.coalesce(*[F.when(F.lower(model).contains(part), n) for part, n in MODEL_DIMS], F.lit(0))


def classify_outcome(hits: Column, fallback: Column, keyword_only: Column) -> Column:
    """F12."""
    return F.when(hits == 0, "empty").when(fallback | keyword_only, "fallback").otherwise("ok")


def parse_source(x: Column) -> Column:
    """F12."""
    s = F.lower(trim_space(x))
    return F.when(s.isin("cli", "mcp", "admin", "sdk"), s).otherwise("unknown")


def normalize_dependency(ecosystem: Column, name: Column) -> Column:
    """lower case; a leading ``./`` goes in ecosystems that allow paths."""
    n = trim_space(name)
    return F.lower(F.when(ecosystem.isin("go", "maven", "gradle", "npm"), n).otherwise(F.regexp_replace(n, r"^\./", "")))


def normalize_remote(url: Column) -> Column:
    """``host/path`` of a repository address, without scheme, user, port-less ssh colon and ``.git``."""
    u = F.regexp_replace(F.regexp_replace(trim_space(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://", ""), r"^[^/@]*@", "")
    u = F.when(url.rlike("^[^/]*@[^/:]+:") & ~url.contains("://"), F.regexp_replace(u, r"^([^/:]+):", "$1/")).otherwise(u)
    return F.lower(F.regexp_replace(F.regexp_replace(u, r"/+$", ""), r"\.git$", ""))


def host_of(url: Column) -> Column:
    """host of an address or of ``user@host:path``; empty if neither."""
    web = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)
    return F.lower(F.when(web != "", web).otherwise(F.regexp_extract(url, r"^[^/@]+@([^/:]+):", 1)))


def normalize_spdx(x: Column) -> Column:
    """F13."""
    return F.regexp_replace(trim_space(x), r" [Ll]icense$", "")


#: Languages by extension.
LANGUAGES = {
    "go": [".go"], "javascript": [".js", ".mjs", ".cjs"], "typescript": [".ts", ".mts", ".cts"], "tsx": [".tsx"], "jsx": [".jsx"],
    "python": [".py"], "java": [".java"], "rust": [".rs"], "ruby": [".rb"], "c": [".c"], "cpp": [".cpp", ".cc", ".cxx"],
    "c-header": [".h", ".hpp"], "csharp": [".cs"], "swift": [".swift"], "kotlin": [".kt", ".kts"], "scala": [".scala"], "php": [".php"],
    "r": [".r", ".rdata"], "sql": [".sql"], "shell": [".sh", ".bash", ".zsh"], "yaml": [".yaml", ".yml"], "json": [".json"],
    "html": [".xml", ".html", ".htm"], "css": [".css"], "markdown": [".md", ".markdown"], "protobuf": [".proto"], "lua": [".lua"], "elixir": [".ex", ".exs"],
}


def detect_language(path: Column) -> Column:
    """empty if unknown."""
    return F.coalesce(*[F.when(extension(path).isin(exts), name) for name, exts in LANGUAGES.items()], F.lit(""))


def since(now: Column, days: Column) -> Column:
    """``now`` less 1 to 365 days."""
    return now - F.make_interval(days=F.greatest(F.lit(1), F.least(F.lit(365), days)))


def parse_file_line(x: Column) -> Column:
    """F16: ``path:line`` -> struct(path, line); null if it isn't one with a line above 0."""
    path, line = F.regexp_extract(x, r"^(.+):([0-9]+)$", 1), F.regexp_extract(x, r"^(.+):([0-9]+)$", 2)
    n = F.when(line != "", line.cast("int"))
    return F.when(n > 0, F.struct(path.alias("path"), n.alias("line")))


def parse_ref_range(x: Column) -> Column:
    """F16: ``old..new`` -> struct(old, new); a single ref is compared with HEAD."""
    t = trim_space(x)
    a, b = F.regexp_extract(t, r"^(.+?)\.\.\.?(.+)$", 1), F.regexp_extract(t, r"^(.+?)\.\.\.?(.+)$", 2)
    return F.when(a != "", F.struct(a.alias("old"), b.alias("new"))).when(t != "", F.struct(t.alias("old"), F.lit("HEAD").alias("new")))


def rerank_terms(query: Column) -> Column:
    """distinct lower-case letter and digit runs of two bytes or more."""
    return F.array_distinct(F.filter(F.split(F.lower(query), r"[^\p{L}\p{N}]+"), lambda t: F.octet_length(t) >= 2))


def branch_tracking(line: Column) -> Column:
    """``[ahead n, behind m]`` -> struct(ahead, behind)."""
    number = lambda word: F.coalesce(F.when(F.regexp_extract(line, rf"{word} (\d+)", 1) != "", F.regexp_extract(line, rf"{word} (\d+)", 1).cast("int")), F.lit(0))
    return F.struct(number("ahead").alias("ahead"), number("behind").alias("behind"))


def json_map(x: Column) -> Column:
    """an object's entries as a map of strings."""
    return F.from_json(x, "map<string,string>")


def scope(tenant: Column, workspace: Column, tenant_id: int, workspace_id: int = 0) -> Column:
    """One tenant, and one workspace unless it is 0."""
    return (tenant == tenant_id) & (F.lit(workspace_id == 0) | (workspace == workspace_id))


def any_word_like(x: Column, words: list[str]) -> Column:
    """Some word within ``x``; ``%`` and ``_`` in words keep their meaning."""
    return reduce(or_, [x.ilike(f"%{w}%") for w in words], F.lit(False))


def under_prefix(path: Column, prefix: Column) -> Column:
    """P5: LIKE with the prefix's metacharacters live."""
    return F.like(path, F.concat(prefix, F.lit("%")))


#: Names and extensions that mark a path as sensitive.
SENSITIVE_WORDS = ["env", "secret", "key", "password", "credential", "token", "auth", "config", "db", "database", "private", "pem", "jwks", "cert", "ssl"]
SENSITIVE_EXTENSIONS = [".env", ".pem", ".key", ".conf", ".config"]


def is_sensitive(path: Column) -> Column:
    """A sensitive word stands alone in a segment (between ``.``, ``_`` and ``-``), or the extension is sensitive."""
    tokens = F.split(F.lower(path), r"[/._\-]")
    return F.arrays_overlap(tokens, F.array(*map(F.lit, SENSITIVE_WORDS))) | extension(path).isin(SENSITIVE_EXTENSIONS)


def privacy_mode(x: Column) -> Column:
    """Null if it is none of the modes."""
    m = F.lower(trim_space(F.coalesce(x, F.lit(""))))
    return F.when(m == "", "hybrid").when(m.isin("cloud", "hybrid", "edge"), m)


def search_words(query: Column) -> Column:
    """Words of 3 to 256 bytes, the first of each spelling, 20 at most."""
    fit = F.filter(fields(query), lambda w: F.octet_length(w).between(MIN_TERM_BYTES, MAX_TERM_BYTES))
    return F.slice(F.filter(fit, lambda w, i: F.array_position(F.transform(fit, F.lower), F.lower(w)) == i + 1), 1, MAX_TERMS)


def classify_query(q: Column) -> Column:
    """P9."""
    return (
        F.when(q == "", "unknown")
        .when(q.startswith('"') & q.endswith('"') & (F.octet_length(q) >= 2), "exact")
        .when(q.contains("/"), "path")
        .when(q.rlike(r"[ \t\n]"), "natural_language")
        .when(q.rlike(r"\A[A-Za-z_][A-Za-z0-9_.]*\z"), "identifier")
        .otherwise("natural_language")
    )


def routes_to_keyword(kind: Column) -> Column:
    """P9."""
    return kind.isin("identifier", "path", "exact")


def keyword_query(q: Column) -> Column:
    """An exact query without its quotes."""
    return F.when(classify_query(q) == "exact", F.substring(q, F.lit(2), F.char_length(q) - 2)).otherwise(q)


def valid_relative_path(p: Column) -> Column:
    """Not empty, not absolute, and never above its start."""
    return (F.coalesce(p, F.lit("")) != "") & ~p.startswith("/") & ~p.contains("\\") & ~p.contains("\x00") & ~clean_path(p).rlike(r"^\.\.(/|$)")


def is_package_dir(node: Column) -> Column:
    """A node that ends in a slash is a directory."""
    return node.endswith("/")


def normalize_node(node: Column) -> Column:
    """Cleaned, a directory's slash kept; empty and ``./`` are empty."""
    body = clean_path(F.regexp_replace(trim_space(node), r"\\", "/"))
    return F.when((trim_space(node) == "") | (body == "."), "").when(node.endswith("/"), F.concat(body, F.lit("/"))).otherwise(body)


def package_dir(node: Column) -> Column:
    """The directory (with its slash) of a file; a directory is its own."""
    n = normalize_node(node)
    return F.when(n == "", "").when(n.endswith("/"), n).when(n.contains("/"), F.concat(dirname(n), F.lit("/"))).otherwise("./")


def clamp_top_k(k: Column) -> Column:
    """W14."""
    return F.when(k <= 0, DEFAULT_TOP_K).otherwise(F.least(k, F.lit(MAX_TOP_K)))


def clamp_depth(d: Column) -> Column:
    """W14."""
    return F.when(d <= 0, DEFAULT_GRAPH_DEPTH).otherwise(F.least(d, F.lit(MAX_GRAPH_DEPTH)))
