"""Scans (S1-S5, S22-S27): file trees, history, diffs, pushed batches and stored tables.

Eligibility is a predicate, so it runs before file contents are touched; the
``binaryFile`` reader leaves contents unread where only paths are selected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import basename, extension

# Which files are indexed, and how.
CODE_EXTENSIONS = [
    ".go", ".js", ".ts", ".tsx", ".jsx", ".java", ".py", ".rs", ".c", ".cpp", ".h", ".hpp", ".cs", ".rb", ".php",
    ".swift", ".kt", ".scala", ".sh", ".bash", ".yaml", ".yml", ".json", ".toml", ".mod", ".sum", ".dockerfile", ".sql",
    ".proto", ".graphql", ".gql", ".prisma", ".vue", ".jinja", ".jinja2", ".hbs", ".handlebars",
]
TEXT_EXTENSIONS = [".md", ".txt", ".adoc", ".rst", ".xml", ".csv", ".tsv", ".log", ".ini", ".cfg", ".conf"]
CODE_NAMES = ["Makefile", "makefile", "GNUmakefile", "Dockerfile", "Containerfile"]
KNOWN_NAMES = [
    *CODE_NAMES, "LICENSE", "LICENSE.txt", "LICENSE.md", "NOTICE", "CHANGELOG", "CHANGELOG.md", "CHANGELOG.txt",
    "CONTRIBUTING", "CONTRIBUTING.md", "CODE_OF_CONDUCT", "CODE_OF_CONDUCT.md", "SECURITY", "SECURITY.md", "AGENTS.md", "CLAUDE.md",
]
IGNORED_DIRS = [".git", "node_modules", "vendor", "dist", "build", ".next", "target", "bin", "obj", "__pycache__", ".venv", "venv", ".idea", ".vscode", "coverage", ".turbo"]
IGNORED_EXTENSIONS = [
    ".png", ".jpg", ".jpeg", ".gif", ".svg", ".ico", ".woff", ".woff2", ".ttf", ".eot", ".pdf", ".zip", ".tar", ".gz", ".rar",
    ".7z", ".exe", ".dll", ".so", ".dylib", ".mp3", ".mp4", ".avi", ".mov", ".webm", ".mkv", ".wav", ".flac", ".ogg",
]
EXTRACTABLE = [".html", ".htm", ".xhtml", ".pdf", ".docx", ".xlsx", ".pptx", ".odt", ".ods", ".odp", ".epub", ".ipynb", ".rtf", ".eml", ".jar", ".war", ".aar", ".zip", ".tar", ".gz", ".tgz", ".bz2", ".tbz2", ".lock", ".sum"]
#: Limits of one indexing run.
MAX_FILE_BYTES, MAX_CHUNKS_PER_FILE, CHUNK_BYTES = 1 << 20, 32, 4000


def should_index(path: Column) -> Column:
    """Not under an ignored directory, and of a known extension or name."""
    ext = extension(path)
    known = F.when(ext != "", ext.isin(CODE_EXTENSIONS + TEXT_EXTENSIONS)).otherwise(basename(path).isin(KNOWN_NAMES))
    return ~F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, IGNORED_DIRS))) & ~ext.isin(IGNORED_EXTENSIONS) & known


def eligible(path: Column) -> Column:
    """S3: indexed as it is, or by an extractor."""
    return should_index(path) | extension(path).isin(EXTRACTABLE)


def is_code_file(path: Column) -> Column:
    """By extension, else by name."""
    ext = extension(path)
    return F.when(ext != "", ext.isin(CODE_EXTENSIONS)).otherwise(basename(path).isin(CODE_NAMES))


def scan_files(spark: SparkSession, root: str, max_files: int | None = None, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """``path`` (relative), ``size_bytes, modified_at, content`` of eligible files; the first ``max_files`` by path."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    at = F.instr("path", root.rstrip("/").split("://")[-1]) + len(root.rstrip("/").split("://")[-1]) + 1
    files = raw.select(F.substring(F.col("path"), at, F.lit(1 << 20)).alias("path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"), "content")
    files = files.where(eligible(F.col("path")) & (F.col("size_bytes") <= max_bytes))
    return files if not max_files else files.orderBy("path").limit(max_files)


def git_history(log: DataFrame, text_col: str = "value") -> DataFrame:
    """One row a commit of ``git log -p`` text: ``path`` (``git:`` and the first line), ``content``."""
    commits = log.select(F.explode(F.split(F.concat(F.lit("\n"), F.col(text_col)), r"\ncommit ")).alias("content")).where(F.trim("content") != "")
    return commits.select(F.concat(F.lit("git:"), F.trim(F.substring_index("content", "\n", 1))).alias("path"), "content")


def git_changed(files: DataFrame, changed_paths: DataFrame) -> DataFrame:
    """Only files whose path changed since the stored commit."""
    return files.join(changed_paths.select("path").distinct(), "path", "left_semi")


PUSH_SCHEMA = "project string, files array<struct<path:string,content:string,chunks:array<struct<content:string,start_line:int,end_line:int,embedding:array<float>>>>>, delete array<string>"


def push_batches(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Pushed JSON batches as a table or a stream."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(PUSH_SCHEMA).json(path)


def pushed_files(batches: DataFrame) -> DataFrame:
    """One row a file."""
    return batches.select("project", F.explode("files").alias("f")).select("project", "f.*")


def duplicate_paths(batches: DataFrame) -> DataFrame:
    """Paths given more than once for a project; a batch that has any is refused."""
    return pushed_files(batches).groupBy("project", "path").agg(F.count("*").alias("n")).where("n > 1")


def export_chunks(chunks: DataFrame, files: DataFrame, project_id: int) -> DataFrame:
    """A project's chunks with their paths, ordered by path, dims and index."""
    own = chunks.where(F.col("project_id") == project_id)
    named = own.join(files.select(F.col("id").alias("file_id"), "path", "hash"), "file_id")
    return named.orderBy("path", "dims", "chunk_index")


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page of an ordered list."""
    ordered = df.orderBy(*order)
    return (ordered.offset(offset) if offset else ordered).limit(limit)


def list_files(files: DataFrame, prefix: str = "", contains: str = "", limit: int = 100, offset: int = 0) -> DataFrame:
    """P10: paths below a prefix that contain a text in any case."""
    kept = files.where(F.col("path").startswith(prefix) & F.lower("path").contains(contains.lower()))
    return page(kept, [F.col("path")], limit, offset)


def latest_versions(files: DataFrame, keys: tuple[str, ...] = ("project_id", "path")) -> DataFrame:
    """The last version of each path by time, then id."""
    w = Window.partitionBy(*keys).orderBy(F.col("indexed_at").desc(), F.col("id").desc())
    return files.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
