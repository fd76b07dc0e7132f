"""Usage analytics and merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import basename

#: Shares at which a report tells of something.
EMPTY_SHARE, FALLBACK_SHARE, ERROR_SHARE = 0.5, 0.4, 0.1


def group_counts(events: DataFrame, column: str, limit: int = 10) -> DataFrame:
    """A2: the most frequent values; ties by value."""
    return events.groupBy(F.col(column).alias("key")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "key").limit(limit)


def grouping_sets(events: DataFrame, columns: list[str]) -> DataFrame:
    """A3: counts by each column and in all, in one pass over the events: ``grouping, key, n``."""
    sets = [[F.col(c)] for c in columns] + [[]]
    out = events.groupingSets(sets, *[F.col(c) for c in columns]).agg(F.count("*").alias("n"), F.grouping_id().alias("gid"))
    full = (1 << len(columns)) - 1
    which = F.coalesce(*[F.when(F.col("gid") == full - (1 << (len(columns) - 1 - i)), c) for i, c in enumerate(columns)], F.lit("all"))
    return out.select(which.alias("grouping"), F.coalesce(*[F.col(c).cast("string") for c in columns], F.lit("")).alias("key"), "n")


def latency_interpolated(events: DataFrame, column: str = "latency_ms") -> DataFrame:
    """A4: p50 and p95 between ranks; 0 without rows."""
    return events.agg(*[F.coalesce(F.percentile(column, p), F.lit(0.0)).alias(n) for n, p in (("p50", 0.5), ("p95", 0.95))])


def latency_nearest(events: DataFrame, column: str = "latency_ms") -> DataFrame:
    """A5/V5: p50 and p95 by nearest rank; 0 without rows."""
    return events.agg(*[F.coalesce(F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {column})"), F.lit(0)).alias(n) for n, p in (("p50", 0.5), ("p95", 0.95))])


def rates(events: DataFrame) -> DataFrame:
    """Shares by outcome and source of ``outcome, source`` rows; 0 without rows."""
    n = F.count("*")
    share = lambda test: F.when(n > 0, F.count_if(test) / n).otherwise(0.0)
    kinds = [("ok", "outcome"), ("empty", "outcome"), ("fallback", "outcome"), ("error", "outcome"), ("mcp", "source"), ("cli", "source")]
    return events.agg(n.alias("total"), *[share(F.col(c) == k).alias(f"{k}_rate") for k, c in kinds])


def findings(rate: DataFrame) -> DataFrame:
    """What a report tells of, one row each."""
    r = F.col
    found = F.array(
        F.when(r("total") == 0, "no_usage"),
        F.when((r("total") > 0) & (r("empty_rate") >= EMPTY_SHARE), "many_empty"),
        F.when((r("total") > 0) & (r("fallback_rate") >= FALLBACK_SHARE), "many_fallbacks"),
        F.when((r("total") > 0) & (r("error_rate") >= ERROR_SHARE), "many_errors"),
        F.when((r("total") > 0) & (r("mcp_rate") == 0) & (r("cli_rate") == 0), "no_agent_usage"),
    )
    return rate.select(F.explode(F.filter(found, lambda x: x.isNotNull())).alias("finding"))


def merge_runtime_edges(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Counts add up, the last writer's p95 stays, the seen range widens; reversed ranges are turned, negative counts left out.

    ``new`` has ``seq``, the order of writing; what is in ``old`` was written before.
    """
    fit = new.where((F.col("request_count") >= 0) & (F.col("error_count") >= 0) & (F.col("p95_latency_ms") >= 0))
    turned = fit.withColumns({"first_seen": F.least("first_seen", "last_seen"), "last_seen": F.greatest("first_seen", "last_seen")})
    every = old.withColumn("seq", F.lit(-1).cast("long")).unionByName(turned)
    return every.groupBy(*keys).agg(
        F.sum("request_count").alias("request_count"), F.sum("error_count").alias("error_count"), F.max_by("p95_latency_ms", "seq").alias("p95_latency_ms"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
    )


def extension_breakdown(files: DataFrame) -> DataFrame:
    """Files by extension; names without one, or with a long one, count as ``other``."""
    ext = F.lower(F.regexp_extract(basename(F.col("path")), r"(\.[^.]*)$", 1))
    kind = F.when((ext == "") | (ext == ".") | (F.octet_length(ext) > 12), "other").otherwise(ext)
    return files.groupBy(kind.alias("extension")).agg(F.count("*").alias("n"))


def fill_duplicates(deps: DataFrame, order: Column) -> DataFrame:
    """One row per ecosystem, normalised name and scope: the first, its empty version and constraint filled from later ones."""
    later = lambda c: F.coalesce(F.min_by(F.when(F.col(c) != "", F.col(c)), F.when(F.col(c) != "", order)), F.lit(""))
    keep = [c for c in deps.columns if c not in ("ecosystem", "normalized_name", "scope", "constraint_text", "resolved_version")]
    return deps.where("name <> '' and normalized_name <> ''").groupBy("ecosystem", "normalized_name", "scope").agg(*[F.min_by(c, order).alias(c) for c in keep], later("constraint_text").alias("constraint_text"), later("resolved_version").alias("resolved_version"))


#: Leading hexadecimal digits by which the lists of a fingerprint are formed, level by level.
FINGERPRINT_LEVELS = (5, 3, 1, 0)


def fingerprint(rows: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """SHA-256 over the sorted hashes of rows (fields joined by NUL).

    Hashes go in levels: rows that agree in five leading digits form a list, then
    at most 256 lists one of the next level, so no task sorts all rows of a group
    (at 10**11 rows a list holds about 10**5).
    """
    keys = by or []
    row = F.sha2(F.concat_ws("\0", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)
    parts = rows.select(*keys, row.alias("_p"), row.alias("_h"))
    for digits in FINGERPRINT_LEVELS:
        listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_p", "_h"))), lambda x: x["_h"]), "\n")
        parts = parts.groupBy(*keys, F.substring("_p", 1, digits).alias("_q")).agg(F.sha2(listed, 256).alias("_h")).withColumnRenamed("_q", "_p")
    return parts.select(*keys, F.col("_h").alias("fingerprint"))


def shared_dependencies(deps: DataFrame, project_id: int) -> DataFrame:
    """The other projects of a project's tenant that share a dependency, with its name: at most one row a dependency and project."""
    d = deps.select("tenant_id", "ecosystem", "normalized_name", "project_id").distinct()
    other = d.withColumnRenamed("project_id", "other_id")
    return d.where(F.col("project_id") == project_id).join(other, ["tenant_id", "ecosystem", "normalized_name"]).where("project_id <> other_id")


def dependency_use(deps: DataFrame) -> DataFrame:
    """J6/E10 over all projects: dependencies that several projects of a tenant share, with their number and the least one; never pairs."""
    d = deps.select("tenant_id", "ecosystem", "normalized_name", "project_id").distinct()
    return d.groupBy("tenant_id", "ecosystem", "normalized_name").agg(F.count("*").alias("projects"), F.min("project_id").alias("first_project")).where("projects > 1")


def file_diff(client: DataFrame, index: DataFrame) -> DataFrame:
    """``path, state``: stale (new or changed) or deleted; unchanged files are left out."""
    joined = client.select("path", F.col("hash").alias("h1")).join(index.select("path", F.col("hash").alias("h2")), "path", "full")
    state = F.when(F.col("h1").isNull(), "deleted").when(F.col("h2").isNull() | (F.col("h1") != F.col("h2")), "stale")
    return joined.select("path", state.alias("state")).where("state is not null")


def staleness(results: DataFrame, indexed: DataFrame, current: DataFrame) -> DataFrame:
    """Results with ``stale``: the file's hash now isn't the indexed one (a missing file is stale)."""
    a, b = indexed.select("path", F.col("hash").alias("_h1"), "indexed_at"), current.select("path", F.col("hash").alias("_h2"))
    return results.join(a, "path", "left").join(b, "path", "left").withColumn("stale", F.col("_h1").isNotNull() & (F.col("_h2").isNull() | (F.col("_h1") != F.col("_h2")))).drop("_h1", "_h2")


def enclosing_project(paths: DataFrame, projects: DataFrame) -> DataFrame:
    """Each path's project of longest prefix; each path is looked up under the directories above it, so the join is by equality."""
    parts = F.split("path", "/")
    up = paths.select("path", F.explode(F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("root"))
    hits = up.join(projects.select(F.col("path").alias("root"), F.col("name").alias("project")), "root")
    return hits.groupBy("path").agg(F.max_by("project", F.length("root")).alias("project"))


def ambiguous_names(projects: DataFrame) -> DataFrame:
    """Names that several projects have, letter case aside."""
    return projects.groupBy(F.lower("name").alias("name")).agg(F.count("*").alias("n")).where("n > 1")


def unique_by_identity(projects: DataFrame) -> DataFrame:
    """The first project of each identity; those without one all stay."""
    w = Window.partitionBy("identity").orderBy("id")
    some = projects.where("coalesce(identity, '') <> ''").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return some.unionByName(projects.where("coalesce(identity, '') = ''"))


def outcome_stats(units: DataFrame) -> DataFrame:
    """Per file the strongest outcome of its units (indexed, unchanged, empty), then counts."""
    rank = F.when(F.col("outcome") == "indexed", 3).when(F.col("outcome") == "unchanged", 2).when(F.col("outcome") == "empty", 1).otherwise(0)
    return units.groupBy("path").agg(F.max_by("outcome", rank).alias("outcome")).groupBy("outcome").agg(F.count("*").alias("n"))


def citations(sources: DataFrame) -> DataFrame:
    """Best score per file and span."""
    return sources.groupBy("path", "start_line", "end_line").agg(F.max("score").alias("score"))


def monthly_series(points: DataFrame) -> DataFrame:
    """Monthly means of match counts."""
    return points.groupBy(F.date_trunc("month", "ts").alias("month")).agg(F.avg("match_count").alias("mean"))


def trend(points: DataFrame) -> DataFrame:
    """First and last count of each query, and the change in percent (null from 0)."""
    ends = points.groupBy("query").agg(F.min_by("match_count", "ts").alias("first"), F.max_by("match_count", "ts").alias("last"))
    return ends.withColumn("percent", F.when(F.col("first") != 0, 100.0 * (F.col("last") - F.col("first")) / F.col("first")))


def in_scope(rows: DataFrame, members: DataFrame, tokens: DataFrame, user: str) -> DataFrame:
    """Rows of workspaces that a user belongs to, or that have no member at all, unless a token of theirs names other workspaces only.

    ``members``: ``workspace, user``; ``tokens``: ``user, workspace``, none for a token without limits.
    """
    theirs = members.where(F.col("user") == user).select("workspace").distinct()
    closed = members.select("workspace").distinct().join(theirs, "workspace", "left_anti")
    seen = rows.join(closed, "workspace", "left_anti")
    limits = tokens.where(F.col("user") == user).select("workspace").distinct()
    free = limits.agg((F.count("*") == 0).alias("_free"))
    named = limits.withColumn("_named", F.lit(True))
    return seen.join(named, "workspace", "left").join(F.broadcast(free), F.lit(True)).where("_free or _named").drop("_free", "_named")
