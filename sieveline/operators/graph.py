"""Graph operators (G11-G24, J13, J16, J17, A9-A11, U1, U4): edges as a table, walks as joins.

Walks go level by level: the frontier joins the edges, new nodes are those not
seen before. Each level is cut by ``checkpoint`` so plans stay short and a lost
executor repeats one level. Three node spaces exist and stay apart: opaque
strings (``bfs``, ``expand``), files with their directories (``build``), and
directory levels (``impact``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import dirname, package_dir
from .lineage import cut

#: Fixed values of expansion: decay a hop, least score, new paths, chunks a path.
DECAY, FLOOR, MAX_PATHS, CHUNKS_PER_PATH = 0.85, 0.3, 100, 3
#: Fixed values of walks: depth, nodes, edges; seeds of a hub view; depths of impact.
WALK_DEPTH, SUBGRAPH_DEPTH, MAX_NODES, MAX_EDGES, HUB_SEEDS, IMPACT_DEPTH, MAX_IMPACT_DEPTH = 8, 2, 10_000, 500, 16, 5, 10


def replace_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """The sources in ``new`` get its edges, the others keep theirs."""
    return old.join(new.select("source_file").distinct(), "source_file", "left_anti").unionByName(new.distinct())


def adjacency(edges: DataFrame) -> DataFrame:
    """Sorted neighbours of each source."""
    return edges.groupBy("source_file").agg(F.sort_array(F.collect_set("target_file")).alias("targets"))


def both_ways(edges: DataFrame) -> DataFrame:
    """``a, b`` in both directions, without repeats."""
    e = edges.select(F.col("source_file").alias("a"), F.col("target_file").alias("b"))
    return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def bfs(edges: DataFrame, seeds: DataFrame, depth: int, directed: bool = False) -> DataFrame:
    """``path, depth`` of all nodes within ``depth`` hops of ``seeds(path)``, seeds left out."""
    links = cut(edges.select(F.col("source_file").alias("a"), F.col("target_file").alias("b")).distinct() if directed else both_ways(edges))  # once for all levels
    seen = seeds.select("path", F.lit(0).alias("depth")).distinct()
    front = seen
    for hop in range(1, depth + 1):
        reached = front.join(links, front.path == links.a).select(F.col("b").alias("path")).distinct()
        front = cut(reached.join(seen, "path", "left_anti").select("path", F.lit(hop).alias("depth")))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)  # written level by level already
    return seen.where("depth > 0")


def expand(edges: DataFrame, seeds: DataFrame, depth: int, decay: float = DECAY, floor: float = FLOOR, max_paths: int = MAX_PATHS) -> DataFrame:
    """``path, score, depth``: scores spread both ways, times ``decay`` a hop, while at least ``floor``.

    A node keeps its best score; only improvements go on. ``seeds``: ``path,
    score, rank``; where a path occurs twice the value to beat is that of its last
    row, while all rows spread. Of the new paths the best ``max_paths`` stay.
    """
    links = cut(both_ways(edges))  # once for all levels
    last = Window.partitionBy("path").orderBy(F.col("rank").desc())
    best = seeds.withColumn("_n", F.row_number().over(last)).where("_n = 1").select("path", "score", F.lit(0).alias("depth"))
    front = seeds.select("path", "score")
    for hop in range(1, depth + 1):
        spread = front.join(links, front.path == links.a).groupBy(F.col("b").alias("path")).agg((F.max("score") * decay).alias("score")).where(F.col("score") >= floor)
        known = best.select("path", F.col("score").alias("held"))
        better = cut(spread.join(known, "path", "left").where("held is null or score > held").select("path", "score", F.lit(hop).alias("depth")))
        if better.isEmpty():
            break
        best = cut(best.join(better.select("path"), "path", "left_anti").unionByName(better))
        front = better.select("path", "score")
    new = best.join(seeds.select("path").distinct(), "path", "left_anti")
    return new.orderBy(F.col("score").desc(), "path").limit(max_paths)


def expanded_chunks(paths: DataFrame, chunks: DataFrame, per_path: int = CHUNKS_PER_PATH) -> DataFrame:
    """The first chunks of each expanded path (a directory: of the files below it); a placeholder if there are none."""
    in_dir = paths.where(F.col("path").endswith("/"))
    files = paths.where(~F.col("path").endswith("/"))
    named = chunks.select(F.col("path").alias("file_path"), "chunk_index", "content")
    # a file belongs to each directory above it: an equi join instead of a prefix join
    parts = F.split("file_path", "/")
    above = named.withColumn("_dir", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/")))))
    hits = files.join(named, files.path == named.file_path).select("path", "score", "depth", "file_path", "chunk_index", "content").unionByName(in_dir.join(above, in_dir.path == above["_dir"]).select("path", "score", "depth", "file_path", "chunk_index", "content"))
    w = Window.partitionBy("path").orderBy("chunk_index", "file_path")
    kept = hits.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_path).drop("_n")
    rest = paths.join(kept.select("path").distinct(), "path", "left_anti").select("path", "score", "depth", F.col("path").alias("file_path"), F.lit(0).alias("chunk_index"), F.lit("").alias("content"))
    return kept.unionByName(rest).withColumn("source", F.lit("graph"))


def build(edges: DataFrame) -> DataFrame:
    """Import edges and an edge from each directory to its files: ``source, target, kind``."""
    e = edges.select(F.col("source_file").alias("source"), F.col("target_file").alias("target"), F.lit("imports").alias("kind"))
    nodes = e.select(F.col("source").alias("n")).union(e.select("target")).distinct().where(~F.col("n").endswith("/"))
    return e.unionByName(nodes.select(package_dir(F.col("n")).alias("source"), F.col("n").alias("target"), F.lit("contains").alias("kind"))).distinct()


def degrees(edges: DataFrame, source: str = "source_file", target: str = "target_file") -> DataFrame:
    """``node, out_degree, in_degree`` of every node."""
    out = edges.groupBy(F.col(source).alias("node")).agg(F.count("*").alias("out_degree"), F.lit(0).cast("long").alias("in_degree"))
    into = edges.groupBy(F.col(target).alias("node")).agg(F.lit(0).cast("long").alias("out_degree"), F.count("*").alias("in_degree"))
    return out.unionByName(into).groupBy("node").agg(F.sum("out_degree").alias("out_degree"), F.sum("in_degree").alias("in_degree"))


def graph_stats(edges: DataFrame) -> DataFrame:
    """Nodes and edges in all."""
    return degrees(edges).agg(F.count("*").alias("nodes"), F.sum("out_degree").alias("edges"))


def hubs(edges: DataFrame, n: int = HUB_SEEDS) -> DataFrame:
    """Of the nodes that have outgoing edges those of largest out-degree, by name where equal."""
    return degrees(edges).where("out_degree > 0").orderBy(F.col("out_degree").desc(), "node").limit(n)


def shortest_path(edges: DataFrame, start: str, goal: str, depth: int = WALK_DEPTH, undirected: bool = True, max_nodes: int = MAX_NODES) -> tuple[list[str], bool]:
    """Nodes from ``start`` to ``goal`` over built edges (``source, target, kind``); the directed way first, then both ways.

    Levels hold nodes and their distance only; once the goal is reached, the nodes on shortest ways
    are found level by level backwards, and of several shortest ways the one that sorts first,
    node by node, forwards. Empty if there is none within the depth; the second value tells whether
    a level was cut to ``max_nodes`` (those that sort first stay), so that there may be one all the same.
    """
    if start == goal:
        return [start], False
    over = False
    forward = cut(edges.select(F.col("source").alias("a"), F.col("target").alias("b")).distinct())
    back = forward.select(F.col("b").alias("a"), F.col("a").alias("b"))
    for links in (forward, cut(forward.unionByName(back).distinct())) if undirected else (forward,):
        levels = [edges.sparkSession.createDataFrame([(start,)], "node string")]
        seen = levels[0]
        for _ in range(depth):
            step = levels[-1].join(links, F.col("node") == F.col("a")).select(F.col("b").alias("node")).distinct()
            new = cut(step.join(seen, "node", "left_anti"))
            if not new.where(F.col("node") == goal).isEmpty():
                return _traced(links, levels, start, goal), over
            n = new.count()
            if not n:
                break
            if n > max_nodes:
                over, new = True, cut(new.orderBy("node").limit(max_nodes))
            levels.append(new)
            seen = seen.unionByName(new)
    return [], over


def _traced(links: DataFrame, levels: list[DataFrame], start: str, goal: str) -> list[str]:
    """The first of the shortest ways through ``levels`` (start's own first) to the goal behind them."""
    spark = links.sparkSession
    ahead, on_way = spark.createDataFrame([(goal,)], "node string"), []
    for level in reversed(levels[1:]):
        leads = links.join(ahead, F.col("b") == F.col("node"), "left_semi").select(F.col("a").alias("node")).distinct()
        ahead = cut(level.join(leads, "node", "left_semi"))
        on_way.insert(0, ahead)
    way = [start]
    for nodes in on_way:
        way.append(links.where(F.col("a") == way[-1]).join(nodes, F.col("b") == F.col("node")).agg(F.min("b").alias("b")).first().b)
    return [*way, goal]


def subgraph(edges: DataFrame, seeds: DataFrame, depth: int = SUBGRAPH_DEPTH, inbound: bool = False, max_nodes: int = MAX_NODES, max_edges: int = MAX_EDGES) -> tuple[DataFrame, DataFrame, bool]:
    """Nodes (``path, depth, out_degree, in_degree``), edges among them, and whether a limit cut something off."""
    plain = edges.select(F.col("source").alias("source_file"), F.col("target").alias("target_file"))
    reached = bfs(plain if not inbound else plain.select(F.col("target_file").alias("source_file"), F.col("source_file").alias("target_file")), seeds, depth, directed=True)
    nodes = cut(seeds.select("path", F.lit(0).alias("depth")).distinct().unionByName(reached).orderBy("depth", "path").limit(max_nodes + 1))
    over = nodes.count() > max_nodes
    kept = nodes.orderBy("depth", "path").limit(max_nodes)
    among = edges.join(kept.select(F.col("path").alias("source"), F.col("depth").alias("_d")), "source").join(kept.select(F.col("path").alias("target")), "target", "left_semi")
    among = cut(among.orderBy("_d", "source", "target", "kind").limit(max_edges + 1))
    cut_edges = among.count() > max_edges
    listed = among.orderBy("_d", "source", "target", "kind").limit(max_edges).drop("_d")
    described = kept.join(degrees(edges, "source", "target").withColumnRenamed("node", "path"), "path", "left").fillna(0, ["out_degree", "in_degree"])
    return described, listed, over or cut_edges


def impact(edges: DataFrame, path: str, depth: int = IMPACT_DEPTH) -> DataFrame:
    """``path, depth`` of files that reach a file through imports of directories, level by level."""
    spark = edges.sparkSession
    seen = spark.createDataFrame([(path, 0)], "path string, depth int")
    level = seen.select(F.concat(dirname(F.col("path")), F.lit("/")).alias("dir"))
    for hop in range(1, min(max(1, depth), MAX_IMPACT_DEPTH) + 1):
        found = edges.join(level, edges.target_file == level.dir, "left_semi").select(F.col("source_file").alias("path")).distinct()
        new = cut(found.join(seen, "path", "left_anti").select("path", F.lit(hop).alias("depth")))
        if new.isEmpty():
            break
        seen = seen.unionByName(new)
        level = new.select(F.concat(dirname(F.col("path")), F.lit("/")).alias("dir")).distinct()
    return seen.where("depth > 0")


def callers(edges: DataFrame, path: str) -> DataFrame:
    """``path, kind``: importers of a file's directory (direct), and importers of theirs (transitive); no further."""
    target = F.concat(dirname(F.lit(path)), F.lit("/"))
    direct = edges.where(F.col("target_file") == target).select(F.col("source_file").alias("path")).distinct()
    dirs = direct.select(F.concat(dirname(F.col("path")), F.lit("/")).alias("dir")).distinct()
    beyond = edges.join(dirs, edges.target_file == dirs.dir, "left_semi").select(F.col("source_file").alias("path")).distinct()
    beyond = beyond.join(direct, "path", "left_anti").where(F.col("path") != path)
    return direct.withColumn("kind", F.lit("direct")).unionByName(beyond.withColumn("kind", F.lit("transitive")))


def neighbors(edges: DataFrame, node: str) -> DataFrame:
    """What a node imports and what imports it."""
    out = edges.where(F.col("source_file") == node).select(F.col("target_file").alias("node"), F.lit("imports").alias("kind"))
    return out.unionByName(edges.where(F.col("target_file") == node).select(F.col("source_file").alias("node"), F.lit("imported_by").alias("kind"))).distinct()


def directory_callers(edges: DataFrame, directory: str) -> DataFrame:
    """Importers of a directory, slashes at its end aside."""
    return edges.where(F.rtrim(F.col("target_file"), F.lit("/")) == directory.rstrip("/")).select("source_file").distinct()


def importless_files(files: DataFrame, edges: DataFrame) -> DataFrame:
    """Files whose directory nothing imports."""
    f = files.withColumn("_dir", F.concat(dirname(F.col("path")), F.lit("/")))
    targets = edges.select(F.col("target_file").alias("_dir")).distinct()
    return f.join(targets, "_dir", "left_anti").drop("_dir")


def runtime_graph(edges: DataFrame, projects: DataFrame, project_id: int | None = None) -> DataFrame:
    """Observed calls with project names, the last seen first; an unknown target keeps its own name."""
    own = edges if project_id is None else edges.where(F.col("source_project_id") == project_id)
    sp, tp = projects.select(F.col("id").alias("sid"), F.col("name").alias("source_name")), projects.select(F.col("id").alias("tid"), F.col("name").alias("tname"))
    joined = own.join(sp, F.col("source_project_id") == F.col("sid")).join(tp, F.col("target_project_id") == F.col("tid"), "left")
    return joined.withColumn("target_name", F.coalesce("tname", "target_name")).drop("sid", "tid", "tname").orderBy(F.col("last_seen").desc(), "target_name")
