"""Exact links between shingle sets among candidates: stars around hubs, and what stars leave open.

``star_links`` checks each node of a candidate group against the group's hub. A task
holds one hub's set and streams the nodes' sets past it, so a hub with a large part of
all nodes is cut into parts of ``STAR`` nodes that any tasks take.

A star can miss a link between two nodes that both differ from the hub. ``cross_links``
finds those: only groups whose nodes still lie in several components matter there,
and only pairs across components. A group's largest component (by bytes of its sets) is
dealt into blocks apart from the rest, and a block meets only blocks with which it may
have such pairs; blocks are bounded by bytes, two of them being what a task holds. A pair
that shares several groups is checked in the least of them alone. Within two blocks the
sets' hashes are joined through one sorted array, so work follows what sets share.

Sets are sorted unsigned 64-bit hashes as bytes, one row a ``node``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, ship, shuffle_partitions
from .simhash_gray import components
from .tokens import release

#: Nodes in a part of a star; bytes of sets in a block.
STAR, BLOCK_BYTES = 500, 4 << 20
_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def enough(both, p: int, q: int, percent: int):
    """Is the similarity of sets of p and q members, ``both`` of them shared, at least ``percent`` / 100?"""
    return 100 * both >= percent * (p + q - both)


def close(a: str, b: str, percent: int) -> Column:
    """What two sets' sizes allow."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _pairs(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in rows], pa.int64()), pa.array([b for _, b in rows], pa.int64())], schema=_PAIR)


def star_links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the distinct ``hub, node`` pairs whose sets are similar enough, as ``a, b``."""
    ship(pairs.sparkSession)

    def run(batches):
        release()
        last, held, found = None, None, []
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                for hub, share, node, raw in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), part.column(3)):
                    own = np.frombuffer(raw.as_py(), np.uint64)
                    if node is None:
                        last, held = (hub, share), own
                    elif (hub, share) == last:
                        both = len(own) + len(held) - len(np.union1d(own, held))
                        if enough(both, len(own), len(held), percent):
                            found.append((hub, node))
                if len(found) >= 10_000:
                    yield _pairs(found)
                    found = []
        if found:
            yield _pairs(found)
        release()

    parts = pairs.groupBy("hub").agg(F.ceil(F.count("*") / F.lit(STAR)).cast("int").alias("_parts"))
    share = F.pmod(F.xxhash64("node"), F.col("_parts")).cast("int")
    nodes = pairs.join(parts, "hub").select("hub", share.alias("share"), "node").join(sets, "node").select("hub", "share", "node", "hashes")
    hubs = parts.select("hub", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("share"))
    own = sets.select(F.col("node").alias("hub"), "hashes")
    hubs = hubs.join(own, "hub").select("hub", "share", F.lit(None).cast("long").alias("node"), "hashes")
    rows = nodes.unionByName(hubs).repartition(shuffle_partitions(pairs.sparkSession), "hub", "share")
    return rows.sortWithinPartitions("hub", "share", F.col("node").asc_nulls_first()).mapInArrow(run, "a long, b long")


def links_between(nodes: np.ndarray, roots: np.ndarray, block: np.ndarray, groups: list, group: int, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between components among the nodes of two blocks (or one) of ``group``; ``groups``: each node's groups."""
    if len(np.unique(roots)) < 2:
        return []
    order = np.argsort(np.unique(roots, return_counts=True)[1][np.unique(roots, return_inverse=True)[1]], kind="stable")  # members of small components ask first
    part, size = roots.copy(), np.array([len(s) for s in sets])
    joined = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), size)
    by = np.argsort(joined, kind="stable")
    values, owner = joined[by], owner[by]
    crossing, asked, out = block.min() != block.max(), np.zeros(len(nodes), bool), []
    for i in order.tolist():
        asked[i] = True
        fit = (part != part[i]) & ~asked & (100 * np.minimum(size, size[i]) >= percent * np.maximum(size, size[i]))
        if crossing:
            fit &= block != block[i]
        if not fit.any():
            continue
        low, high = np.searchsorted(values, sets[i], "left"), np.searchsorted(values, sets[i], "right")
        width = high - low
        at = np.repeat(low - np.append(0, np.cumsum(width)[:-1]), width) + np.arange(width.sum())
        both = np.bincount(owner[at], minlength=len(nodes))
        for j in np.flatnonzero(fit & (100 * both >= percent * (size + size[i] - both))).tolist():
            if part[j] != part[i] and (groups[i] is None or min(groups[i] & groups[j]) == group):
                out.append((int(nodes[j]), int(nodes[i])))
                part[part == part[j]] = part[i]
    return out


def cross_links(rest: DataFrame, sets: DataFrame, percent: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Links ``a, b`` between components (``root``) among the nodes of each ``key``; ``rest``: distinct ``key, node, root, n``.

    A key of mutually unlike nodes costs the square of its blocks; one large component
    and stragglers cost their product.
    """
    ship(rest.sparkSession)

    def finish(key, held):
        if len(held) < 2:
            return []
        nodes, roots, blocks = (np.array([h[i] for h in held]) for i in range(3))
        return links_between(nodes, roots, blocks, [h[3] for h in held], key, [h[4] for h in held], percent)

    def run(batches):
        release()
        last, held, known = None, [], {}
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                for key, low, high, own, node, root, groups, raw in zip(*(part.column(i).to_pylist() for i in range(7)), part.column(7)):
                    if (key, low, high) != last:
                        if found := finish(last and last[0], held):
                            yield _pairs(found)
                        last, held, known = (key, low, high), [], {}
                    groups = known.setdefault(tuple(groups), frozenset(groups))  # copies of one group have the same lists
                    held.append((node, root, own, groups, np.frombuffer(raw.as_py(), np.uint64)))
        if found := finish(last and last[0], held):
            yield _pairs(found)
        held.clear()
        release()

    weight = F.sum(8 * F.col("n"))
    by_root = rest.groupBy("key", "root").agg(weight.alias("w"))
    total = by_root.groupBy("key").agg(F.sum("w").alias("all"), F.max(F.struct("w", "root")).alias("top"))
    blocks = lambda w: F.greatest(F.lit(1), F.ceil(w / F.lit(block_bytes))).cast("int")
    total = total.select(F.col("key").alias("_key"), F.col("top.root").alias("_top"), blocks(F.col("top.w")).alias("_large"), blocks(F.col("all") - F.col("top.w")).alias("_small"))
    lists = rest.groupBy("node").agg(F.sort_array(F.collect_set("key")).alias("groups")).withColumnRenamed("node", "_node")  # as many as a node has bands
    rows = rest.join(total, rest.key == total["_key"])
    rows = rows.join(lists, rows.node == lists["_node"])
    h, in_top = F.xxhash64("node"), F.col("root") == F.col("_top")
    own = F.when(in_top, F.pmod(h, F.col("_large"))).otherwise(F.col("_large") + F.pmod(h, F.col("_small"))).cast("int")
    first = F.when(in_top, F.col("_large")).otherwise(F.lit(0))  # the largest component has no pairs with itself
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(first, F.col("_large") + F.col("_small") - 1)))
    dealt = rows.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "node", "root", "groups").join(sets, "node")
    dealt = dealt.select("key", "low", "high", "own", "node", "root", "groups", "hashes")
    placed = dealt.repartition(shuffle_partitions(rest.sparkSession), "key", "low", "high").sortWithinPartitions("key", "low", "high", "node")
    return placed.mapInArrow(run, "a long, b long")


def open_groups(groups: DataFrame, roots: DataFrame) -> DataFrame:
    """``key, node, root, n`` of keys whose nodes, the hub left aside, lie in several components.

    ``groups``: ``key, node, n, hub``; the hub has been checked against all of its key.
    """
    others = groups.where("node <> hub")
    own = others.join(roots.withColumnRenamed("node", "_of"), F.col("node") == F.col("_of"), "left").select("key", "node", "n", F.coalesce("root", "node").alias("root"))
    split = own.groupBy("key").agg(F.min("root").alias("_low"), F.max("root").alias("_top")).where("_low < _top").select("key")
    return cut(own.join(split, "key"))


def linked(busy: DataFrame, sets: DataFrame, percent: int, merge: bool = False) -> DataFrame:
    """``node, root`` of all nodes with a link: two stars a key, then what they leave open across components.

    ``busy``: ``key, node, n, hub, hub_n``, the hub being one of the key's nodes. ``merge``: keys
    that stay open are put together where they share nodes, for nodes that lie in many keys.
    """

    def stars(groups: DataFrame) -> DataFrame:
        fit = groups.where("node <> hub").where(close("n", "hub_n", percent))
        return star_links(fit.select("hub", "node").distinct(), sets, percent)

    edges = cut(stars(busy))
    roots = cut(components(edges))
    rest = open_groups(busy, roots)
    if rest.isEmpty():
        return roots
    second = rest.groupBy("key").agg(F.min(F.struct("node", "n", "root")).alias("h")).select("key", F.col("h.node").alias("hub"), F.col("h.n").alias("hub_n"), F.col("h.root").alias("hub_root"))
    again = cut(rest.join(second, "key"))
    edges = cut(edges.unionByName(stars(again.where("root <> hub_root"))))
    roots = cut(components(edges))
    rest = open_groups(again.select("key", "node", "n", "hub"), roots)
    if rest.isEmpty():
        return roots
    if merge:
        held = components(rest.select(F.col("node").alias("a"), F.col("key").alias("b"))).withColumnsRenamed({"node": "_of", "root": "_held"})
        joined = rest.select("node", "n", "root").distinct().join(held, F.col("node") == F.col("_of"), "left")
        rest = cut(joined.select(F.coalesce("_held", "node").alias("key"), "node", "root", "n"))
    return cut(components(edges.unionByName(cross_links(rest, sets, percent))))
