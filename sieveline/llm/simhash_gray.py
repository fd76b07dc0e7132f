"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints: 64 bits over three-word shingles of lower-cased text. Distinct
fingerprints (copies have collapsed to one) are sorted by Gray rank, in which
neighbours share long bit patterns, and dealt into nodes by a leading part of
that rank. A node's tree factors what its fingerprints share: each upper node
keeps the bits on which everything below it agrees (a mask and a pattern), and a
descent from pair to pair of nodes adds up the differences over the bits newly
fixed on the way down. A pair of groups whose differences exceed the limit is
pruned whole; one whose differences can't exceed it is accepted whole.

Of each two nodes whose fixed leading bits differ in at most the limit, one sees
the other's fingerprints as guests, so no link is lost, whatever the number of nodes. A node's
task keeps only a spanning forest of the links it finds (a union-find over its
own fingerprints), so a dense group yields a number of edges below its number of
fingerprints. Components of the forests' edges come from alternating star
contractions, each round written to the shared checkpoint folder.

Nulls: a null text has no words and fingerprint zero, as an empty one has; such
rows link like any others. Null ids stay, and a component of null ids only has
a null id. Repeated rows share their fingerprint. Texts of any length are read
whole, 2**16 shingles at a time. Extra columns are left behind. An empty table
gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, only, ship, shuffle_partitions
from .tokens import release

SEED = 42
MAX_BITS = 3
SHINGLE = 3
FAN = 8
LEAF_PAIRS = 1 << 14
#: Tasks of a round over edges, and edges for which there is one more.
LEAST_TASKS, EDGES_PER_TASK = 8, 50_000
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """Bit i is 1 if it is set in over half of the shingles' XXH64."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    if len(words) < size:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined, ends = b" ".join(words), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[:-size].tolist()]
    digest = xxhash.xxh64_intdigest
    votes, total = np.zeros(64, np.int64), len(words) - size + 1
    stops = (ends[size - 1 :] - 1).tolist()
    for at in range(0, total, 1 << 16):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + (1 << 16)], stops[at : at + (1 << 16)])], "<u8")
        votes += bit_votes(hashes.reshape(-1, 1))
    return int(np.packbits(votes * 2 > total, bitorder="little").view("<u8")[0])


def bit_votes(hashes: np.ndarray) -> np.ndarray:
    """How many rows of unsigned 64-bit words have each bit set; sums of up to 255 rows fit a byte."""
    votes = np.zeros(hashes.shape[1] * 64, np.int64)
    for at in range(0, len(hashes), 255):
        block = np.ascontiguousarray(hashes[at : at + 255]).view(np.uint8)
        votes += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return votes


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """``doc_id, fp``: the fingerprint's bits as a signed long."""
    ship(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), size) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(fps)], schema=schema)

    return only(docs, doc_id=id_col, text=text_col).mapInArrow(run, "doc_id long, fp long")


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Where a bit pattern stands among the Gray codes: the parity of all higher bits and its own."""
    rank = fp.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class Tree:
    """Levels of groups over fingerprints in Gray order; level 0 is the fingerprints."""

    def __init__(self, fps: np.ndarray, extra: np.ndarray | None = None):
        self.order = np.argsort(gray_rank(fps), kind="stable")
        self.extra = None if extra is None else extra[self.order]
        self.masks, self.patterns = [np.full(len(fps), _ALL)], [fps[self.order]]
        while len(self.masks[-1]) > 1:
            mask, pattern = self.masks[-1], self.patterns[-1]
            at = np.arange(0, len(mask), FAN)
            ones, zeros = np.bitwise_and.reduceat(mask & pattern, at), np.bitwise_and.reduceat(mask & ~pattern, at)
            self.masks.append(ones | zeros)
            self.patterns.append(ones)

    def __len__(self) -> int:
        return len(self.masks) - 1


class Forest:
    """Union-find over numbers."""

    def __init__(self, n: int):
        self.parent = np.arange(n)
        self.grown = False

    def roots(self) -> np.ndarray:
        p = self.parent
        while True:
            q = p[p]
            if np.array_equal(p, q):
                break
            p = q
        self.parent = p
        return p

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            root = self.roots()
            ra, rb = root[a], root[b]
            live = ra != rb
            a, b, ra, rb = a[live], b[live], ra[live], rb[live]
            if not len(a):
                return
            high, low = np.maximum(ra, rb), np.minimum(ra, rb)
            best = np.lexsort((low, high))  # each upper root joins its lowest neighbour
            first = best[np.concatenate([[True], high[best][1:] != high[best][:-1]])]
            self.grown = True
            self.parent[high[first]] = low[first]


def link(own: np.ndarray, guests: np.ndarray, limit: int = MAX_BITS, chunk: int = 1 << 15, within: bool = True, extra: tuple[np.ndarray, np.ndarray] | None = None, extra_limit: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within ``own`` (unless not asked for) and between ``own`` and ``guests``.

    Edges lead from one member of each part to the others, as numbers into
    ``concatenate([own, guests])``. ``extra``: further bits of either side, in which
    linked ones may differ by ``extra_limit`` at most.
    """
    forest = Forest(len(own) + len(guests))
    more = extra or (None, None)
    home = Tree(own, more[0])
    if len(own) and within:
        _descend(home, home, 0, limit, chunk, forest, True, extra_limit)
    if len(own) and len(guests):
        _descend(home, Tree(guests, more[1]), len(own), limit, chunk, forest, False, extra_limit)
    root = forest.roots()
    b = np.flatnonzero(root != np.arange(len(root)))
    return root[b], b


def _descend(home: Tree, other: Tree, shift: int, limit: int, chunk: int, forest: Forest, same: bool, extra_limit: int = 64) -> None:
    zero = np.zeros(1, np.int32)
    top = (len(home), len(other))
    common = home.masks[top[0]] & other.masks[top[1]]
    start = np.bitwise_count((home.patterns[top[0]] ^ other.patterns[top[1]]) & common)
    stack = [(*top, zero, zero, start, common)]
    while stack:
        lu, lv, u, v, diff, fixed = stack.pop()
        if len(u) > chunk:
            stack += [(lu, lv, *(x[i : i + chunk] for x in (u, v, diff, fixed))) for i in range(0, len(u), chunk)]
            continue
        # whole groups within the limit: everything below is linked, so one chain does
        near = diff + (64 - np.bitwise_count(fixed)) <= limit
        if near.any():
            here = np.flatnonzero(near)
            here = here[_apart(home, other, shift, forest, lu, lv, u[here], v[here])]
            heads, tails = [], []
            for i in here.tolist():
                x, y = int(u[i]), int(v[i])
                every = np.concatenate([home.order[x * FAN**lu : (x + 1) * FAN**lu], other.order[y * FAN**lv : (y + 1) * FAN**lv] + shift])
                fit = _chained(home, other, lu, lv, x, y, extra_limit)
                heads.append(every[:-1][fit])
                tails.append(every[1:][fit])
                near[i] = fit.all()  # otherwise what the chain left apart is looked at further down
            if heads:
                forest.add(np.concatenate(heads), np.concatenate(tails))
            u, v, diff, fixed = (x[~near] for x in (u, v, diff, fixed))
        if lu <= 1 and lv <= 1:
            _leaves(home, other, shift, limit, forest, lu, lv, u, v, extra_limit)
            continue
        if lu >= lv:
            u, v, diff, fixed = _fan(u, len(home.masks[lu - 1]), v, diff, fixed)
            lu -= 1
        else:
            v, u, diff, fixed = _fan(v, len(other.masks[lv - 1]), u, diff, fixed)
            lv -= 1
        common = home.masks[lu][u] & other.masks[lv][v]
        diff = diff + np.bitwise_count((home.patterns[lu][u] ^ other.patterns[lv][v]) & common & ~fixed)
        keep = diff <= limit
        if same and lu == lv:
            keep &= u <= v
        stack.append((lu, lv, *(x[keep] for x in (u, v, diff, common))))


def _chained(home: Tree, other: Tree, lu: int, lv: int, x: int, y: int, extra_limit: int) -> np.ndarray:
    """Which neighbours in the chain through two groups agree in the further bits too."""
    if home.extra is None:
        n = len(home.order[x * FAN**lu : (x + 1) * FAN**lu]) + len(other.order[y * FAN**lv : (y + 1) * FAN**lv])
        return np.ones(n - 1, bool)
    bits = np.concatenate([home.extra[x * FAN**lu : (x + 1) * FAN**lu], other.extra[y * FAN**lv : (y + 1) * FAN**lv]])
    return np.bitwise_count(bits[:-1] ^ bits[1:]) <= extra_limit


def _apart(home: Tree, other: Tree, shift: int, forest: Forest, lu: int, lv: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Which pairs of groups aren't one part already."""
    if not forest.grown:
        return np.ones(len(u), bool)
    root = forest.roots()
    ru, rv = _single(root[home.order], lu, u), _single(root[other.order + shift], lv, v)
    return (ru < 0) | (ru != rv)


def _leaves(home: Tree, other: Tree, shift: int, limit: int, forest: Forest, lu: int, lv: int, u: np.ndarray, v: np.ndarray, extra_limit: int = 64) -> None:
    """Lowest groups: those that aren't one part already are compared bit pattern by bit pattern."""
    for at in range(0, len(u), LEAF_PAIRS):  # a dense part has many links a pair, so few pairs at a time
        x, y = u[at : at + LEAF_PAIRS], v[at : at + LEAF_PAIRS]
        live = _apart(home, other, shift, forest, lu, lv, x, y)
        x, y = x[live], y[live]
        if len(x):
            _compare(home, other, shift, limit, forest, lu, lv, x, y, extra_limit)


def _compare(home: Tree, other: Tree, shift: int, limit: int, forest: Forest, lu: int, lv: int, u: np.ndarray, v: np.ndarray, extra_limit: int) -> None:
    width = np.arange(FAN**lu), np.arange(FAN**lv)
    a = np.minimum(u[:, None].astype(np.int64) * FAN**lu + width[0], len(home.order) - 1)  # the last one again where a group is short
    b = np.minimum(v[:, None].astype(np.int64) * FAN**lv + width[1], len(other.order) - 1)
    at, i, j = np.nonzero(np.bitwise_count(home.patterns[0][a][:, :, None] ^ other.patterns[0][b][:, None, :]) <= limit)
    x, y = a[at, i], b[at, j]
    if home.extra is not None:
        fit = np.bitwise_count(home.extra[x] ^ other.extra[y]) <= extra_limit
        x, y = x[fit], y[fit]
    forest.add(home.order[x], other.order[y] + shift)


def _single(root: np.ndarray, level: int, node: np.ndarray) -> np.ndarray:
    """The root that all below a node share, or -1."""
    at = np.arange(0, len(root), FAN**level)
    low, high = np.minimum.reduceat(root, at), np.maximum.reduceat(root, at)
    return np.where(low == high, low, -1)[node]


def _fan(node: np.ndarray, below: int, *rest: np.ndarray) -> tuple[np.ndarray, ...]:
    """The children of each node, beside what goes with the node."""
    child = (node[:, None] * np.int32(FAN) + np.arange(FAN, dtype=np.int32)).ravel()
    real = child < below
    return tuple(x if real.all() else x[real] for x in (child, *(np.repeat(x, FAN) for x in rest)))


def leading_bits(count: int) -> int:
    """Bits that number the nodes: up to 32 nodes of about 2**15 fingerprints, then nodes of up to 2**22."""
    return max(min(5, (count >> 15).bit_length()), (count >> 22).bit_length())


def visits(rows: DataFrame, p: int, limit: int, group: str | None = None) -> DataFrame:
    """Which node sees each row: its own, and as a guest those of two nodes within ``limit`` leading bits that a hash names.

    Either of two near nodes may look for the links between them; the hash deals
    them evenly. ``fp`` begins with the node's ``p`` bits; ``group`` numbers
    indexes that stay apart. Adds ``node`` and ``guest``.
    """
    lead = F.shiftrightunsigned("fp", 64 - p).cast("int") if p else F.lit(0)
    flips = [0, *(sum(1 << b for b in bits) for k in range(1, limit + 1) for bits in combinations(range(p), k))]
    # the leading bits of a pattern and of its Gray rank determine each other: node numbers are leading bits
    seen = rows.withColumn("_lead", lead).withColumn("_node", F.explode(F.array(*[F.col("_lead").bitwiseXOR(F.lit(x)) for x in flips])))
    low, high = F.least("_lead", "_node"), F.greatest("_lead", "_node")
    host = F.when(F.pmod(F.xxhash64(low, high), F.lit(2)) == 0, low).otherwise(high)
    seen = seen.where(host == F.col("_node")).withColumn("guest", F.col("_node") != F.col("_lead"))
    number = F.col("_node") if group is None else F.col(group) * F.lit(1 << p) + F.col("_node")
    return seen.withColumn("node", number.cast("int")).drop("_lead", "_node")


def links(nodes: DataFrame, limit: int = MAX_BITS, lead_bits: int | None = None) -> DataFrame:
    """Distinct ``fp`` -> edges ``a, b`` (fingerprints) that connect all that are linked.

    The number of nodes, 2**p, follows the count of distinct fingerprints; a
    fingerprint visits its own node, and some of those that differ from it in at
    most ``limit`` leading bits. Each node is a task of its own, which holds the
    node's fingerprints and streams its guests in bounded parts.
    """
    p = leading_bits(nodes.count()) if lead_bits is None else lead_bits
    seen = visits(nodes.select("fp"), p, limit).select("node", "guest", "fp", F.lit(0).cast("long").alias("extra"), F.col("fp").alias("id"))
    return index_links(seen, 1 << p, limit)


def index_links(seen: DataFrame, n_nodes: int, limit: int, extra_limit: int = 64) -> DataFrame:
    """Rows ``node, guest, fp, extra, id`` -> edges ``node, a, b`` between ids: forests of the links that each node finds."""
    ship(seen.sparkSession)
    schema = pa.schema([("node", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])

    def edges(node, own, guests, within):
        x, y = link(own[0].view(np.uint64), guests[0].view(np.uint64), limit, within=within, extra=(own[1].view(np.uint64), guests[1].view(np.uint64)) if extra_limit < 64 else None, extra_limit=extra_limit)
        ids = np.concatenate([own[2], guests[2]])
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(x), node, np.int32)), pa.array(ids[x]), pa.array(ids[y])], schema=schema)

    def joined(parts):
        return tuple(np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(3))

    def run(batches):
        release()
        node, own, held, size = None, [], [], 0
        for batch in batches:
            numbers, guest = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            values = [batch.column(i).to_numpy() for i in range(2, 5)]
            cuts = np.flatnonzero((numbers[1:] != numbers[:-1]) | (guest[1:] != guest[:-1])) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(numbers)]):
                if lo == hi:
                    continue
                if numbers[lo] != node:
                    yield from finish(node, own, held)
                    node, own, held, size = int(numbers[lo]), [], [], 0
                (held if guest[lo] else own).append(tuple(v[lo:hi] for v in values))
                size += (hi - lo) if guest[lo] else 0
                if own and size >= 1 << 20:
                    own = [joined(own)]
                    yield edges(node, own[0], joined(held), False)
                    held, size = [], 0
                elif size >= 1 << 20:  # a node without fingerprints of its own links nothing
                    held, size = [], 0
        yield from finish(node, own, held)
        release()

    def finish(node, own, held):
        if node is None or not own:
            return
        if held:
            yield edges(node, joined(own), joined(held), False)
        yield edges(node, joined(own), joined([]), True)

    placed = seen.select("node", "guest", "fp", "extra", "id").repartitionById(n_nodes, "node")
    return placed.sortWithinPartitions("node", "guest").mapInArrow(run, "node int, a long, b long")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, root``: the least node of each connected part, for nodes with an edge.

    Alternating large-star and small-star steps; sums and minima combine before
    each shuffle and joins may split a hub's rows. Few edges go in few tasks, so a
    round over a small table doesn't leave a file for each shuffle partition.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before, most = None, shuffle_partitions(edges.sparkSession)
    for _ in range(max_rounds):
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
        tasks = min(most, LEAST_TASKS + now.n // EDGES_PER_TASK)
        e = e.coalesce(tasks)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.join(low, both.u == low.k).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(tasks).distinct()
        large = cut(large.coalesce(tasks))
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        small = large.join(least, large.u == least.k).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").coalesce(tasks)
        e = cut(small.unionByName(least.select(F.col("k").alias("u"), F.col("m").alias("v")).coalesce(tasks)).distinct().coalesce(tasks))
    raise RuntimeError(f"components haven't settled in {max_rounds} rounds")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", limit: int = MAX_BITS, size: int = SHINGLE, lead_bits: int | None = None) -> DataFrame:
    """``doc_id, fp, component_id``: the smallest id reachable over links of at most ``limit`` bits."""
    fps = cut(fingerprints(docs, id_col=id_col, text_col=text_col, size=size))
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(links(nodes.select("fp"), limit, lead_bits).select("a", "b"))
    labelled = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = labelled.groupBy("root").agg(F.min("first_id").alias("component_id"))
    ids = labelled.select("fp", "root").join(least, "root").select(F.col("fp").alias("key"), "component_id")
    return fps.join(ids, fps.fp == ids.key).select("doc_id", "fp", "component_id")


def hexadecimal(fp: str = "fp"):
    """Sixteen lower-case digits."""
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
