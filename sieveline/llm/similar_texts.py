"""Operator 3 for a similarity: texts whose five-word shingle sets are similar by ``LEAST`` or more.

At 0.8 two 64-bit fingerprints differ in about ten bits, too many for one index to
prune anything. So a text gets a longer fingerprint, bits of which make several
short ones, each with a Gray-order index of its own (``simhash_gray``):

1. Texts with equal shingle sets are one node. A node's fingerprint has ``EXTRA``
   bits and then ``tables`` patterns of ``bits`` bits. ``plan`` chooses both from
   the number of texts: so many bits that few unrelated patterns link at
   ``LIMIT`` bits, and so many tables that a pair at ``LEAST`` is linked in none with a
   probability of ``MISS`` at most.
2. Each table's index links nodes whose patterns differ in at most ``LIMIT`` bits and
   whose extra bits in at most ``EXTRA_LIMIT``. A component of a table's links is a
   key of its nodes.
3. Every link is checked on the sets (``set_links.linked``): a node against the least
   node of its keys, then of what is left of a key; keys that still hold several
   components are put together where they share nodes, so each node is held once, and
   checked across components in blocks bounded by bytes. Before that, rows grow with a
   group's size, not its square.
4. Components come from ``simhash_gray.components``.

Words are those of ``simhash_gray.fingerprint``. A text of fewer words than a
shingle has one shingle, a null or empty one none; all of the latter are one node.
Rows with a null id take no part in checks and are components of their set's other
rows, or have none. Repeated rows share a node. Texts are read whole; extra columns
are left behind; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, only, ship, stage
from .set_links import linked
from .simhash_gray import bit_votes, components, index_links, visits
from .tokens import release

SEED = 42
SHINGLE = 5
LEAST, PERCENT = 0.8, 80
LIMIT = 2
EXTRA, EXTRA_LIMIT = 64, 24
#: Least probability of a pair at ``LEAST`` to share no key; unrelated patterns that a pattern may link to on average.
MISS, CHANCE = 0.002, 1 / 32
#: Texts in a node of a table's index.
NODE_TEXTS = 1 << 20
_RNG = np.random.default_rng(SEED)
_ODD = _RNG.integers(0, 1 << 64, 1024, np.uint64) | np.uint64(1)
_PLUS = _RNG.integers(0, 1 << 64, 1024, np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Codes(dict):
    """Hash of a word; a bounded cache."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return h


_CODES = _Codes()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The distinct shingles' hashes in order."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    codes = np.fromiter(map(_CODES.__getitem__, words), np.uint64, len(words))
    width = min(size, len(words))
    total = len(words) - width + 1
    sums = np.full(total, width, np.uint64)
    for j in range(width):
        sums = _mixed(sums + codes[j : j + total] * _ODD[j % 64])
    return np.unique(sums)


def plan(n: int, least: float = LEAST) -> tuple[int, int]:
    """Bits of a pattern and number of tables for ``n`` texts.

    A bit differs with probability acos(cosine) / pi; of two sets of one size
    similar by s the cosine is 2 s / (1 + s).
    """
    differs = math.acos(2 * least / (1 + least)) / math.pi
    bits = 16
    while max(n, 1) * sum(math.comb(bits, k) for k in range(LIMIT + 1)) > CHANCE * 2.0**bits:
        bits += 1
    linked = sum(math.comb(bits, k) * differs**k * (1 - differs) ** (bits - k) for k in range(LIMIT + 1))
    return bits, math.ceil(math.log(MISS) / math.log1p(-linked))


def patterns(hashes: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """A set's extra bits, then its patterns, each in the leading bits of an unsigned 64-bit word."""
    words = -(-(EXTRA + bits * tables) // 64)
    votes = np.zeros(words * 64, np.int64)
    for at in range(0, len(hashes), 4080):
        part = hashes[at : at + 4080, None]
        votes += bit_votes(_mixed(part * _ODD[:words] + _PLUS[:words]))
    one = (votes * 2 > len(hashes)).astype(np.uint8)
    filled = np.zeros((tables, 64), np.uint8)
    filled[:, :bits] = one[EXTRA : EXTRA + bits * tables].reshape(tables, bits)
    every = np.concatenate([np.packbits(one[:EXTRA]), np.packbits(filled, axis=1).ravel()])
    return every.view(">u8").astype(np.uint64)


def _node(hashes: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).view(np.int64)) if len(hashes) else 0


def signatures(docs: DataFrame, size: int, bits: int, tables: int) -> DataFrame:
    """``doc_id, node, n, marks``: each row's set, the number of its shingles, its extra bits and patterns (none for an empty set)."""
    ship(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("marks", pa.list_(pa.int64()))])

    def run(batches):
        release()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sets = [shingles(t.as_py(), size) for t in part.column(1)]
                marks = [patterns(s, bits, tables).view(np.int64) if len(s) else [] for s in sets]
                columns = [[_node(s) for s in sets], [len(s) for s in sets], marks]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:]))], schema=schema)
        _CODES.clear()  # a reused worker keeps nothing for other operators' tasks
        release()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, node long, n long, marks array<long>")


def table_keys(nodes: DataFrame, n: int, tables: int) -> DataFrame:
    """``node, key``: for each table the component of its index's links that a node lies in, if it has any link there."""
    p = max(0, (n // NODE_TEXTS).bit_length())
    extra = F.element_at("marks", 1)
    rows = nodes.select("node", extra.alias("extra"), F.posexplode(F.slice("marks", 2, tables)).alias("table", "fp"))
    seen = visits(rows.select(F.col("node").alias("id"), "extra", "table", "fp"), p, LIMIT, "table")
    found = cut(index_links(seen, tables << p, LIMIT, EXTRA_LIMIT).select(F.shiftright("node", p).alias("table"), "a", "b"))
    if not p:  # a table is one node: its edges lead from one member of a component to the others
        key = F.xxhash64("table", "a")
        return found.select(F.col("b").alias("node"), key.alias("key")).unionByName(found.select(F.col("a").alias("node"), key.alias("key")).distinct())
    place = lambda c: F.xxhash64("table", c)  # noqa: E731  a node as one of a table's
    roots = components(found.select(place("a").alias("a"), place("b").alias("b")))
    ends = found.select(place("a").alias("_p"), F.col("a").alias("node")).unionByName(found.select(place("b").alias("_p"), F.col("b").alias("node"))).distinct()
    roots = roots.withColumnRenamed("node", "_of")  # a root has no row of its own
    return ends.join(roots, ends["_p"] == roots["_of"], "left").select("node", F.coalesce("root", "_p").alias("key"))


def shingle_sets(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``node, hashes``: the sets themselves, as bytes."""
    ship(docs.sparkSession)
    schema = pa.schema([("node", pa.int64()), ("hashes", pa.binary())])

    def run(batches):
        release()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                sets = [shingles(t.as_py(), size) for t in batch.column(0).slice(at, 500)]
                yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], schema=schema)
        _CODES.clear()
        release()

    return docs.select("text").mapInArrow(run, "node long, hashes binary")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``doc_id, node, component_id``: the smallest id reachable over pairs of sets with 100 * shared >= ``percent`` * united."""
    slim = only(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    total = slim.count()
    bits, tables = plan(total, percent / 100)
    marks = cut(signatures(slim, size, bits, tables))
    nodes = cut(marks.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.any_value("n").alias("n"), F.any_value("marks").alias("marks")))
    marks = marks.select("doc_id", "node")
    found = table_keys(nodes.where("first_id is not null and n > 0"), total, tables)
    nodes = nodes.drop("marks")
    banded = found.join(nodes.select("node", "n"), "node").distinct()
    hubs = banded.groupBy("key").agg(F.min(F.struct("node", "n")).alias("h"), F.max("node").alias("_top")).where("h.node < _top").select("key", F.col("h.node").alias("hub"), F.col("h.n").alias("hub_n"))
    busy = cut(banded.join(hubs, "key"))
    ids = nodes.join(busy.select("node").distinct(), "node", "left_semi").select(F.col("first_id").alias("_id"))
    sets = stage(shingle_sets(slim.join(ids, slim.doc_id == ids["_id"], "left_semi"), size).dropDuplicates(["node"]), "shingle-sets")
    roots = linked(busy, sets, percent, merge=True)
    labelled = nodes.join(roots, "node", "left").select("node", "first_id", F.coalesce("root", "node").alias("root"))
    lowest = labelled.groupBy("root").agg(F.min("first_id").alias("component_id"))
    ids = labelled.join(lowest, "root").select(F.col("node").alias("_node"), "component_id")
    return marks.join(ids, marks.node == ids["_node"]).select("doc_id", "node", "component_id")
