"""MinHash near-duplicates by one-permutation hashing with optimal densification.

One hash of each shingle does for the whole signature: its upper part names one of
``BANDS * ROWS`` bins, and a bin keeps its least hash. An empty bin takes the value of a
non-empty one that its own fixed random order of bins names first, whichever set it is
(optimal densification: equal sets of non-empty bins are borrowed from alike, and bins
borrow independently of each other). ``ROWS`` bins make a band; texts that agree in a
band share a bucket.

A bucket of m texts yields m - 1 candidate edges, a star around its least node, and
texts with the same node in several buckets share it. Candidates are confirmed on the
full sets (``set_links.linked``). Where a bucket then still holds several components
among the nodes that aren't its hub, a second star is drawn there, and what stays open
after that is checked across components only, so that no
link between texts of one bucket is lost and no group emits all its pairs.

A pair similar by s shares no bucket with probability (1 - s**ROWS)**BANDS: 2e-5 at 0.85.

Texts with equal sets are one node. A text of fewer words than a shingle has one
shingle, a null or empty one none; those are linked with nothing and are components of
their own. Rows with a null id link like others; a component of such rows only has a
null id. Repeated rows stay and share a component. Texts are read whole; extra columns
are left behind; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, only, ship, stage
from .set_links import linked
from .similar_texts import _CODES, _mixed, _node, shingle_sets, shingles
from .tokens import release

BANDS, ROWS = 28, 7
SHINGLE, PERCENT = 3, 85
_RNG = np.random.default_rng(12)
_ODD = _RNG.integers(0, 1 << 64, 64, np.uint64) | np.uint64(1)
#: For each bin, where each bin stands in the order in which it borrows.
_ORDER = np.argsort(_RNG.random((BANDS * ROWS, BANDS * ROWS)), axis=1)


def signature(hashes: np.ndarray, bins: int = BANDS * ROWS, order: np.ndarray = _ORDER) -> np.ndarray:
    """The least hash of each bin, empty bins filled from others; ``hashes``: a set's, sorted and not empty."""
    at = ((hashes >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    first = np.append(True, at[1:] != at[:-1])
    filled = at[first].astype(np.int64)
    out = np.zeros(bins, np.uint64)
    out[filled] = hashes[first]
    if len(filled) < bins:
        empty = np.setdiff1d(np.arange(bins), filled, assume_unique=True)
        out[empty] = out[filled[np.argmin(order[empty][:, filled], axis=1)]]
    return out


def buckets(hashes: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A key for each band."""
    values = signature(hashes).reshape(bands, rows)
    total = np.arange(1, bands + 1, dtype=np.uint64) * _ODD[-1]
    for j in range(rows):
        total = _mixed(total + _mixed(values[:, j] * _ODD[j]))
    return total


def signatures(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``doc_id, node, n, keys``: each row's set by its hash, its size, its buckets (none for an empty set)."""
    ship(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def run(batches):
        release()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part, out = batch.slice(at, 500), []
                for text in part.column(1):
                    own = shingles(text.as_py(), size)
                    out.append((_node(own), len(own), buckets(own).view(np.int64) if len(own) else []))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), *(pa.array(c, f.type) for c, f in zip(zip(*out), list(schema)[1:]))], schema=schema)
        _CODES.clear()
        release()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, node long, n long, keys array<long>")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id``: the smallest id reachable over pairs of sets with 100 * shared >= ``percent`` * united."""
    slim = only(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    marks = stage(signatures(slim, size), "signatures")
    nodes = cut(marks.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("first_id"), F.any_value("n").alias("n"), F.any_value("keys").alias("keys")))
    banded = nodes.select("node", "n", F.explode("keys").alias("key"))
    hubs = banded.groupBy("key").agg(F.min(F.struct("node", "n")).alias("h"), F.max("node").alias("_top")).where("h.node < _top").select("key", F.col("h.node").alias("hub"), F.col("h.n").alias("hub_n"))
    busy = stage(banded.join(hubs, "key"), "buckets")
    ids = nodes.join(busy.select("node").distinct(), "node", "left_semi").select(F.col("first_id").alias("_id"))
    texts = slim.join(ids, slim.doc_id == ids["_id"], "left_semi").unionByName(slim.where("doc_id is null"))
    sets = stage(shingle_sets(texts, size).dropDuplicates(["node"]), "shingle-sets")

    roots = linked(busy, sets, percent)
    labelled = nodes.join(roots, "node", "left").select("node", "first_id", F.coalesce("root", "node").alias("root"))
    lowest = labelled.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = labelled.join(lowest, "root").select(F.col("node").alias("_node"), "component_id")
    out = marks.select("doc_id", "node", "n").join(named, (F.col("node") == F.col("_node")) & (F.col("n") > 0), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
