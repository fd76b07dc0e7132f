"""Approximate nearest neighbours by inverted lists (IVF): a coarse quantiser, lists as a partitioned table, probes that prune it.

- ``fit``: spherical k-means on a documented sample. Each round is a job: tasks assign
  their rows and return sums a centroid; what reaches the driver is one vector a centroid.
- ``write_index``: every row goes to the list of its nearest centroid; the lists are a
  Parquet table partitioned by ``list``, a large list in several files.
- ``search``: a block of queries (bounded) names the lists it probes; the scan reads these
  partitions only. A task scores its rows of a list against the queries that probe the list, as
  one matrix product, and keeps the best ``k`` of each; the rest is a top-k over
  tasks' bests.

- ``calibrated``: how many lists a query must probe follows from the data: neighbours of a bounded
  number of rows, found exactly, and where their lists stand in the probing order. Clustered vectors
  need few lists; vectors without any structure need most of them.

Exact search over all rows stays ``ranking.knn``; ``recall`` compares the two. Rows without a
vector, with one of another length or of zero length aren't indexed: cosine ranks them nowhere.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .lineage import cut
from .ranking import knn

#: Vectors sampled a centroid; centroids at most (they travel to every task); queries of a block; rows a file of a list.
SAMPLE_PER_LIST, MAX_LISTS, BLOCK, FILE_ROWS = 64, 4096, 4096, 200_000
#: Queries scored against an Arrow batch at a time.
SCORED = 128
#: Share of the lists that a query probes unless it is calibrated; rows whose neighbours calibrate it.
PROBES, CALIBRATE = 0.25, 128


def lists_for(rows: int) -> int:
    """About the root of the rows, so that scanning centroids and scanning lists cost alike."""
    return max(1, min(MAX_LISTS, round(math.sqrt(rows))))


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-30)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dims)


def usable(chunks: DataFrame, vector: str, key: str, dims: int) -> DataFrame:
    """``key, v`` of the rows that have a direction."""
    v = F.col(vector).cast("array<float>")
    sound = (F.size(v) == dims) & F.exists(v, lambda x: x != 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x))
    return chunks.where(v.isNotNull() & sound).select(F.col(key).alias("key"), v.alias("v"))


def fit(chunks: DataFrame, *, vector: str = "embedding", key: str = "id", dims: int, lists: int | None = None, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Unit centroids, ``lists x dims``, from a sample of at most ``SAMPLE_PER_LIST`` rows a list (by a hash of the key)."""
    rows = usable(chunks, vector, key, dims)
    total = rows.count()
    lists = min(lists or lists_for(total), max(1, total))
    share = min(1.0, SAMPLE_PER_LIST * lists / max(1, total))
    drawn = F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))
    sample = cut(rows.where(drawn).select("v", F.xxhash64("key").alias("h")))
    start = sample.orderBy("h").limit(lists).collect()  # as many rows as lists
    centroids = unit(np.array([r.v for r in start], np.float32).reshape(-1, dims))
    schema = "list int, n long, total array<double>"

    def partial(batches: Iterator[pa.RecordBatch], centers: np.ndarray) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(centers.shape), np.zeros(len(centers), np.int64)
        for batch in batches:
            x = unit(_matrix(batch.column(0), dims))
            near = np.argmax(x @ centers.T, axis=1)
            np.add.at(total, near, x)
            n += np.bincount(near, minlength=len(centers))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at]), pa.array(list(total[at]), pa.list_(pa.float64()))], names=["list", "n", "total"])

    for _ in range(rounds):
        found = sample.select("v").mapInArrow(lambda batches, c=centroids: partial(batches, c), schema)
        sums = found.select("list", F.posexplode("total").alias("at", "x")).groupBy("list", "at").agg(F.sum("x").alias("x")).groupBy("list").agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("t"))
        moved = centroids.copy()
        for r in sums.collect():  # one row a centroid
            moved[r.list] = [x for _, x in r.t]
        moved = unit(moved)
        if np.abs(moved - centroids).max() < 1e-5:
            break
        centroids = moved.astype(np.float32)
    return centroids


def assigned(chunks: DataFrame, centroids: np.ndarray, *, vector: str = "embedding", key: str = "id") -> DataFrame:
    """``key, v, list``: each row's nearest centroid (ties: the first)."""
    dims = centroids.shape[1]
    rows = usable(chunks, vector, key, dims)
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            near = np.argmax(unit(_matrix(batch.column(1), dims)) @ centroids.T, axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near, pa.int32())], names=["key", "v", "list"])

    return rows.mapInArrow(run, f"key {kind}, v array<float>, list int")


def write_index(chunks: DataFrame, centroids: np.ndarray, path: str, *, vector: str = "embedding", key: str = "id") -> None:
    """The inverted lists as ``path/list=…``; lists of over ``FILE_ROWS`` rows are dealt over several tasks and files."""
    rows = cut(assigned(chunks, centroids, vector=vector, key=key))
    parts = rows.groupBy("list").agg(F.ceil(F.count("*") / F.lit(FILE_ROWS)).cast("int").alias("_parts"))  # one row a list
    dealt = rows.join(F.broadcast(parts), "list").withColumn("_part", F.pmod(F.xxhash64("key"), F.col("_parts")))
    dealt.repartition("list", "_part").drop("_parts", "_part").write.mode("overwrite").partitionBy("list").parquet(path)


def probed(vectors: np.ndarray, centroids: np.ndarray, probes: int) -> np.ndarray:
    """Which queries (unit vectors) probe each list: a packed bit a query, ``lists x ceil(queries / 8)``, so a block's plan stays small."""
    asks = np.zeros((len(centroids), len(vectors)), bool)
    near = np.argsort(-(vectors @ centroids.T), axis=1, kind="stable")[:, :probes]
    asks[near.ravel(), np.repeat(np.arange(len(vectors)), near.shape[1])] = True
    return np.packbits(asks, axis=1)


def calibrated(chunks: DataFrame, centroids: np.ndarray, path: str, k: int, *, target: float = 0.95, vector: str = "embedding", key: str = "id") -> int:
    """The least number of lists to probe at which ``target`` of the ``k`` nearest rows of ``CALIBRATE`` rows (by a hash of the key) are found."""
    spark = chunks.sparkSession
    rows = cut(usable(chunks, vector, key, centroids.shape[1]).orderBy(F.xxhash64("key", F.lit(11)), "key").limit(CALIBRATE).select(F.row_number().over(Window.orderBy("key")).cast("long").alias("qid"), F.col("v").alias("qvec")))
    lists = spark.read.parquet(path).select("key", "list")
    near = knn(usable(chunks, vector, key, centroids.shape[1]), rows, k, vector="v", key="key").select("qid", "key").join(lists, "key").select("qid", "list").collect()  # k rows a query
    if not near:
        return 1
    vectors = {r.qid: np.array(r.qvec, np.float32) for r in rows.collect()}
    place = {q: np.argsort(np.argsort(-(v @ centroids.T), kind="stable"), kind="stable") for q, v in vectors.items()}
    needed = np.sort([place[r.qid][r.list] + 1 for r in near])
    return int(needed[min(len(needed) - 1, math.ceil(target * len(needed)) - 1)])


def search(spark: SparkSession, path: str, centroids: np.ndarray, queries: DataFrame, k: int, *, probes: int | None = None) -> DataFrame:
    """``qid, key, score, rank``: the best ``k`` rows of the lists that each query (``qid long, qvec``) probes; ties by key.

    Queries are taken in blocks of ``BLOCK``; a block's plan reads only the partitions its queries probe.
    """
    probes = probes or max(1, math.ceil(PROBES * len(centroids)))
    index = spark.read.parquet(path)
    kind = index.schema["key"].dataType.simpleString()
    dims, q = centroids.shape[1], cut(queries.select("qid", F.col("qvec").cast("array<float>").alias("qvec")))
    blocks = max(1, -(-q.count() // BLOCK))
    out = None
    for block in range(blocks):
        rows = q.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == block).collect()  # about BLOCK rows
        if not rows:
            continue
        ids, vectors = np.array([r.qid for r in rows], np.int64), unit(np.array([r.qvec for r in rows], np.float32))
        asks = probed(vectors, centroids, probes)
        shared = spark.sparkContext.broadcast((ids, vectors, asks))

        def run(batches, shared=shared):
            ids, vectors, asks = shared.value
            for batch in batches:
                lists = batch.column(2).to_numpy()
                for at in np.unique(lists).tolist():
                    part = batch.filter(pa.array(lists == at))
                    x = unit(_matrix(part.column(1), dims)).astype(np.float64)
                    here = np.flatnonzero(np.unpackbits(asks[at], count=len(ids)))
                    for first in range(0, len(here), SCORED):
                        some = here[first : first + SCORED]
                        scores = x @ vectors[some].astype(np.float64).T
                        best = np.argpartition(-scores, min(2 * k, len(scores)) - 1, axis=0)[: 2 * k]  # rounding may tie: more than k go on
                        held = part.column(0).take(pa.array(best.ravel()))
                        yield pa.RecordBatch.from_arrays([pa.array(np.tile(ids[some], len(best))), held, pa.array(np.take_along_axis(scores, best, 0).ravel())], names=["qid", "key", "score"])

        hits = index.where(F.col("list").isin(np.flatnonzero(asks.any(axis=1)).tolist())).select("key", "v", "list").mapInArrow(run, f"qid long, key {kind}, score double")
        hits = hits.withColumn("score", F.round("score", 6))
        top = hits.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc(), "key"))).where(F.col("rank") <= k)
        out = top if out is None else out.unionByName(top)
    return out if out is not None else index.select(F.lit(0).cast("long").alias("qid"), "key", F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """``queries, recall``: the share of exact ``qid, key`` pairs that were found."""
    hit = exact.select("qid", "key").join(found.select("qid", "key", F.lit(1).alias("hit")), ["qid", "key"], "left")
    return hit.agg(F.count_distinct("qid").alias("queries"), (F.count("hit") / F.count("*")).alias("recall"))
