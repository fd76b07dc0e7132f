"""Embedding and the write path (M1-M9, J1-J4, J8-J10, P2): misses only, staged merges.

Parquet has no row updates: a merge is the old rows without the replaced keys and
the new ones, written beside the old partition and then swapped in.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import is_sensitive
from .codeintel import secret_findings

DIMS = 256


def hashed_embedding(text: str | None, dims: int = DIMS) -> list[float]:
    """A deterministic, offline stand-in for a model: signed hashed words, length 1. It knows nothing of meaning."""
    v = np.zeros(dims)
    for w in (text or "").lower().split():
        h = zlib.crc32(w.encode("utf-8", "surrogatepass"))
        v[h % dims] += 1.0 if h >> 31 else -1.0
    n = np.linalg.norm(v)
    return (v / n if n else v).astype(np.float32).tolist()


def embed(text: Column, model=hashed_embedding) -> Column:
    """M1: a pluggable embedder ``str -> list[float]`` over Arrow batches; models load once per worker."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(model)

    return run(text)


def provider_chain(*attempts: Column) -> Column:
    """M2: the first provider that gave a vector."""
    return F.coalesce(*attempts)


def provider_choice(attempts: DataFrame, timeout_ms: float) -> DataFrame:
    """M2 over what providers answered: ``key, used, tried, timed_out, skipped`` from ``key, provider, place, ok, ms, local, sensitive`` rows.

    Providers are asked in their places' order until one answers in time. Those that
    aren't local are never asked for a sensitive text. ``used`` is null if none answered.
    """
    allowed = F.col("local") | ~F.col("sensitive")
    good = allowed & F.col("ok") & (F.col("ms") <= timeout_ms)
    first = attempts.where(good).groupBy("key").agg(F.min("place").alias("_first"), F.min_by("provider", "place").alias("used"))
    asked = attempts.join(first, "key", "left").where(F.col("_first").isNull() | (F.col("place") <= F.col("_first")))
    return asked.groupBy("key").agg(F.any_value("used").alias("used"), F.count_if(allowed).alias("tried"), F.count_if(allowed & (F.col("ms") > timeout_ms)).alias("timed_out"), F.count_if(~allowed).alias("skipped"))


def breaker_state(failures: DataFrame, now: Column, threshold: int = 3, cooldown_seconds: int = 30) -> DataFrame:
    """M3: per provider closed, open or half-open, from ``provider, ts, ok`` rows: failures since the last success."""
    ok = failures.groupBy("provider").agg(F.max(F.when(F.col("ok"), F.col("ts"))).alias("good"))
    j = failures.join(ok, "provider").where(~F.col("ok") & (F.col("good").isNull() | (F.col("ts") > F.col("good"))))
    last = j.groupBy("provider").agg(F.count("*").alias("n"), F.max("ts").alias("failed_at"))
    state = F.when(F.coalesce("n", F.lit(0)) < threshold, "closed").when(now >= F.col("failed_at") + F.make_interval(secs=F.lit(cooldown_seconds)), "half-open").otherwise("open")
    return failures.select("provider").distinct().join(last, "provider", "left").select("provider", state.alias("state"))


def pool_member(key: Column, size: int) -> Column:
    """M4: a member of a pool of endpoints, evenly by hash; partitions do what goroutines do elsewhere."""
    return F.pmod(F.xxhash64(key), F.lit(size)).cast("int")


def split_by_cache(inputs: DataFrame, cache: DataFrame, model: str) -> tuple[DataFrame, DataFrame]:
    """``key, text`` with ``input_hash`` -> those whose vector a model's cache holds (``embedding``), and the others."""
    h = inputs.withColumn("input_hash", F.sha2("text", 256))
    held = cache.where(F.col("model") == model).select("input_hash", "embedding")
    return h.join(held, "input_hash"), h.join(held, "input_hash", "left_anti")


def embed_missing(inputs: DataFrame, cache: DataFrame, model: str, fn=hashed_embedding) -> tuple[DataFrame, DataFrame]:
    """M5: ``key, text`` -> vectors by input hash from the cache, the others computed once each; also the new cache rows."""
    h = inputs.withColumn("input_hash", F.sha2("text", 256))
    held = cache.where(F.col("model") == model).select("input_hash", "embedding")
    new = split_by_cache(inputs, cache, model)[1].groupBy("input_hash").agg(F.first("text").alias("text")).select("input_hash", embed(F.col("text"), fn).alias("embedding"))
    return h.join(held.unionByName(new), "input_hash", "left"), new.withColumn("model", F.lit(model))


def deduplicated_vectors(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks with ``emb_hash`` instead of vectors, and the dictionary of vectors."""
    h = chunks.withColumn("emb_hash", F.when(F.col("embedding").isNotNull(), F.sha2(F.to_json(F.struct("embedding")), 256)))
    return h.drop("embedding"), h.where("emb_hash is not null").groupBy("emb_hash").agg(F.first("embedding").alias("embedding"))


def with_vectors(chunks: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Own vectors, else the dictionary's."""
    d = dictionary.select("emb_hash", F.col("embedding").alias("_v"))
    own = F.col("embedding") if "embedding" in chunks.columns else F.lit(None).cast("array<float>")
    return chunks.join(d, "emb_hash", "left").withColumn("embedding", F.coalesce(own, F.col("_v"))).drop("_v")


def orphan_vectors(dictionary: DataFrame, chunks: DataFrame) -> DataFrame:
    """Vectors that no chunk refers to."""
    return dictionary.join(chunks.select("emb_hash").where("emb_hash is not null").distinct(), "emb_hash", "left_anti")


def not_up_to_date(files: DataFrame, stored: DataFrame, chunks: DataFrame) -> DataFrame:
    """M6: files (``path, hash``) that aren't stored with this hash and a chunk at least."""
    done = stored.join(chunks.select(F.col("file_id").alias("id")).distinct(), "id", "left_semi").select("path", "hash").distinct()
    return files.join(done, ["path", "hash"], "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace those of the same keys."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new.select(*old.columns))


def in_worktree(files: DataFrame, manifest: DataFrame, worktree: str) -> DataFrame:
    """Files of the worktree's manifest, by project, path and hash."""
    return files.join(manifest.where(F.col("worktree") == worktree), ["project_id", "path", "hash"], "left_semi")


def set_worktree(manifest: DataFrame, new: DataFrame) -> DataFrame:
    """M9: the manifest of a (project, worktree) is replaced as a whole."""
    return upsert(manifest, new, ["project_id", "worktree"])


def prune_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files that some worktree has, and history."""
    kept = files.join(manifest.select("project_id", "path", "hash").distinct(), ["project_id", "path", "hash"], "left_semi")
    return kept.where(~F.col("path").like("git:%")).unionByName(files.where(F.col("path").like("git:%")))


def prune_edges(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Edges whose source still exists."""
    return edges.join(files.select(F.col("path").alias("source_file")).distinct(), "source_file", "left_semi")


def embedding_route(path: Column, content: Column, mode: Column) -> Column:
    """M8: where a text may be embedded: ``local`` for sensitive ones (none at all if the mode is cloud), ``cloud`` otherwise."""
    secret = is_sensitive(path) | (F.size(secret_findings(content)) > 0)
    return F.when(mode == "edge", "local").when(secret & (mode == "cloud"), "none").when(secret, "local").otherwise("cloud")


def encode_vector(v: Column) -> Column:
    """32-bit floats, little-endian."""

    @F.pandas_udf("binary")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda a: None if a is None else np.asarray(a, "<f4").tobytes())

    return run(v)


def decode_vector(b: Column) -> Column:
    """F9."""

    @F.pandas_udf("array<float>")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda raw: None if raw is None else np.frombuffer(raw, "<f4"))

    return run(b)


def union_models(lists: list[DataFrame]) -> DataFrame:
    """Model names of several providers in first-seen order; short lists."""
    every = reduce(DataFrame.unionByName, [x.select("model", F.lit(i).alias("at")) for i, x in enumerate(lists)])
    return every.groupBy("model").agg(F.min("at").alias("at")).orderBy("at", "model")
