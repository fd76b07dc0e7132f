"""Retrieval and ranking (W*, J5, U3, U5): scores, fusions and caps as windows and joins.

Every ranking ends with a unique key, so results don't depend on partitioning.
Scores are rounded to nine digits before they are compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import cosine, is_sensitive, norm, rerank_terms, search_words

#: Fixed values of fusion: rank constant, bonus for a hit in both legs.
RRF_K, OVERLAP_BONUS = 60, 0.02
#: Fixed values of BM25.
K1, B = 1.2, 0.75
#: The engine compares vectors of at most this many queries by one broadcast; more go in blocks.
MAX_BROADCAST_QUERIES = 4096
#: Longest result list that is ranked as a whole; a longer one is an error, as one task would hold it.
MAX_RESULTS = 1_000_000


def similar(chunks: DataFrame, query: list[float], k: int, *, vector: str = "embedding", key: str = "id") -> DataFrame:
    """The ``k`` rows of largest cosine (all if ``k`` is 0 or less), ties by key; rows without a vector don't take part."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = chunks.where(F.col(vector).isNotNull()).withColumn("score", cosine(F.col(vector), q, norm_b=F.lit(sum(float(x) ** 2 for x in query) ** 0.5)))
    ordered = scored.orderBy(F.col("score").desc(), key)
    return ordered.limit(k) if k > 0 else ordered


def _best(batches, asked, k: int):
    """``qid, key, score`` of rows that may be among a query's best ``k`` of this task; ``asked``: ids and matrices by length of vector.

    Single precision tells which pairs may reach the worst of a query's best so far; those are scored in double.
    """
    held = {d: np.full((len(ids), k), -np.inf) for d, (ids, _) in asked.items()}
    for batch in batches:
        batch = batch.take(pc.sort_indices(batch.column(0)))  # ties go by key
        column = batch.column(1)
        sizes, flat = pc.list_value_length(column).to_numpy(zero_copy_only=False), column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        starts = np.cumsum(sizes) - sizes
        for d, (ids, q) in asked.items():
            whole = np.flatnonzero(sizes == d)  # what has another length scores 0
            x = np.zeros((len(sizes), d))
            x[whole] = flat[starts[whole][:, None] + np.arange(d)]
            for at in range(0, len(x), 2048):
                rows = x[at : at + 2048]
                lengths = np.sqrt((rows * rows).sum(1))
                lengths[lengths == 0] = 1.0
                single = (rows / lengths[:, None]).astype(np.float32).T
                for first in range(0, len(ids), 512):
                    part, best = q[first : first + 512], held[d][first : first + 512]
                    own = np.sqrt((part * part).sum(1))
                    own[own == 0] = 1.0
                    near = (part / own[:, None]).astype(np.float32) @ single
                    floor = best[:, 0]
                    if len(rows) > k and np.isinf(floor).any():
                        floor = np.maximum(floor, np.partition(near, len(rows) - k, axis=1)[:, len(rows) - k])
                    i, j = np.nonzero(near >= (floor - 1e-5 - 1e-6 * d)[:, None])
                    score = np.empty(len(i))
                    for c in range(0, len(i), 1 << 15):
                        u, v = i[c : c + (1 << 15)], j[c : c + (1 << 15)]
                        score[c : c + (1 << 15)] = np.einsum("ij,ij->i", part[u], rows[v]) / (own[u] * lengths[v])
                    score = np.round(score, 9) + 0.0
                    order = np.lexsort((j, -score, i))
                    i, j, score = i[order], j[order], score[order]
                    place = np.arange(len(i)) - np.searchsorted(i, i)
                    kept = (place < k) & (score >= best[i, 0])
                    i, j, score, place = i[kept], j[kept], score[kept], place[kept]
                    if len(i):
                        new = np.full((len(part), k), -np.inf)
                        new[i, place] = score
                        best[:] = np.sort(np.concatenate([best, new], axis=1), axis=1)[:, -k:]
                        yield pa.RecordBatch.from_arrays([pa.array(ids[first + i]), batch.column(0).take(pa.array(at + j)), pa.array(score)], names=["qid", "key", "score"])


def knn(chunks: DataFrame, queries: DataFrame, k: int, *, vector: str = "embedding", key: str = "id") -> DataFrame:
    """The ``k`` nearest rows of each query (``qid long, qvec``): ``qid, key, score, rank``.

    A stated query set against all rows: queries travel in blocks of bounded size, a
    task multiplies its rows with a block as matrices and passes on what may be among
    the best. Vectors with elements that are null or not finite are compared one by one.
    """
    plain = lambda v: v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < 1e15))
    q = queries.select("qid", "qvec", norm(F.col("qvec")).alias("qnorm"))
    rows = chunks.where(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).alias("v"), norm(F.col(vector)).alias("vnorm"))
    kind, session = rows.schema["key"].dataType.simpleString(), chunks.sparkSession
    blocks = max(1, -(-q.count() // MAX_BROADCAST_QUERIES))
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), "key")
    out = None
    for block in range(blocks):
        part = q.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == block)
        asked: dict = {}
        for r in part.where(plain(F.col("qvec"))).select(F.col("qid").cast("long").alias("qid"), F.col("qvec").cast("array<double>").alias("qvec")).collect():  # about MAX_BROADCAST_QUERIES rows
            asked.setdefault(len(r.qvec), []).append(r)
        shared = session.sparkContext.broadcast({d: (np.array([r.qid for r in rs], np.int64), np.array([r.qvec for r in rs], np.float64).reshape(len(rs), d)) for d, rs in asked.items()})
        sound = rows.where(plain(F.col("v"))).select("key", F.col("v").cast("array<double>").alias("v"))
        near = sound.mapInArrow(lambda batches, shared=shared: _best(batches, shared.value, k), f"qid long, key {kind}, score double")
        one_by_one = lambda r, p: r.join(F.broadcast(p), F.lit(True)).select(F.col("qid").cast("long").alias("qid"), "key", F.round(cosine(F.col("qvec"), F.col("v"), F.col("qnorm"), F.col("vnorm")), 9).alias("score"))
        odd = one_by_one(rows.where(~plain(F.col("v"))), part)
        pairs = near.unionByName(odd)
        if part.count() > sum(map(len, asked.values())):
            pairs = pairs.unionByName(one_by_one(rows.where(plain(F.col("v"))), part.where(~plain(F.col("qvec")) | F.col("qvec").isNull())))
        top = pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        out = top if out is None else out.unionByName(top)
    return out


def keyword_coverage(chunks: DataFrame, words: list[str], k: int, *, text: str = "content", key: str = "id") -> DataFrame:
    """How many words a text holds in any case; ties by key."""
    if not words:
        return chunks.withColumn("score", F.lit(0.0)).limit(0)
    score = sum((F.col(text).ilike(f"%{w}%").cast("double") for w in words), F.lit(0.0))
    return chunks.withColumn("score", score).where("score > 0").orderBy(F.col("score").desc(), key).limit(k)


def tokens_of(text: Column) -> Column:
    """Letter and digit runs in lower case without accents (a decomposition is not built in, so the common Latin ones are mapped)."""
    plain = F.translate(F.lower(text), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    return F.filter(F.split(plain, r"[^\p{L}\p{N}]+"), lambda t: t != "")


def postings(chunks: DataFrame, *, text: str = "content", key: str = "id", terms: list[str] | None = None) -> DataFrame:
    """The inverted index: ``term, key, tf, dl``. Write it bucketed by ``term`` to reuse its partitioning.

    ``terms``: only these, picked before the words become rows, for one query without an index.
    """
    t = chunks.select(F.col(key).alias("key"), tokens_of(F.col(text)).alias("_t"))
    wanted = F.col("_t") if terms is None else F.filter("_t", lambda x: x.isin([w.lower() for w in terms]))
    return t.select("key", F.size("_t").alias("dl"), F.explode(wanted).alias("term")).groupBy("key", "dl", "term").agg(F.count("*").alias("tf")).select("term", "key", "tf", "dl")


def bm25(index: DataFrame, totals: DataFrame, terms: list[str], k: int | None = None) -> DataFrame:
    """``key, score`` over an index; ``totals``: one row ``n`` (texts), ``avgdl``. Any term may match; ties by key."""
    hit = index.where(F.col("term").isin([t.lower() for t in terms]))
    df = hit.groupBy("term").agg(F.count("*").alias("df"))  # as many rows as the query has terms
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = hit.join(F.broadcast(df), "term").join(F.broadcast(totals), F.lit(True)).groupBy("key").agg(F.round(F.sum(part), 9).alias("score"))
    return scored if k is None else scored.orderBy(F.col("score").desc(), "key").limit(k)


def append_leg(first: DataFrame, second: DataFrame, k: int, key: str = "key") -> DataFrame:
    """The first leg's rows in their order, then the second's that aren't among them with score 0; the first ``k``."""
    legs = first.select(key, "score", F.lit(0).alias("leg")).unionByName(second.select(key, F.lit(0.0).alias("score"), F.lit(1).alias("leg")))
    once = legs.groupBy(key).agg(F.min(F.struct("leg", (-F.col("score")).alias("neg"))).alias("m")).select(key, (-F.col("m.neg")).alias("score"), F.col("m.leg").alias("leg"))
    return once.orderBy("leg", F.col("score").desc(), key).limit(k)


def with_rank(df: DataFrame, *order: Column, partition: list[str] | None = None, name: str = "rank") -> DataFrame:
    """1-based ranks. Without a partition ``df`` must be a result list of at most ``MAX_RESULTS`` rows."""
    if partition:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*partition).orderBy(*order)))
    return df.withColumn(name, _bounded(F.row_number().over(Window.orderBy(*order))))


def _bounded(n: Column) -> Column:
    """The number, or an error if it is over ``MAX_RESULTS``."""
    return F.when(n > MAX_RESULTS, F.raise_error(F.lit(f"a result list of over {MAX_RESULTS} rows"))).otherwise(n)


def fuse_rrf(vector: DataFrame, keyword: DataFrame, k: int, keys: tuple[str, ...] = ("path", "start_line")) -> DataFrame:
    """Two ranked result lists (``keys, score, rank``) -> ``keys, score, source``, divided by the largest.

    If either list is empty the other one comes back as it is, uncut. Ties: the
    vector leg's order, then the keyword leg's.
    """
    v, w = vector.select(*keys, F.col("rank").alias("r1"), F.col("score").alias("s1")), keyword.select(*keys, F.col("rank").alias("r2"), F.col("score").alias("s2"))
    sizes = v.agg(F.count("*").alias("nv")).join(w.agg(F.count("*").alias("nw")), F.lit(True))
    both = F.col("r1").isNotNull() & F.col("r2").isNotNull()
    raw = F.coalesce(1.0 / (RRF_K + F.col("r1")), F.lit(0.0)) + F.coalesce(1.0 / (RRF_K + F.col("r2")), F.lit(0.0)) + F.when(both, OVERLAP_BONUS).otherwise(0.0)
    sizes = sizes.withColumn("nv", _bounded(F.col("nv"))).withColumn("nw", _bounded(F.col("nw")))  # counted before the window below takes them all
    joined = v.join(w, list(keys), "full").join(F.broadcast(sizes), F.lit(True)).withColumn("raw", F.round(raw, 9))
    alone = (F.col("nv") == 0) | (F.col("nw") == 0)
    order = [F.col("raw").desc(), F.col("r1").asc_nulls_last(), F.col("r2").asc_nulls_last()]
    ranked = joined.withColumn("_n", F.row_number().over(Window.orderBy(*order))).withColumn("_top", F.max("raw").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    score = F.when(alone, F.coalesce("s1", "s2")).otherwise(F.col("raw") / F.col("_top"))
    source = F.when(F.col("r1").isNotNull(), "vector").otherwise("keyword")
    return ranked.where(alone | (F.col("_n") <= k)).select(*keys, score.alias("score"), source.alias("source"), F.col("_n").alias("rank"))


def fuse_projects(results: DataFrame, k: int | None = None) -> DataFrame:
    """Per-project lists (``project, path, start_line, end_line, score, source_rank``) -> one, by summed reciprocal ranks.

    Duplicates keep the row of best score; ``source_rank`` is that of the first.
    """
    w = Window.partitionBy("project").orderBy("source_rank", F.col("score").desc(), "path", "start_line")
    ranked = results.withColumn("_r", F.row_number().over(w))
    keys = ["project", "path", "start_line", "end_line"]
    fused = ranked.groupBy(*keys).agg(F.round(F.sum(1.0 / (RRF_K + F.col("_r"))), 9).alias("fusion"), F.max("score").alias("score"), F.min_by("source_rank", "_r").alias("source_rank"))
    ordered = fused.orderBy(F.col("fusion").desc(), F.col("score").desc(), "project", "path", "start_line")
    return ordered if k is None else ordered.limit(k)


def over_fetch(results: DataFrame, k: int, most: int = 1000) -> DataFrame:
    """Each project's first ``min(2k, most)`` rows."""
    w = Window.partitionBy("project").orderBy(F.col("score").desc(), "path", "start_line")
    return results.withColumn("source_rank", F.row_number().over(w)).where(F.col("source_rank") <= min(2 * k, most))


def diversify(ranked: DataFrame, per_file: int, per_project: int, k: int) -> DataFrame:
    """Caps per file, then per project, in rank order: ``project, path, rank``; files belong to one project, so this equals the greedy loop."""
    in_file = Window.partitionBy("project", "path").orderBy("rank")
    in_project = Window.partitionBy("project").orderBy("rank")
    kept = ranked.withColumn("_f", F.row_number().over(in_file)).where(F.col("_f") <= per_file)
    kept = kept.withColumn("_p", F.row_number().over(in_project)).where(F.col("_p") <= per_project)
    return kept.orderBy("rank").limit(k).drop("_f", "_p")


def diversify_loop(rows: list[tuple], per_file: int, per_project: int, k: int) -> list[tuple]:
    """W12, the older form: a bare file counts across projects, so the two caps interact; rows ``(project, path, ...)`` of a bounded list."""
    files: dict[str, int] = {}
    projects: dict[str, int] = {}
    out = []
    for row in rows:
        project, path = row[0], row[1]
        if projects.get(project, 0) >= per_project or files.get(path, 0) >= per_file:
            continue
        projects[project] = projects.get(project, 0) + 1
        files[path] = files.get(path, 0) + 1
        out.append(row)
        if len(out) == k:
            break
    return out


def lexical_rerank(results: DataFrame, query: str, weight: float = 0.3, text: str = "content") -> DataFrame:
    """A new ``rank`` by ``(1 - w) * score + w * share of the query's terms``; the score stays. A bounded result list."""
    terms = rerank_terms(F.lit(query))
    low = F.lower(F.col(text))
    share = F.when(F.size(terms) == 0, 0.0).otherwise(F.size(F.filter(terms, lambda t: F.contains(low, t))) / F.size(terms))
    blend = F.round((1 - weight) * F.col("score") + weight * share, 9)
    return results.withColumn("blend", blend).withColumn("rank", F.row_number().over(Window.orderBy(F.col("blend").desc(), "rank")))


def merge_expanded(hits: DataFrame, expanded: DataFrame) -> DataFrame:
    """Original hits, then graph hits of paths not among them, one each, by score."""
    w = Window.partitionBy("path").orderBy(F.col("score").desc(), "chunk_index")
    new = expanded.join(hits.select("path").distinct(), "path", "left_anti").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return hits.unionByName(new.select(*hits.columns)).orderBy(F.col("score").desc(), "path")


def pack_context(ranked: DataFrame, budget: int, *, block: str = "block", least: int = 60) -> DataFrame:
    """Blocks in rank order within a byte budget; the last may be cut between characters, and one left with under ``least`` bytes ends it. A bounded list."""
    w = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sized = ranked.withColumn("_n", F.octet_length(block)).withColumn("_sum", F.sum("_n").over(w))
    room = F.lit(budget) - (F.col("_sum") - F.col("_n"))

    @F.pandas_udf("string")
    def clip(texts, rooms):
        return texts.combine(rooms, lambda t, r: t.encode()[: int(r)].decode("utf-8", "ignore"))

    kept = sized.withColumn("_room", room.cast("long")).where((F.col("_n") <= F.col("_room")) | (F.col("_room") >= least))
    return kept.withColumn(block, F.when(F.col("_n") <= F.col("_room"), F.col(block)).otherwise(clip(F.col(block), F.col("_room")))).drop("_n", "_sum", "_room")


def chat_window(messages: DataFrame, keep_users: int, conversation: str = "conv_id", turn: str = "turn") -> DataFrame:
    """The last ``keep_users`` user turns of each conversation and what follows them, and its leading system messages."""
    back = Window.partitionBy(conversation).orderBy(F.col(turn).desc())
    forth = Window.partitionBy(conversation).orderBy(turn)
    counted = messages.withColumn("_users", F.sum((F.col("role") == "user").cast("int")).over(back)).withColumn("_other", F.sum((F.col("role") != "system").cast("int")).over(forth))
    last = (F.col("_users") < keep_users) | ((F.col("_users") == keep_users) & (F.col("role") == "user"))
    return counted.where((F.col("_other") == 0) | (last & (F.col("_users") <= keep_users) & ~((F.col("_users") == 0) & F.lit(keep_users == 0)))).drop("_users", "_other")


def query_terms(query: Column) -> Column:
    """The terms of a request."""
    return search_words(query)


def hybrid_route(vector: DataFrame | None, keyword: DataFrame | None, k: int, keys: tuple[str, ...] = ("path", "start_line")) -> DataFrame:
    """The fused lists with ``route``: hybrid, or the leg that is left if the other one failed (is None); an empty leg failed nothing.

    Whichever way, rows are those of ``fuse_rrf``; with neither leg there is nothing to answer with.
    """
    if vector is None and keyword is None:
        raise ValueError("both legs failed")
    one = vector if vector is not None else keyword
    route = "hybrid" if vector is not None and keyword is not None else "vector" if vector is not None else "keyword"
    none = one.limit(0)
    fused = fuse_rrf(vector if vector is not None else none, keyword if keyword is not None else none, k, keys)
    return fused.where(F.col("rank") <= k).withColumn("route", F.lit(route))


def without_sensitive(sources: DataFrame, path: str = "path") -> DataFrame:
    """What may go into a prompt: sources whose path isn't sensitive."""
    return sources.where(~is_sensitive(F.col(path)))


def probe_dimensions(tables: list[DataFrame], column: str = "embedding") -> DataFrame:
    """``dims`` of the first table, in their order, that holds a vector; each table gives one row at most."""
    first = [t.where(F.col(column).isNotNull()).select(F.lit(i).alias("_i"), F.size(column).alias("dims")).limit(1) for i, t in enumerate(tables)]
    out = first[0]
    for one in first[1:]:
        out = out.unionByName(one)
    return out.orderBy("_i").limit(1).select("dims")


def text_scan(chunks: DataFrame, project: str, words: list[str], *, text: str = "content") -> DataFrame:
    """A project's chunks that hold one of the words; the project's filter reaches the scan, as a partition's or a row group's."""
    low = F.lower(F.col(text))
    hit = F.lit(False)
    for w in words:
        hit = hit | low.contains(w.lower())
    return chunks.where((F.col("project") == project) & hit)


def cached_results(results: DataFrame, cache: DataFrame, now, ttl_seconds: int, size: int) -> DataFrame:
    """The cache after new ``query, at, answer`` rows: those younger than ``ttl_seconds``, the last written of a query, the ``size`` newest in all."""
    every = cache.unionByName(results.select(*cache.columns))
    newest = every.groupBy("query").agg(F.max("at").alias("at"), F.max_by("answer", F.struct("at", "answer")).alias("answer"))
    live = newest.where(F.col("at") > now - F.make_interval(secs=F.lit(ttl_seconds)))
    return live.orderBy(F.col("at").desc(), "query").limit(size)
