"""Retrieval evaluation (V1-V8, J20, J21, A19): runs joined with judgements, windows and means.

``run``: ``qid, file, rank`` (1-based); ``qrels``: ``qid, file, grade``. A file
counts at its first rank only, but its repeats use up ranks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import discount, gain


def judged(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """The run with grades (0 if not judged) at first occurrences."""
    w = Window.partitionBy("qid", "file").orderBy("rank")
    first = run.withColumn("_n", F.row_number().over(w))
    return first.join(qrels, ["qid", "file"], "left").withColumn("grade", F.when(F.col("_n") == 1, F.coalesce("grade", F.lit(0))).otherwise(0)).drop("_n")


def metrics(run: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """V1-V4: ``qid, ndcg, mrr, precision, recall`` for every judged query; ``k`` is clipped to the list's length."""
    j = judged(run, qrels)
    n = F.least(F.lit(k), F.col("n"))
    lengths = run.groupBy("qid").agg(F.count("*").alias("n"))
    top = j.join(lengths, "qid")
    got = top.groupBy("qid").agg(
        F.first("n").alias("n"),
        F.sum(F.when(F.col("rank") <= n, gain(F.col("grade")) / discount(F.col("rank"))).otherwise(0.0)).alias("dcg"),
        F.min(F.when(F.col("grade") > 0, F.col("rank"))).alias("best"),
        F.count_if((F.col("grade") > 0) & (F.col("rank") <= n)).alias("hits"),
    )
    ideal = qrels.where("grade > 0").withColumn("_i", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("grade").desc(), "file"))).join(lengths, "qid", "left")
    idcg = ideal.groupBy("qid").agg(F.sum(F.when(F.col("_i") <= F.least(F.lit(k), F.coalesce("n", F.lit(0))), gain(F.col("grade")) / discount(F.col("_i"))).otherwise(0.0)).alias("idcg"), F.count("*").alias("relevant"))
    out = idcg.join(got, "qid", "left")
    return out.select(
        "qid",
        F.when(F.col("idcg") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("idcg")).otherwise(0.0).alias("ndcg"),
        F.coalesce(1.0 / F.col("best"), F.lit(0.0)).alias("mrr"),
        F.when(F.coalesce("n", F.lit(0)) > 0, F.coalesce("hits", F.lit(0)) / F.least(F.lit(k), F.col("n"))).otherwise(0.0).alias("precision"),
        F.when(F.col("relevant") > 0, F.coalesce("hits", F.lit(0)) / F.col("relevant")).otherwise(0.0).alias("recall"),
    )


def summarize(observations: DataFrame) -> DataFrame:
    """``qid, run, latency_ms, route, failed, ndcg, ...`` rows: medians per query, then means and nearest-rank percentiles."""
    done = observations.where("not failed")
    per = done.groupBy("qid").agg(F.median("latency_ms").alias("latency_ms"), *[F.avg(c).alias(c) for c in ("ndcg", "mrr", "precision", "recall")])
    disc = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY latency_ms)")
    means = per.agg(F.count("*").alias("queries"), *[F.avg(c).alias(c) for c in ("ndcg", "mrr", "precision", "recall")], disc(0.5).alias("p50"), disc(0.95).alias("p95"), disc(0.99).alias("p99"))
    failed = observations.agg(F.count_if("failed").alias("failed"), F.count_if(F.col("route") != "vector").alias("fallbacks"))
    return means.join(failed, F.lit(True))


def route_counts(observations: DataFrame) -> DataFrame:
    """V5."""
    return observations.groupBy("route").agg(F.count("*").alias("n"))


def compare(baseline: DataFrame, candidate: DataFrame, columns: tuple[str, ...] = ("ndcg", "mrr", "precision", "recall")) -> DataFrame:
    """Differences by query, candidate less baseline."""
    b = candidate.select("qid", *[F.col(c).alias(f"_{c}") for c in columns])
    return baseline.join(b, "qid").select("qid", *[(F.col(f"_{c}") - F.col(c)).alias(f"d_{c}") for c in columns])


def route_transitions(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """V6: how many queries went from one route to another."""
    return baseline.select("qid", F.col("route").alias("before")).join(candidate.select("qid", F.col("route").alias("after")), "qid").where("before <> after").groupBy("before", "after").agg(F.count("*").alias("n"))


#: What a comparison may lose.
THRESHOLDS = {"ndcg": 0.01, "mrr": 0.01, "precision": 0.01, "recall": 0.01, "p95_ms": 50.0, "failed": 0, "fallbacks": 0}


def gate(baseline: DataFrame, candidate: DataFrame, limits: dict[str, float] = THRESHOLDS) -> DataFrame:
    """V7: one row a violated threshold of two summaries."""
    a, b = baseline.select(F.struct("*").alias("a")), candidate.select(F.struct("*").alias("b"))
    tests = [F.when(F.col(f"a.{m}") - F.col(f"b.{m}") > limits[m], m) for m in ("ndcg", "mrr", "precision", "recall")]
    tests += [F.when(F.col("b.p95") - F.col("a.p95") > limits["p95_ms"], "p95_ms"), F.when(F.col("b.failed") > limits["failed"], "failed"), F.when(F.col("b.fallbacks") > limits["fallbacks"], "fallbacks")]
    return a.join(b, F.lit(True)).select(F.explode(F.filter(F.array(*tests), lambda x: x.isNotNull())).alias("violated"))


def validate(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """V8: ``qid, problem``: empty or repeated ids, empty texts, no judgement, grades outside 1 to 3, paths that leave the tree."""
    from ..functions.scalars import valid_relative_path

    ids = queries.groupBy("qid").agg(F.count("*").alias("n")).where("n > 1").select("qid", F.lit("repeated id").alias("problem"))
    own = queries.select("qid", F.explode(F.filter(F.array(F.when(F.coalesce("qid", F.lit("")) == "", "empty id"), F.when(F.trim(F.coalesce("query", F.lit(""))) == "", "empty query")), lambda x: x.isNotNull())).alias("problem"))
    none = queries.join(qrels.select("qid").distinct(), "qid", "left_anti").select("qid", F.lit("no judgement").alias("problem"))
    bad = qrels.select("qid", F.explode(F.filter(F.array(F.when(~F.col("grade").between(1, 3), "grade outside 1 to 3"), F.when(~valid_relative_path(F.col("file")), "unsafe path")), lambda x: x.isNotNull())).alias("problem"))
    return ids.unionByName(own).unionByName(none).unionByName(bad).distinct()
