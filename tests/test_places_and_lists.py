"""The positional index against brute force, and the inverted lists against exact search."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.operators import ann, positional, ranking

TEXTS = [None, "", "a b a c b", "b a", "c", "A-b, c! a", "x a x x b x c b a", "b " * 50 + "c a", "a a a b b c"]


def brute_covers(words, terms):
    """Stretches with all terms that hold no shorter one."""
    spots = [i for i, w in enumerate(words) if w in terms]
    full = {(i, j) for i in spots for j in spots if i <= j and set(terms) <= set(words[i : j + 1])}
    least = {(i, j) for i, j in full if not any((x, y) != (i, j) and i <= x and y <= j for x, y in full)}
    return sorted((i + 1, j + 1, sum(w not in terms for w in words[i : j + 1])) for i, j in least)


def split(text):
    return "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()


@pytest.fixture(scope="module")
def chunks(spark):
    rng = random.Random(3)
    texts = TEXTS + [" ".join(rng.choices("abcdef", k=rng.randrange(1, 40))) for _ in range(60)]
    return spark.createDataFrame(list(enumerate(texts)), "id long, content string"), texts


@pytest.mark.parametrize("terms", [["a"], ["a", "b"], ["c", "A", "b"], ["a", "zzz"]])
def test_covers_and_ranks(spark, chunks, terms):
    df, texts = chunks
    index = positional.build(df)
    want = {i: c for i, t in enumerate(texts) if (c := brute_covers(split(t), [x.lower() for x in terms]))}
    got = {}
    for r in positional.covers(index, terms).collect():
        got.setdefault(r.key, []).append((r.start, r.end, r.noise))
    assert {k: sorted(v) for k, v in got.items()} == want
    ranks = {r.key: (r.covers, r.shortest, r.rank) for r in positional.cover_rank(index, terms).collect()}
    assert ranks == {k: (len(c), min(e - s + 1 for s, e, _ in c), pytest.approx(sum(0.1 / (1 + n) for *_, n in c), abs=1e-8)) for k, c in want.items()}


def test_phrases_and_the_written_index(spark, chunks, tmp_path):
    df, texts = chunks
    path = str(tmp_path / "index")
    positional.write(positional.build(df), path, parts=8)
    for words in (["a", "b"], ["b", "a", "b"], ["a", "a"]):
        index = positional.read(spark, path, words, parts=8)
        plan = index._jdf.queryExecution().executedPlan().toString()
        assert "part#" in plan.split("PartitionFilters: [")[1].split("]")[0]
        got = {r.key: list(r.places) for r in positional.phrase(index, words).collect()}
        want = {i: p for i, t in enumerate(texts) if (p := [j + 1 for j in range(len(split(t))) if split(t)[j : j + len(words)] == words])}
        assert got == want
    assert [tuple(r) for r in positional.build(df.where("false")).collect()] == []


def test_places_of_a_few_terms_are_those_of_the_index(spark, chunks):
    df, _ = chunks
    few, every = positional.build(df, terms=["a", "C"]), positional.build(df).where("term in ('a', 'c')")
    assert sorted(map(str, few.collect())) == sorted(map(str, every.collect()))


def vectors(spark, n=4000, dims=16, groups=40):
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(groups, dims))
    x = centers[rng.integers(0, groups, n)] + rng.normal(size=(n, dims)) * 0.6
    rows = [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))]
    rows += [(n, None), (n + 1, [0.0] * dims), (n + 2, [1.0, 2.0]), (n + 3, rows[7][1])]
    return spark.createDataFrame(rows, "id long, embedding array<float>")


def test_inverted_lists_find_what_exact_search_finds(spark, tmp_path):
    df, path = vectors(spark), str(tmp_path / "lists")
    centroids = ann.fit(df, dims=16)
    assert len(centroids) == ann.lists_for(4002) and np.allclose(np.linalg.norm(centroids, axis=1), 1, atol=1e-4)
    ann.write_index(df, centroids, path)
    assert spark.read.parquet(path).count() == 4001
    asked = df.where("id % 50 = 0 and id < 4000").select(F.col("id").alias("qid"), F.col("embedding").alias("qvec"))
    exact = ranking.knn(df.where("id not in (4001, 4002)"), asked, 10)
    got = ann.recall(ann.search(spark, path, centroids, asked, 10), exact).first()
    assert got.queries == 80 and got.recall >= 0.9
    probes = ann.calibrated(df, centroids, path, 10)
    assert probes < len(centroids) / 2 and ann.recall(ann.search(spark, path, centroids, asked, 10, probes=probes), exact).first().recall >= 0.9
    every = ann.search(spark, path, centroids, asked, 10, probes=len(centroids))
    assert ann.recall(every, exact).first().recall >= 0.999
    assert every.groupBy("qid").count().where("count <> 10").isEmpty()


def test_a_search_reads_only_the_lists_it_probes(spark, tmp_path):
    df, path = vectors(spark, 600), str(tmp_path / "lists")
    centroids = ann.fit(df, dims=16)
    ann.write_index(df, centroids, path)
    one = df.where("id = 3").select(F.col("id").alias("qid"), F.col("embedding").alias("qvec"))
    found = ann.search(spark, path, centroids, one, 5, probes=1)
    assert "PartitionFilters: [isnotnull(list" in (plan := found._jdf.queryExecution().executedPlan().toString()) or "PartitionFilters: [(list" in plan, plan
    assert found.orderBy("rank").first().key == 3
    assert ann.search(spark, path, centroids, one.where("false"), 5).count() == 0


def test_cover_density_of_a_row_is_that_of_the_index(spark, chunks):
    df, _ = chunks
    for terms in (["a"], ["b", "c"], ["c", "a", "b"]):
        want = {r.key: r.rank for r in positional.cover_rank(positional.build(df), terms).collect()}
        got = {r.id: r.rank for r in df.select("id", positional.cover_density(F.col("content"), terms).alias("rank")).collect()}
        assert {k: pytest.approx(v, abs=1e-8) for k, v in want.items()} == {k: v for k, v in got.items() if v}


def test_functions_by_name_in_sql(spark):
    from sieveline.functions.surface import register_functions

    assert "sieve_embed" in register_functions(spark)
    row = spark.sql("SELECT sieve_cosine(array(3f, 4f), array(3f, 4f)) AS a, sieve_cosine(array(0f), array(1f)) AS b, sieve_cosine(array(1f), array(1f, 2f)) AS c, sieve_dirname('x/y/z.go') AS d, sieve_dirname('z') AS e, sieve_rrf(1) AS f, size(sieve_embed('a b')) AS n").first()
    assert tuple(row) == (1.0, 0.0, 0.0, "x/y", ".", pytest.approx(1 / 61), 256)
    assert [tuple(r) for r in spark.sql("SELECT * FROM sieve_paragraphs('a\\n\\n b \\n \\n\\nc')").collect()] == [(0, "a"), (1, "b"), (2, "c")]
