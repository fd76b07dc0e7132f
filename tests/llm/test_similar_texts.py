"""The near-duplicate stage against brute-force Jaccard similarity of five-word shingles."""

import random

import corpus_pipeline as p
from sieveline.llm import similar_texts


def brute(rows, least=0.8):
    """Each id's least id over pairs similar enough, and the number of such pairs of unequal sets."""

    def of(text):
        w = (text or "").lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = {}
    for doc_id, text in rows:
        sets.setdefault(of(text), []).append(doc_id)
    keys, holders, near = list(sets), {}, 0
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, k in enumerate(keys):
        for j in {j for s in k for j in holders.get(s, ())}:
            if len(k & keys[j]) >= least * len(k | keys[j]) - 1e-9:
                near += 1
                root[find(k)] = find(keys[j])
        for s in k:
            holders.setdefault(s, []).append(i)
    low = {}
    for k in keys:
        low[find(k)] = min(low.get(find(k), min(sets[k])), *sets[k], min(sets[k]))
    return {d: low[find(k)] for k in keys for d in sets[k]}, near


def test_near_copies_of_similarity_of_0_8(spark):
    rng = random.Random(7)
    lexicon, rows = [f"w{i}" for i in range(900)], [(-1, None), (-2, ""), (-3, "one two"), (-4, "One  two")]
    for base in range(150):
        words = rng.choices(lexicon, k=rng.choice([12, 60, 150, 400]))
        rows.append((len(rows), " ".join(words)))
        for _ in range(4):
            copy = list(words)
            for _ in range(rng.randrange(1, max(2, len(copy) // 30))):
                copy[rng.randrange(len(copy))] = rng.choice(lexicon)
            rows.append((len(rows), " ".join(copy)))
    words = rng.choices(lexicon, k=150)
    for _ in range(250):  # a group whose copies are about as similar as the limit
        rows.append((len(rows), " ".join(rng.choice(lexicon) if rng.random() < 0.02 else w for w in words)))
    want, near = brute(rows)
    assert near > 300
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in similar_texts.near_duplicates(docs).collect()} == want
    assert {r.doc_id for r in p.near_duplicates(spark, docs, "").collect()} == set(want.values())


def test_given_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want, _ = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert {r.doc_id: r.component_id for r in similar_texts.near_duplicates(docs).collect()} == want
