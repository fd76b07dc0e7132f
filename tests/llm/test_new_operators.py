"""Spelling variants, MinHash near-duplicates and the conversation trie against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.llm import minhash, prefix_trie, set_links, similar_texts, spelling
from sieveline.llm import queries as q


# --- spelling variants


def brute_variants(docs, least=7, count=2, factor=10):
    held = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 31 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            held[word] += 1
    n = {w: c for w, c in held.items() if len(w) >= least and c >= count}
    near = {w: set() for w in n}
    by = defaultdict(set)
    for w in n:
        for i in range(len(w)):
            by[w[:i], w[i + 1 :]].add(w)
    for w in n:
        for i in range(len(w)):
            near[w] |= by[w[:i], w[i + 1 :]] - {w}
            if (shorter := w[:i] + w[i + 1 :]) in n:
                near[w].add(shorter)
                near[shorter].add(w)
    form = {w: min(near[w], key=lambda x: (-n[x], x)) for w in n if near[w]}
    form = {w: f for w, f in form.items() if n[f] >= factor * n[w]}
    out = {}
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None)
    return out


def got_variants(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def test_variants_of_the_given_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute_variants([(r.doc_id, r.text) for r in docs.collect()])
    assert len(want) > 300 and any(f for f, *_ in want.values())
    assert got_variants(q.op11_deletion_variants(spark, sf)) == want


def test_variants_chains_ties_and_long_runs(spark):
    rng = random.Random(3)
    long = "".join(rng.choices("abcdé", k=199))
    words = ["lettering"] * 400 + ["letterin"] * 40 + ["letteri"] * 4 + ["lettexing"] * 3 + ["aabbaabb"] * 30 + ["aabbaab"] * 3 + ["ÀÀbbccdd", "Ààbbccdd"] * 2
    words += [long, long + "x", "y" + long + "x", long[:50] + "z" + long[51:] + "x"] * 3 + ["q" * 3000, "q" * 3001, "q" * 1500 + "r" + "q" * 1500] * 2 + ["w" * 50_000] * 2
    rows = [(None, None, 1), (None, "", 1), (None, "lettering, lettering", 1), (3, "a b \n lettering", 1)] + [(i, w if i % 2 else f"{w}. x", 0) for i, w in enumerate(words)] + [(9, "  ", 1)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, word long")
    assert got_variants(spelling.variants(df)) == brute_variants([r[:2] for r in rows])
    assert spelling.variants(df.where("false")).collect() == []


def test_deletion_keys_are_those_of_the_shorter_strings():
    words = ["abcdefgh", "aacdefgh", "éßabcdef"]
    without, _ = spelling.keys(words)
    for i, w in enumerate(words):
        for j in range(8):
            assert spelling.keys([w[:j] + w[j + 1 :]])[1][0] == without[i, j]


def test_one_apart():
    for a, b, is_near in [("abc", "abc", False), ("abc", "abd", True), ("abc", "ab", True), ("abc", "bc", True), ("abc", "acb", False), ("ab", "abcd", False), ("aab", "ab", True), ("abc", "xbcd", False)]:
        assert spelling.one_apart(a, b) == spelling.one_apart(b, a) == is_near


# --- MinHash


def brute_minhash(rows, percent=85):
    sets = {}
    for doc_id, text in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", "".join(c.lower() if c < "\x80" else c for c in text or ""))
        sets.setdefault(frozenset(tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))) if w else frozenset(), []).append(doc_id)
    keys, holders, root = list(sets), defaultdict(list), {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, k in enumerate(keys):
        for j in {j for s in k for j in holders[s]}:
            if 100 * len(k & keys[j]) >= percent * len(k | keys[j]):
                root[find(k)] = find(keys[j])
        for s in k:
            holders[s].append(i)
    low = {}
    for k in keys:
        low[find(k)] = min([d for d in [low.get(find(k)), *sets[k]] if d is not None], default=None)
    return sorted(((d, len(k), d if not k else low[find(k)]) for k in keys for d in sets[k]), key=str)


def got_minhash(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def test_minhash_of_the_given_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = q.op12_one_permutation_minhash(spark, sf)
    assert got_minhash(found) == brute_minhash([(r.doc_id, r.text) for r in docs.collect()])
    assert found.where("kept <> (doc_id = component_id)").count() == 0


def test_minhash_of_copies_near_the_limit(spark):
    rng = random.Random(5)
    lexicon, rows = [f"w{i}" for i in range(800)], [(-1, None), (-2, ""), (-3, " \n"), (-4, "one"), (-5, "ONE"), (-6, "one two"), (None, "one two"), (None, "lonely words here x"), (-7, "x " * 20_000), (-8, "é É"), (-9, "é É")]
    for _ in range(120):
        words = rng.choices(lexicon, k=rng.choice([8, 20, 60, 150, 400]))
        rows.append((len(rows), " ".join(words)))
        for _ in range(4):
            copy = list(words)
            for _ in range(rng.randrange(0, max(2, len(copy) // 30))):
                copy[rng.randrange(len(copy))] = rng.choice(lexicon)
            rows.append((len(rows), " ".join(copy + rng.choices(lexicon, k=rng.randrange(2)))))
    words = rng.choices(lexicon, k=150)
    for _ in range(300):  # a group whose copies are about as similar as the limit
        rows.append((len(rows), " ".join(rng.choice(lexicon) if rng.random() < 0.022 else w for w in words)))
    rows += rows[20:23]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, node long, key int")
    assert got_minhash(minhash.near_duplicates(docs)) == brute_minhash(rows)
    assert minhash.near_duplicates(docs.where("false")).count() == 0


def test_signatures_agree_as_often_as_sets_do():
    rng = np.random.default_rng(2)
    for n, shared in ((12, 11), (40, 36), (300, 270)):
        same = 0
        for _ in range(60):
            every = rng.integers(0, 1 << 63, 2 * n - shared, np.uint64)
            a, b = np.sort(every[:n]), np.sort(every[n - shared :])
            same += (minhash.signature(a) == minhash.signature(b)).mean()
        assert abs(same / 60 - shared / (2 * n - shared)) < 0.035


def test_bins_borrow_from_any_set_alike():
    one = minhash.signature(np.array([5], np.uint64))
    assert (one == 5).all()
    h = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 20, np.uint64) * np.uint64(2))
    assert set(minhash.signature(h).tolist()) <= set(h.tolist())


def test_links_across_components_equal_all_pairs(spark):
    """Blocks of a few bytes, several keys, one large component and stragglers."""
    rng = random.Random(8)
    lexicon = [f"v{i}" for i in range(60)]
    texts = [" ".join(rng.choices(lexicon, k=40)) for _ in range(12)]
    rows = [(i, " ".join(rng.choice(lexicon) if rng.random() < 0.02 else w for w in texts[i % 12].split())) for i in range(120)]
    sets = {int(np.int64(similar_texts._node(s))): s for s in (similar_texts.shingles(t, 3) for _, t in rows)}
    nodes = sorted(sets)
    frame = spark.createDataFrame([(n, bytearray(s.tobytes())) for n, s in sets.items()], "node long, hashes binary")
    held = [(k, n, n if i > 40 else nodes[0], len(sets[n])) for i, n in enumerate(nodes) for k in {i % 3, i % 2}]
    rest = spark.createDataFrame(held, "key long, node long, root long, n long")
    root = {n: r for _, n, r, _ in held}
    keys = defaultdict(set)
    for k, n, *_ in held:
        keys[n].add(k)

    def joined(edges):
        part = dict(root)
        for a, b in edges:
            x, y = part[a], part[b]
            part = {n: x if p == y else p for n, p in part.items()}
        return {frozenset(n for n in nodes if part[n] == p) for p in part.values()}

    every = [(a, b) for a in nodes for b in nodes if a < b and keys[a] & keys[b] and set_links.enough(len(np.intersect1d(sets[a], sets[b])), len(sets[a]), len(sets[b]), 60)]
    got = [(r.a, r.b) for r in set_links.cross_links(rest, frame, 60, block_bytes=3000).collect()]
    assert {frozenset(e) for e in got} <= {frozenset(e) for e in every} and joined(got) == joined(every) != joined([])


# --- the conversation trie


def brute_trie(rows, rebuilt=True):
    talk = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            talk[c].append((turn is not None, turn or 0, role or "", text or ""))
    talk = {c: [x[2:] for x in sorted(t)] for c, t in talk.items()}
    if rebuilt:
        share = {c: zlib.crc32(str(c).encode()) % 6 for c in talk}
        talk = {c: talk.get(c - c % 100, [])[: share[c]] + t[share[c] :] for c, t in talk.items()}
    nodes = defaultdict(list)
    for c, t in talk.items():
        for d in range(len(t) + 1):
            nodes[tuple(t[:d])].append(c)
    children = Counter(k[:-1] for k in nodes if k)
    leaves, saved = Counter(), Counter()
    for k, m in nodes.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1]) if k else 0
    return sorted(
        (min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k], hashlib.sha256(",".join(str(c) for c in sorted(m) if len(talk[c]) == len(k)).encode()).hexdigest())
        for k, m in nodes.items()
    )


def got_trie(df):
    return sorted(((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect()))


def test_trie_of_the_given_conversations(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got_trie(q.op13_prefix_trie(spark, sf)) == brute_trie(rows)


def odd_conversations():
    rng = random.Random(4)
    rows = [(None, 1, "user", "x"), (700, None, None, None), (700, 3, "user", ""), (700, 3, "user", ""), (700, 3, "assistant", "é" * 9), (701, 0, "user", "z" * 200_000)]
    for c in range(60):
        start = rng.randrange(3)
        rows += [(c, t, "user" if t % 2 else "system", f"turn {t} of {start if t < 5 else rng.randrange(2)}") for t in range(rng.randrange(1, 9))]
    for c in (900, 901, 902):  # copies of a long conversation, one of them longer
        rows += [(c, t, "user", f"line {t % 7}") for t in range(70 + (c == 902) * 3)]
    return rows


def test_trie_with_odd_rows(spark):
    rows = odd_conversations()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, pos int, key string")
    turns = prefix_trie.turns(df)
    assert got_trie(prefix_trie.trie(turns, turns.select("conv_id"))) == brute_trie(rows, rebuilt=False)
    assert prefix_trie.trie(prefix_trie.turns(df.where("false")), turns.where("false").select("conv_id")).count() == 0
    one = prefix_trie.turns(df.where("conv_id = 700"))
    assert got_trie(prefix_trie.trie(one, one.select("conv_id"))) == brute_trie([r for r in rows if r[0] == 700], rebuilt=False)


def test_long_conversations_cross_ranges_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "MAX_BLOCK", 8)
    monkeypatch.setattr(prefix_trie, "BUCKET", 5)
    rows = odd_conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = prefix_trie.turns(df)
    assert got_trie(prefix_trie.trie(turns, turns.select("conv_id"))) == brute_trie(rows, rebuilt=False)


@pytest.mark.parametrize("n", [0, 1, 5])
def test_lists_of_ends_in_pieces(spark, monkeypatch, n):
    monkeypatch.setattr(prefix_trie, "PIECE", 2)
    ends = spark.range(n).select(F.lit(3).cast("long").alias("depth"), F.lit(b"a").alias("name"), F.col("id").alias("conv_id"))
    got = [tuple(r) for r in prefix_trie.digests(ends).collect()]
    assert got == ([(3, bytearray(b"a"), hashlib.sha256(",".join(map(str, range(n))).encode()).hexdigest())] if n else [])
