"""The training-data operators against brute force, exact round trips and odd inputs."""

import collections
import html
import math
import random
import re
import struct
import zlib

import numpy as np
import pytest
import xxhash

from sieveline.llm import centroids, decontaminate, divergence, edit_counts, html_region, hypershuffle, importance, kk_pack, rans, simhash_gray
from sieveline.llm import queries as q
from sieveline.llm.tokens import PieceTokenizer, vocabulary_path

BYTES, WORDS = vocabulary_path("byte_bpe_50k.json"), vocabulary_path("word_bpe_49k.json")
ODD = [None, "", " ", "\n\n", "a", "word " * 3000, "the same text " * 5, "the same text " * 5, "é ñ 日本語 x", "x" * 5000, "<|endoftext|> a  b\t\n c"]
DOC = "doc_id long, text string, lang string, source string, n_chars long, fp long, shard string, _t int"


def odd(spark, texts=ODD):
    """Null ids, ties, repeated rows and columns with clashing names."""
    rows = [(None if i == 3 else i, t, None if i % 2 else "en", "s", 0, 1, "x", 2) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[6:7], DOC)


def empty(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_piece_ids_are_the_library_s(path, texts):
    t = PieceTokenizer(path)
    more = ["don't I'm 'S it's", "Σας ΟΔΟΣ Σ.", "İstanbul ŞİŞLİ", "été́ a", "\x1c a \x1f", "ſ K ǅ", "ﬁ ß ẞ", "a\n b", "a \nb", "日 語。 ok", "1234 12.5, (a) b?!"]
    for x in [*(o or "" for o in ODD), *more, *list(texts.values())[:60]]:
        assert t.ids(x) == t.encode_whole(x), x[:50]


def test_rans_blocks_round_trip():
    rng = np.random.default_rng(1)
    ids = (rng.zipf(1.3, 40_000) % 50_000).astype(np.uint32)
    u, c = np.unique(ids, return_counts=True)
    table = rans.Table(*rans.scaled(u, c))
    assert table.freq.sum() == 1 << rans.BITS
    for n in (1, 5, 17, 40_000):
        payload = rans.encode(ids[:n], table, lanes=64, every=16)
        assert (rans.decode(payload, table) == ids[:n]).all()
    parts = -(-(-(-40_000 // 64)) // 16)
    assert (np.concatenate([rans.decode(payload, table, k) for k in range(parts)]) == ids).all()
    broken = bytearray(payload)
    broken[-3] ^= 1
    with pytest.raises(ValueError):
        rans.decode(bytes(broken), table)


def test_op2_against_brute_force(spark, sf, texts):
    from tokenizers import Tokenizer

    t, start = Tokenizer.from_file(BYTES), 0
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in q.op2_rans_tokens(spark, sf).collect()}
    for d in sorted(texts):
        ids = [*t.encode(texts[d], add_special_tokens=False).ids, 0]
        assert got[d] == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)


def test_op2_odd_inputs(spark):
    out = rans.read(spark, rans.write(odd(spark), BYTES)).orderBy("start").collect()
    assert len(out) == len(ODD) + 1 and out[0].doc_id is None and out[0].start == 0
    assert all(b.start == a.start + a.n_tokens for a, b in zip(out, out[1:]))
    assert rans.read(spark, rans.write(empty(spark), BYTES)).count() == 0


def test_op2_large_blocks_decode_in_parts(spark, docs):
    """Blocks above a size, one of a very long document among them, are decoded in parts and give the same documents."""
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()[:40]] + [(-1, "a very long text of words " * 20_000)]
    path = rans.write(spark.createDataFrame(rows, "doc_id long, text string"), BYTES, shards=2, lanes=64, every=8)
    whole = {r.doc_id: r for r in rans.read(spark, path).collect()}
    parts = rans.read(spark, path, part_ids=3000)
    assert {r.doc_id: r for r in parts.collect()} == whole and len(whole) == 41
    n = spark.read.parquet(f"{path}/blocks").agg({"n_ids": "sum"}).first()[0]
    assert n == sum(r.n_tokens for r in whole.values())


def test_op2_is_read_by_another_process(spark, docs, tmp_path):
    """The folder is all that a reader needs."""
    import subprocess
    import sys

    path = rans.write(docs.limit(30), BYTES, path=str(tmp_path / "written"))
    code = (
        "import sys, json; from pyspark.sql import SparkSession; from sieveline.llm import rans\n"
        "spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "print('READ', json.dumps(sorted([r.doc_id, r.start, len(r.ids)] for r in rans.read(spark, sys.argv[1]).collect())))"
    )
    done = subprocess.run([sys.executable, "-c", code, path], capture_output=True, text=True, timeout=300)
    want = sorted([r.doc_id, r.start, len(r.ids)] for r in rans.read(spark, path).collect())
    assert f"READ {__import__('json').dumps(want)}" in done.stdout, done.stderr[-2000:]


def test_differencing_packs_everything_once():
    rng = random.Random(2)
    for n in (0, 1, 7, 200):
        sizes = [rng.randint(1, 2047) for _ in range(n)]
        packed = kk_pack.pack_group(sizes, 2048)
        assert sorted(i for w in packed for i in w) == list(range(n))
        assert all(sum(sizes[i] for i in w) <= 2048 for w in packed)
    sizes = [100] * 40
    sums = [sum(sizes[i] for i in w) for w in kk_pack.pack_group(sizes, 2048)]
    assert max(sums) - min(sums) <= 100


def test_op7_against_brute_force(spark, sf, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    pieces, windows = collections.defaultdict(list), collections.defaultdict(list)
    for r in q.op7_differencing_pack(spark, sf).collect():
        pieces[r.doc_id].append(r)
        windows[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(texts)
    for d, own in pieces.items():
        ids, at = [*t.encode(texts[d], add_special_tokens=False).ids, 1], 0
        for r in sorted(own, key=lambda r: r.start):
            part = ids[r.start : r.start + r.length]
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
            at += r.length
        assert at == len(ids)
    for w in windows.values():
        at = 0
        for offset, length in sorted(w):
            assert offset == at
            at += length
        assert at <= 2048
    assert kk_pack.padding(np.array([sum(x for _, x in w) for w in windows.values()])) < 0.08


def test_op7_odd_inputs(spark):
    assert kk_pack.pack(odd(spark), WORDS).select("doc_id").count() >= len(ODD) + 1
    assert kk_pack.pack(empty(spark), WORDS).count() == 0


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def parts(fps, limit=3):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(fps):
        for j in range(i):
            if bin(a ^ fps[j]).count("1") <= limit:
                a_, b_ = find(i), find(j)
                parent[max(a_, b_)] = min(a_, b_)
    return [find(i) for i in range(len(fps))]


def test_fingerprints(texts):
    for x in [*ODD, *list(texts.values())[:40], "A b", "É È x Y"]:
        assert simhash_gray.fingerprint(x) == slow_fingerprint(x)


@pytest.mark.parametrize("dense", [0, 150])
def test_gray_index_finds_all_links(dense):
    rng = random.Random(dense)
    fps = {rng.getrandbits(64) for _ in range(400)}
    for base in list(fps)[:4] if dense else []:
        for _ in range(dense):
            x = base
            for _ in range(rng.randint(1, 4)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = np.array(sorted(fps, key=lambda _: rng.random()), np.uint64)
    want = parts([int(x) for x in fps])
    half = len(fps) // 2
    for own, guests in ((fps, fps[:0]), (fps[:half], fps[half:])):
        forest = simhash_gray.Forest(len(fps))
        forest.add(*simhash_gray.link(own, guests))
        if len(guests):
            x, y = simhash_gray.link(guests, fps[:0])
            forest.add(x + half, y + half)
        got = forest.roots()
        assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


@pytest.mark.parametrize("lead_bits", [0, 4])
def test_op3_against_brute_force(spark, docs, texts, lead_bits):
    ids = sorted(texts)
    fps = [slow_fingerprint(texts[d]) for d in ids]
    want = dict(zip(ids, (ids[i] for i in parts(fps))))
    got = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in simhash_gray.near_duplicates(docs, lead_bits=lead_bits).collect()}
    assert got == {d: (f, want[d]) for d, f in zip(ids, fps)}


def test_op3_odd_inputs(spark):
    out = simhash_gray.near_duplicates(odd(spark)).collect()
    assert len(out) == len(ODD) + 1
    assert {r.component_id for r in out if r.doc_id in (0, 1, 2)} == {0}
    assert simhash_gray.near_duplicates(empty(spark)).count() == 0


def test_components_of_a_long_chain(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    assert {r.node: r.root for r in simhash_gray.components(df).collect()} == {**{i: 0 for i in range(1, 61)}, 101: 100}


def slow_base(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed


def slow_verdicts(rows):
    """Distances and verdicts of ``{id: (text, lang)}`` in plain Python."""

    def chars(t):
        rest, out = re.sub(r"[\x20\x09-\x0D]+", "", t or ""), []
        for name in divergence.CLASSES:
            keep = {"lower": lambda c: "a" <= c <= "z", "upper": lambda c: "A" <= c <= "Z", "letter": str.isalpha, "digit": str.isnumeric, "mark": lambda c: c in ".,;:!?'\"()-"}[name]
            out.append(sum(map(keep, rest)))
            rest = "".join(c for c in rest if not keep(c))
        return [*out, len(rest)]

    def words(t, lang):
        low = [w.lower() for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        own = [low.count(w) for w in divergence.COMMON_WORDS[lang]]
        return [*own, len(low) - sum(own)]

    def distance(a, b):
        p, r = [x / sum(a) for x in a], [x / sum(b) for x in b]
        kl = lambda x, m: sum(v * math.log2(v / w) for v, w in zip(x, m) if v)
        m = [(x + y) / 2 for x, y in zip(p, r)]
        return math.sqrt(max(0.0, (kl(p, m) + kl(r, m)) / 2))

    base = {d: slow_base(t) for d, (t, _) in rows.items()}
    langs = [x for x in divergence.COMMON_WORDS if any(g == x and not base[d][5] for d, (_, g) in rows.items())]
    refs = {g: [[sum(c) for c in zip(*(f(t) for d, (t, k) in rows.items() if k == g and not base[d][5]))] for f in (chars, lambda t, g=g: words(t, g))] for g in langs}
    out = {}
    for d, (t, g) in rows.items():
        n_words, n_chars = base[d][0], base[d][1]
        near = any(distance(chars(t), refs[k][0]) <= 0.165 + 2.2 / math.sqrt(n_chars) and distance(words(t, k), refs[k][1]) <= 0.17 + 1.1 / math.sqrt(n_words) for k in langs) if n_words else False
        out[d] = not base[d][5] and (not langs or (g is not None and g not in langs) or n_chars < divergence.MIN_CHARS or near)
    return out


def test_op4_against_brute_force(spark, sf, docs):
    rows = {r.doc_id: (r.text, r.lang) for r in docs.collect()}
    want = slow_verdicts(rows)
    for r in q.op4_distribution_divergence(spark, sf).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == slow_base(rows[r.doc_id][0])
        assert r.kept == want[r.doc_id]


def test_op4_odd_inputs(spark):
    spam = ["a b c " * 400, " ".join(f"w{i}" for i in range(300)) + " x y z x y z", "l1\nl1\n \nl1 \n"]
    out = {(r.doc_id, r.n_words): r for r in divergence.assess(odd(spark, ODD + spam)).collect()}
    for i, t in enumerate(ODD + spam):
        want = slow_base(t)
        r = out[None if i == 3 else i, want[0]]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want
    assert divergence.assess(empty(spark)).count() == 0


def test_op4_runs_no_python(spark, sf):
    plan = q.op4_distribution_divergence(spark, sf)._jdf.queryExecution().toString() + q.op5_hypergeometric_shards(spark, sf)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_hypergeometric_margins_and_law():
    rng = random.Random(3)
    m = hypershuffle.matrix([5, 0, 7, 100], [38, 37, 37], 1)
    assert [sum(r) for r in m] == [5, 0, 7, 100] and [sum(c) for c in zip(*m)] == [38, 37, 37]
    draws = collections.Counter(hypershuffle.hypergeometric(rng, 6, 9, 5) for _ in range(20_000))
    for k in range(6):
        assert abs(draws[k] / 20_000 - math.comb(6, k) * math.comb(9, 5 - k) / math.comb(15, 5)) < 0.015
    big = hypershuffle.hypergeometric(rng, 10**11, 10**11, 10**11)
    assert abs(big - 5 * 10**10) < 10**7
    for good, bad, drawn in ((6, 9, 5), (40, 3, 20), (1, 10**6, 500), (10**4, 10**5, 300), (25, 25, 25)):
        for k in range(max(0, drawn - bad), min(good, drawn) + 1):
            exact = math.comb(good, k) * math.comb(bad, drawn - k) / math.comb(good + bad, drawn)
            assert abs(hypershuffle.probability(k, good, bad, drawn) - exact) <= 1e-11 * exact + 1e-300
    n, d, g = 8 * 10**11, 10**8, 10**11  # the mode's probability there against the normal limit
    spread = math.sqrt(d * (g / n) * (1 - g / n) * (n - d) / (n - 1))
    assert abs(hypershuffle.probability(d // 8, g, n - g, d) * spread * math.sqrt(2 * math.pi) - 1) < 1e-7


def test_op5_shuffle_is_uniform(spark):
    """Over many seeds, each row falls into each shard and slot equally often (chi-square)."""
    df = spark.range(12).selectExpr("id AS doc_id").repartition(3)
    counts, n = collections.Counter(), 60
    for seed in range(n):
        for r in hypershuffle.shuffle_into_shards(df, 3, seed=seed).collect():
            counts[r.doc_id, r.shard * 4 + r.slot] += 1
    chi = sum((counts[i, j] - n / 12) ** 2 / (n / 12) for i in range(12) for j in range(12))
    assert 60 < chi < 190  # 121 degrees of freedom: mean 121, deviation 15.6


def test_op5_sizes_slots_and_chance(spark, sf, texts):
    rows = q.op5_hypergeometric_shards(spark, sf).collect()
    assert len(rows) == len(texts) and {r.law for r in rows} == {"rows"}
    by = collections.defaultdict(list)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), None)
        by[r.shard].append(r.slot)
    assert set(by) == set(range(8)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1


def test_op5_buckets_and_odd_inputs(spark, monkeypatch):
    monkeypatch.setattr(hypershuffle, "BUCKET_ROWS", 3)
    out = hypershuffle.shuffle_into_shards(odd(spark).select("doc_id", "text"), 4, seed=1).collect()
    by = collections.defaultdict(list)
    for r in out:
        by[r.shard].append(r.slot)
    assert len(out) == len(ODD) + 1 and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert hypershuffle.shuffle_into_shards(empty(spark), 4).count() == 0


def test_op5_whole_rows_are_exchanged_once(spark, sf):
    """On disk are rows as staged, as exchanged once and as shards; a source partition is permuted without an exchange."""
    out = hypershuffle.shuffle_into_shards(spark.read.parquet(f"{sf}/documents.parquet"), 8, seed=5)
    formatted = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = out._jdf.queryExecution().explainString(formatted)
    sent = re.findall(r"Exchange *\nInput \[\d+\]: \[([^\]]*)\]", plan)
    assert len([columns for columns in sent if re.search(r"\brow#", columns)]) == 1


def test_op6_extracts_articles(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in q.op6_scored_html_region(spark, sf).collect():
        inner = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]+>", lambda m: "" if m[0] in ("<b>", "</b>") else " ", inner)).split())
        assert r.text == want and r.n_chars == len(want)


def test_op6_other_layouts():
    w = html_region.default_weights()
    body = "<p>" + "plain words of a story that goes on. " * 6 + "</p>"
    want = " ".join(("plain words of a story that goes on. " * 6).split())
    get = lambda page: html_region.extract(page, w)
    assert get(f"<body><ul class='menu'><li><a href=x>Home</a></ul><div id=content>{body}</div><div class='sidebar widget'>{body}</div></body>") == want
    assert get(f"<main><h1>T</h1>{body}<div class='ad'>buy</div><form>mail <input></form><aside>x</aside>{body}<section class=comments><p>hi</p></section></main>") == f"T {want} {want}"
    assert get(f"<article><script>var a='</p><p>no';</script><!-- <p>no</p> -->{body}<p hidden>no</p><style>p{{}}</style></article>") == want
    assert get(f"<div class=ad>unclosed<article>{body}") == want
    assert get("") == get(None) == get("<nav>only a menu</nav>") == ""
    assert get(f"<article><p>a&nbsp;&lt;b&gt; x<br>y</p>{body}</article>") == f"a <b> x y {want}"
    assert get(f"<article><p title='a > b'>x</p>{body}</article>") == f"x {want}"


def test_op6_odd_inputs(spark):
    df = spark.createDataFrame([(1, None, None), (None, "u", "<p>x"), (1, None, None)], "page_id long, url string, html string")
    assert [r.text for r in html_region.extract_main_text(df, html_region.default_weights()).collect()].count("") >= 2
    assert html_region.labelled_sample(df.limit(0), "page_id") == []


def test_op8_kth_largest(spark):
    rng = random.Random(4)
    values = [rng.choice([1.5, rng.gauss(0, 1), 1e-300, -3.0]) for _ in range(500)]
    df = spark.createDataFrame([(x,) for x in values], "s double")
    for k in (1, 7, 250, 500):
        assert importance.kth_largest(df, "s", k) == sorted(values, reverse=True)[k - 1]


def test_op8_weights_are_sums_of_log_ratios(spark, docs, texts):
    ids = sorted(texts)[:40]
    target, raw = importance.models(docs.select("doc_id", "text"), ids)
    want_t, want_r = np.zeros(importance.BUCKETS), np.zeros(importance.BUCKETS)
    for d, t in texts.items():
        for b in importance.ngrams(t):
            want_r[b] += 1
            want_t[b] += d in ids
    assert (target == want_t).all() and (raw == want_r).all()
    ratios = importance.log_ratios(target, raw)
    for r in importance.weights(docs, ratios, []).collect():
        assert abs(r.weight - ratios[g := importance.ngrams(texts[r.doc_id])].sum() / max(1, len(g)) ** 0.5) < 1e-9


def test_op8_selection_is_gumbel_top_k(spark, sf):
    """The kept rows are the k with the largest weight plus noise, k by what unseen target documents weigh."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = importance.resample(docs, labels).collect()
    drawn = importance.target_ids(docs, labels)
    unseen = sorted((r.weight for r in rows if r.doc_id in set(drawn[1::2])), reverse=True)
    usual = unseen[math.ceil((1 - importance.SPARE) * len(unseen)) - 1]
    k = sum(r.weight >= usual for r in rows)
    least = sorted((r.score for r in rows), reverse=True)[k - 1]
    assert {r.doc_id for r in rows if r.kept} == {r.doc_id for r in rows if r.score >= least}
    noise = np.array([r.score - r.weight / importance.TEMPERATURE for r in rows])
    assert abs(noise.mean() - 0.5772) < 0.35 and abs(noise.std() - math.pi / 6**0.5) < 0.35


def test_op8_keeps_good_documents(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r.doc_id: r.kept for r in q.op8_importance_resampling(spark, sf).collect()}
    good = [kept[d] for d, (a, b) in labels.items() if a == 1 and b == 0]
    poor = [kept[d] for d, (a, _) in labels.items() if a == 0]
    assert sum(good) >= 0.98 * len(good) and sum(poor) <= 0.2 * len(poor)


def test_op8_odd_inputs(spark):
    labels = spark.createDataFrame([(0, 1, 0), (5, 1, None), (8, 0, 0), (None, 1, 0), (6, None, None)], "doc_id long, quality int, toxic int")
    assert importance.resample(odd(spark), labels).count() == len(ODD) + 1
    assert importance.resample(odd(spark), labels.limit(0)).where("kept").count() == len(ODD) + 1
    assert importance.resample(empty(spark), labels).count() == 0


def test_op9_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = q.op9_nearest_centroid(spark, sf).collect()
    held = [r for r in out if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in out)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)


def test_op9_odd_inputs(spark):
    out = {r.doc_id: r.lang_pred for r in centroids.identify(odd(spark)).collect()}
    assert out[0] == out[1] == out[2] == "und" and out[5] == "en"
    assert centroids.identify(empty(spark)).count() == 0


def test_op10_against_whole_encoding(texts):
    encoder, rng = PieceTokenizer(BYTES), random.Random(5)
    for text in [*(o or "" for o in ODD), *list(texts.values())[:40]]:
        tree = edit_counts.Tree.build(text, encoder, 40)
        assert tree.total() == len(encoder.encode_whole(text)) // 4
        cuts = sorted(rng.randrange(len(text) + 1) for _ in range(2 * rng.randrange(1, 5)))
        edits = [(a, b, rng.choice(["", " ", "new words", "\n", "x\n\ny", "é"])) for a, b in zip(cuts[::2], cuts[1::2])]
        want, at = "", 0
        for a, b, new in edits:
            want += text[at:a] + new
            at = b
        want += text[at:]
        new, again = tree.update(text, edits, encoder)
        assert new == want and tree.total() == len(encoder.encode_whole(want)) // 4
        assert int(tree.chars[1]) == len(want)


def test_op10_reencodes_little(spark, sf, texts):
    encoder = PieceTokenizer(BYTES)
    for r in q.op10_edit_token_counts(spark, sf).collect():
        text = texts[r.doc_id] or ""
        assert r.n_before == len(encoder.encode_whole(text)) // 4
        for a, b, new in sorted(edit_counts.redactions(text), reverse=True):
            text = text[:a] + new + text[b:]
        assert r.n_tokens == len(encoder.encode_whole(text)) // 4
        assert r.reencoded_chars <= 1700 * r.n_edits and (r.n_edits > 0 or r.n_before == r.n_tokens)


def test_op10_redactions_take_linear_time():
    import time

    text = "a.b@example.com +1 (555) 123-4567 " * 40_000
    began = time.perf_counter()
    assert len(edit_counts.redactions(text)) == 80_000
    assert time.perf_counter() - began < 5


def test_op10_odd_inputs(spark):
    trees = edit_counts.build_trees(odd(spark), BYTES)
    assert edit_counts.update_trees(trees, BYTES, edit_counts.redactions).count() == len(ODD) + 1
    assert edit_counts.build_trees(empty(spark), BYTES).count() == 0


def test_op1_common_subsequence():
    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        return row[-1]

    rng = random.Random(6)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(1, 20))] for _ in range(2))
        assert decontaminate.common(a, b) == slow(a, b)


def test_op1_keys_are_words(texts):
    for x in [*ODD, "İ x", "«a» b…c d_e", "ñandú-É", *list(texts.values())[:50]]:
        assert [k.decode() for k in decontaminate.keys(x)] == decontaminate.words(x)


def leak_rows(spark, item, extra=()):
    rng = random.Random(7)
    filler = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    w = item.split()
    changed = [x if i % 6 else "zzz" for i, x in enumerate(w)]
    rows = [(1, filler(97) + " " + item + " " + filler(50)), (2, filler(300)), (3, filler(33) + " " + " ".join(changed) + " " + filler(20)), (4, item.upper().replace(" ", "\n")), *extra]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_op1_finds_copies_and_paraphrases(spark, sf):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    item = max((r for r in bench.collect()), key=lambda r: len(r.text))
    found = decontaminate.leaks(leak_rows(spark, item.text), bench)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(d, item.item_id) for d in (1, 3, 4)}
    blocks = decontaminate.leaks(leak_rows(spark, item.text), bench, pass_items=9, space_passages=5)
    assert {(r.doc_id, r.item_id) for r in blocks.collect()} == {(d, item.item_id) for d in (1, 3, 4)}


def test_op1_against_verbatim_search():
    from pyspark.sql import SparkSession

    spark, sf = SparkSession.getActiveSession(), "/root/testdata/sf0.01"
    norm = lambda t: " " + " ".join(decontaminate.words(t)) + " "
    docs = {r.doc_id: norm(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r.item_id: norm(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    want = {(d, i) for d, t in docs.items() for i, x in items.items() if x in t}
    assert {(r.doc_id, r.item_id) for r in q.op1_latent_decontamination(spark, sf).collect()} == want


def test_op1_odd_inputs(spark):
    bench = spark.createDataFrame([(1, None), (2, "too short"), (None, "one two three four five six seven eight"), (4, "")], "item_id long, text string")
    assert decontaminate.leaks(odd(spark), bench).count() == 0
    assert decontaminate.leaks(empty(spark), bench).count() == 0
    assert decontaminate.leaks(odd(spark), bench.limit(0)).count() == 0


def test_op9_against_brute_force(spark, docs, texts):
    """The model's document frequencies, and each prediction as the largest of all cosines; two fits agree."""
    training = docs.where(~centroids.held_out()).select(docs.doc_id.alias("key"), "text", "lang").where("lang is not null")
    model, again = centroids.fit(training), centroids.fit(training.repartition(3))
    assert model.langs == again.langs and np.allclose(model.centroids, again.centroids, atol=1e-6)
    own = [c for r in training.collect() if (c := centroids.counts(r.text, len(model.idf))) is not None]
    df = np.sum([c > 0 for c in own], axis=0)
    assert np.allclose(model.idf, np.log((1 + len(own)) / (1 + df)) + 1)
    assert np.allclose(np.linalg.norm(model.centroids, axis=1), 1)
    for r in centroids.predict(docs.withColumn("held_out", centroids.held_out()), model).collect():
        c = centroids.counts(texts[r.doc_id], len(model.idf))
        if c is None:
            assert r.lang_pred == "und"
            continue
        v = np.sqrt(c) * model.idf
        cosines = [float(v @ m / np.linalg.norm(v)) for m in model.centroids]
        assert r.lang_pred == model.langs[int(np.argmax(cosines))] and abs(r.score - max(0.0, min(1.0, max(cosines)))) < 1e-6
