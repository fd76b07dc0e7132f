"""Symbols on lines (J11, J12, C7, C8): many rows on few lines, and every kind of row against brute force."""

import random
import time

import pytest
from pyspark.sql import functions as F

from sieveline.operators import codeintel, joins
from sieveline.plans import registry

SYMBOLS = "path string, at int, name string, kind string, start_line int, end_line int"
CHUNKS = "id int, path string, content string, start_line int, end_line int"


@pytest.fixture(scope="module")
def one_brand(spark, tmp_path_factory):
    """Forty thousand parts of one brand, so that all are symbols and chunks of one file."""
    folder = str(tmp_path_factory.mktemp("parts"))
    p = F.col("id")
    parts = spark.range(40_000).select(p.alias("p_partkey"), F.concat(F.lit("name "), (p % 64).cast("string")).alias("p_name"), F.lit("b").alias("p_brand"), F.lit("t").alias("p_type"), (p % 50 + 1).cast("int").alias("p_size"))
    parts.write.parquet(f"{folder}/part.parquet")
    return folder


def test_inputs_dont_hold_a_files_symbols(spark, one_brand):
    """F1: 1.6 billion pairs of chunk and symbol before."""
    since = time.time()
    got = {r.p_partkey: r.h for r in registry.QUERIES["C7_chunk_inputs"](spark, one_brand).collect()}
    assert time.time() - since < 60
    sizes = lambda k: k % 50 + 1
    for k in (0, 1, 25, 49, 39_999):
        here = [i for i in range(400) if sizes(i) <= sizes(k) + 4 and sizes(i) + 3 >= sizes(k) + 1]
        text = "Symbols: " + ", ".join(f"t name {i % 64}" for i in here[:20]) + f"...\nname {k % 64}"
        assert got[k] == spark.sql("SELECT sha2(:x, 256) AS h", {"x": text}).first().h
    assert len(got) == 40_000


def test_classes_dont_hold_a_files_symbols(spark, one_brand):
    """F2."""
    since = time.time()
    got = {r.p_partkey: (r.confidence, r.symbol) for r in registry.QUERIES["C8_classify_chunks"](spark, one_brand).collect()}
    assert time.time() - since < 60
    assert got[0] == ("EXTRACTED", "name 1") and got[49] == ("INFERRED", "name 47") and len(got) == 40_000


def test_rows_meet_only_where_lines_overlap(spark):
    """before, both sides' rows met by the bucket: ten billion pairs, none of which overlaps."""
    rows = spark.range(100_000)
    c = rows.select(F.col("id").alias("chunk"), F.lit("a").alias("path"), F.lit(1).alias("start_line"), F.lit(2).alias("end_line"))
    s = rows.select(F.col("id").alias("sym"), F.lit("a").alias("path"), F.lit(10).alias("start_line"), F.lit(11).alias("end_line"))
    since = time.time()
    assert joins.interval_overlap(c, s).count() == 0
    assert time.time() - since < 30


def test_symbols_on_equal_lines_meet_places_once(spark):
    """before, each of a thousand places met each of two hundred thousand symbols."""
    places = spark.range(1000).select(F.lit("a").alias("path"), F.col("id").cast("int").alias("line"))
    symbols = spark.range(200_000).select(F.lit("a").alias("path"), F.format_string("s%06d", "id").alias("name"), (F.col("id") % 10 * 50).cast("int").alias("start_line"), (F.col("id") % 10 * 50 + 9).cast("int").alias("end_line"))
    since = time.time()
    got = {r.line: r["name"] for r in codeintel.symbol_at(places, symbols).collect()}
    assert time.time() - since < 30
    assert got == {line: f"s{min(line // 50, 9):06d}" for line in range(1000)}


def _made(seed):
    r = random.Random(seed)
    name = lambda: r.choice(["", None, "ab", "b", "abc", "zz", "q"])
    line = lambda: r.randint(1, 200)
    symbols = []
    for at in range(300):
        a = line()
        symbols.append((r.choice("xyz"), at // 2, name(), r.choice(["f", "c"]), a, a + r.choice([0, 3, 90, -5])))
    chunks = []
    for i in range(200):
        a = line()
        chunks.append((i, r.choice(["x", "y", "z", "none", None]), r.choice(["abc", "", None, "xqx"]), r.choice([a, None]), a + r.randint(0, 80)))
    # a file whose symbols lie behind all chunks: only mentions are left
    symbols += [("m", 1, "zz", "f", 900, 910), ("m", 2, "q", "f", 900, 901), ("m", 3, "b", "f", 900, 901)]
    return symbols, chunks + [(1000, "m", "xqbx", 1, 2), (1001, "m", "nothing", 1, 2)]


@pytest.mark.parametrize("seed", [1, 2])
def test_inputs_and_classes_against_brute_force(spark, seed):
    from sieveline.sources import chunking

    symbols, chunks = _made(seed)
    order = lambda s: (s[1], s[2] is not None, s[2] or "", s[3], s[4], s[5])
    inputs, classes = {}, {}
    for i, path, content, a, b in chunks:
        own = sorted((s for s in symbols if s[0] == path), key=order)
        over = [s for s in own if a is not None and s[4] <= b and s[5] >= a]
        names = ", ".join(" ".join(x for x in (s[3], s[2]) if x is not None) for s in over[:20])
        inputs[i] = content if not over else None if content is None else f"Symbols: {names}{'...' if len(over) > 20 else ''}\n{content}"
        named = [s for s in own if s[2]]
        declared = next((s[2] for s in named if a is not None and a <= s[4] <= b), None)
        lies = next((s[2] for s in over if s[2]), None)
        said = next((s[2] for s in named if content is not None and s[2] in content), None)
        classes[i] = ("EXTRACTED", declared) if declared else ("INFERRED", lies or said) if lies or said else ("AMBIGUOUS", "")
    c, s = spark.createDataFrame(chunks, CHUNKS), spark.createDataFrame(symbols, SYMBOLS)
    assert {r.id: r.input for r in chunking.listed_inputs(c, s).collect()} == inputs
    assert {r.id: (r.confidence, r.symbol) for r in chunking.classify_chunks(c, s).collect()} == classes
    assert {k for k, _ in classes.values()} == {"EXTRACTED", "INFERRED", "AMBIGUOUS"}
