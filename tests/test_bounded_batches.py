"""Python workers take files in slices of bounded size, however large an Arrow batch is."""

import pyarrow as pa
from pyspark.sql import functions as F

from sieveline.sources import chunking, extract


def test_slices_are_bounded_and_whole():
    texts = pa.array(["x" * n for n in (10, extract.SLICE_BYTES, 5, 0)] + [None, "y"] + ["z"] * 2500)
    found = list(extract.slices(texts))
    assert [a for a, _ in found] == [0, *[a + n for a, n in found][:-1]] and sum(n for _, n in found) == len(texts)
    for at, n in found:
        held = sum(len(t or "") for t in texts.slice(at, n).to_pylist())
        assert n == 1 or (held <= extract.SLICE_BYTES and n <= extract.SLICE_ROWS)
    assert list(extract.slices(pa.array([], pa.binary()))) == []


def test_batches_of_several_slices_come_back_whole(spark):
    text = F.concat(F.col("id").cast("string"), F.lit("\n"), F.repeat(F.lit("some words here\n"), 40))
    files = spark.range(3500).coalesce(1).select(F.concat(F.col("id").cast("string"), F.lit(".txt")).alias("path"), F.encode(text, "utf-8").alias("content"))
    got = extract.extracted(files)
    assert got.count() == 3500 and got.where("error <> ''").count() == 0
    assert got.where(F.col("text").startswith("17\nsome words here")).count() == 1
    chunks = chunking.explode_chunks(files.select("path", F.decode("content", "utf-8").alias("content")), 200, "prose")
    assert chunks.select("path").distinct().count() == 3500
    assert chunks.where("octet_length(content) > 200").count() == 0


def test_nulls_and_empty_files(spark):
    rows = spark.createDataFrame([("a.txt", None), ("b.zip", bytearray()), ("c.txt", bytearray(b"x"))], "path string, content binary")
    got = {r.path: (r.text, r.error) for r in extract.extracted(rows).collect()}
    assert got["a.txt"] == ("", "") and got["c.txt"] == ("x", "") and got["b.zip"][0] == "" and got["b.zip"][1]
