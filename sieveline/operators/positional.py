"""A positional inverted index with exact cover density and phrases (W5, text search).

``build`` keeps each term's places in a text (1-based, in order). ``write`` stores the index
partitioned by a hash of the term, so a query's scan reads its terms' partitions only.

A cover is a stretch that holds all query terms and no shorter stretch that does. They come
from one merge over the terms' place lists: going from place to place, a stretch ends here and
begins at the least of the terms' last places; it is a cover when that beginning is new. The
rank is the sum over covers of ``WEIGHT / (1 + noise)``, noise being the places inside that hold none
of the terms. A text without one of the terms has no cover and rank 0.

Lists are made of each row's words where the row is; rows meet only if a key has several. All else is built-in functions over arrays of places: a text's places of a few terms, never an index's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranking import tokens_of

#: Weight of a term; parts of a written index.
WEIGHT, PARTS = 0.1, 64
#: Words that a Python worker puts in order at a time.
SLICE_WORDS = 1 << 20


def build(chunks: DataFrame, *, text: str = "content", key: str = "id", terms: list[str] | None = None) -> DataFrame:
    """``term, key, places``; ``terms``: only these, picked before the words become rows."""
    t = chunks.select(F.col(key).alias("key"), tokens_of(F.col(text)).alias("_t"))
    words = F.transform("_t", lambda w, i: F.struct(w.alias("term"), (i + 1).alias("place")))
    if terms is not None:
        words = F.filter(words, lambda w: w["term"].isin(_terms(terms)))
        rows = t.select("key", F.explode(words).alias("w")).select("key", "w.*")
        return rows.groupBy("term", "key").agg(F.sort_array(F.collect_list("place")).alias("places"))
    lists = t.mapInArrow(_place_lists, f"term string, key {t.schema['key'].dataType.simpleString()}, places array<int>")
    if chunks.groupBy(F.col(key)).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return lists  # a text's words are all in its row, so nothing has to meet
    return lists.groupBy("term", "key").agg(F.sort_array(F.flatten(F.collect_list("places"))).alias("places"))


def _place_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``key, _t`` (words in order) -> ``term, key, places`` of each row, without an exchange; whole columns at a time."""
    for batch in batches:
        for start, n in _slices(batch.column(1)):
            part = batch.slice(start, n)
            lists = part.column(1)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            words = lists.flatten().dictionary_encode()
            if not len(words):
                continue
            row = np.repeat(np.arange(n), sizes)
            place = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
            code = words.indices.to_numpy()
            order = np.lexsort((place, code, row))
            row, code, place = row[order], code[order], place[order]
            at = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (code[1:] != code[:-1])))
            places = pa.ListArray.from_arrays(pa.array(np.append(at, len(row)), pa.int32()), pa.array(place, pa.int32()))
            terms = words.dictionary.take(pa.array(code[at]))
            yield pa.RecordBatch.from_arrays([terms.cast(pa.string()), part.column(0).take(pa.array(row[at])), places], names=["term", "key", "places"])


def _slices(lists: pa.Array) -> Iterator[tuple[int, int]]:
    """``start, rows`` of runs of about ``SLICE_WORDS`` words, or of one larger text."""
    start = held = 0
    for at, size in enumerate(pc.fill_null(pc.list_value_length(lists), 0).to_pylist()):
        if at > start and held + size > SLICE_WORDS:
            yield start, at - start
            start, held = at, 0
        held += size
    if start < len(lists):
        yield start, len(lists) - start


def _terms(terms: list[str]) -> list[str]:
    return sorted({t.lower() for t in terms})


def _part(term: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(parts)).cast("int")


def write(index: DataFrame, path: str, parts: int = PARTS) -> None:
    """The index as ``path/part=…``, sorted by term within files. A frequent term spreads over files by key."""
    placed = index.withColumn("part", _part(F.col("term"), parts))
    tasks = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed.repartition(max(parts, tasks), "part", F.pmod(F.xxhash64("key"), F.lit(max(4, tasks // parts)))).sortWithinPartitions("part", "term", "key").write.mode("overwrite").partitionBy("part").parquet(path)


def read(spark: SparkSession, path: str, terms: list[str], parts: int = PARTS) -> DataFrame:
    """The written index's rows of these terms; the scan is pruned to their partitions."""
    wanted = _terms(terms)
    numbers = [r.p for r in spark.createDataFrame([(t,) for t in wanted], "t string").select(_part(F.col("t"), parts).alias("p")).distinct().collect()]
    return spark.read.parquet(path).where(F.col("part").isin(numbers) & F.col("term").isin(wanted)).drop("part")


def with_all_terms(index: DataFrame, terms: list[str]) -> DataFrame:
    """``key, lists``: for texts that hold every term, the terms' place lists in the terms' order."""
    wanted = _terms(terms)
    hit = index.where(F.col("term").isin(wanted))
    held = hit.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("term", "places"))).alias("_h")).where(F.size("_h") == len(wanted))
    return held.select("key", F.transform("_h", lambda h: h["places"]).alias("lists"))


def merged(lists: Column) -> Column:
    """The lists' places in order, each with the number of its list."""
    return F.sort_array(F.flatten(F.transform(lists, lambda places, i: F.transform(places, lambda p: F.struct(p.cast("int").alias("place"), i.cast("int").alias("term"))))))


def covers(index: DataFrame, terms: list[str]) -> DataFrame:
    """``key, start, end, noise``: every cover as a row."""
    n = len(_terms(terms))
    walked = with_all_terms(index, terms).select("key", _walk(F.col("lists"), n, keep=True).alias("w"))
    return walked.select("key", F.explode("w.covers").alias("c")).select("key", "c.start", "c.end", "c.noise")


def cover_rank(index: DataFrame, terms: list[str], k: int | None = None) -> DataFrame:
    """``key, covers, shortest, rank``; ties by key."""
    n = len(_terms(terms))
    walked = with_all_terms(index, terms).select("key", _walk(F.col("lists"), n, keep=False).alias("w"))
    out = walked.select("key", F.col("w.n").alias("covers"), F.col("w.shortest").alias("shortest"), F.round("w.rank", 9).alias("rank"))
    return out if k is None else out.orderBy(F.col("rank").desc(), "key").limit(k)


def _walk(lists: Column, n: int, keep: bool) -> Column:
    return _walked(merged(lists), n, keep)


def _walked(spots: Column, n: int, keep: bool) -> Column:
    """The merge, over places in order: state is each term's last place and its number in the merged list, and what covers have added up to."""
    spot = "struct<place:int,at:int>"
    cover = "array<struct<start:int,end:int,noise:int>>"
    none = F.array(*[F.struct(F.lit(0).alias("place"), F.lit(0).alias("at")).cast(spot) for _ in range(n)])
    start = F.struct(none.alias("last"), F.lit(0).alias("at"), F.lit(0).alias("begin"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("shortest"), F.lit(0.0).alias("rank"), F.array().cast(cover).alias("covers"))

    def step(s: Column, x: Column) -> Column:
        at = s["at"] + 1
        last = F.transform(s["last"], lambda spot_, i: F.when(i == x["term"], F.struct(x["place"].alias("place"), at.alias("at")).cast(spot)).otherwise(spot_))
        first = F.array_min(last)  # by place
        new = first["place"] > s["begin"]
        noise = (x["place"] - first["place"]) - (at - first["at"])
        length = x["place"] - first["place"] + 1
        own = F.array(F.struct(first["place"].alias("start"), x["place"].alias("end"), noise.alias("noise"))).cast(cover)
        return F.struct(
            last.alias("last"), at.alias("at"), F.when(new, first["place"]).otherwise(s["begin"]).alias("begin"), (s["n"] + new.cast("int")).alias("n"),
            F.when(new, F.least(s["shortest"], length)).otherwise(s["shortest"]).alias("shortest"),
            (s["rank"] + F.when(new, F.lit(WEIGHT) / (1 + noise)).otherwise(0.0)).alias("rank"),
            (F.when(new, F.concat(s["covers"], own)).otherwise(s["covers"]) if keep else s["covers"]).alias("covers"),
        )

    return F.aggregate(spots, start, step)


def cover_density(text: Column, terms: list[str]) -> Column:
    """The rank of one text without an index: 0 unless every term is there."""
    wanted = _terms(terms)
    tokens = tokens_of(text)
    spots = F.filter(F.transform(tokens, lambda w, i: F.struct((i + 1).cast("int").alias("place"), (F.array_position(F.array(*map(F.lit, wanted)), w) - 1).cast("int").alias("term"))), lambda x: x["term"] >= 0)
    return _walked(spots, len(wanted), False)["rank"] if wanted else F.lit(0.0)


def keyword_rank(chunks: DataFrame, words: list[str], k: int, *, text: str = "content", key: str = "id") -> DataFrame:
    """W5 whole: ``key, score``: how many words a text holds in any case, and its cover density over all of them; ties by key."""
    if not words:
        return chunks.select(key, F.lit(0.0).alias("score")).limit(0)
    held = sum((F.col(text).ilike(f"%{w}%").cast("double") for w in words), F.lit(0.0))
    scored = chunks.select(key, held.alias("_held"), text).where("_held > 0")  # the others are never split into words
    ranked = scored.select(key, F.round(F.col("_held") + F.when(F.col("_held") == len(words), cover_density(F.col(text), words)).otherwise(0.0), 6).alias("score"))
    return ranked.orderBy(F.col("score").desc(), key).limit(k)


def phrase(index: DataFrame, words: list[str]) -> DataFrame:
    """``key, places``: where the words stand one after another (a word may occur twice in the phrase)."""
    low = [w.lower() for w in words]
    order = {t: i for i, t in enumerate(_terms(low))}
    held = with_all_terms(index, low)

    def shifted(word: str, by: int) -> Column:
        return F.transform(F.get("lists", F.lit(order[word])), lambda p: p - F.lit(by))

    both = shifted(low[0], 0)
    for i, word in enumerate(low[1:], 1):
        both = F.array_intersect(both, shifted(word, i))
    return held.select("key", F.sort_array(both).alias("places")).where(F.size("places") > 0)
