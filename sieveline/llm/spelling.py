"""Spelling variants: words one inserted, deleted or replaced letter apart, by rolling-hash deletion keys.

A word's prefix and suffix polynomial hashes give the hash of the word without its
letter ``i`` as one integer, for all words of a length and all ``i`` at once in NumPy.
Every word goes out under each of these keys and, whole, under its own hash. Keys are
radix-partitioned over tasks and sorted there (Spark's sort of a single long is a
radix sort). Where keys are equal,

- words of one length with the same letter left out differ in that letter alone;
- a whole word equal to another one without a letter differs by that letter;

and both are verified on the strings. Each near pair meets under exactly one key: a
replaced letter has one place, and of a run of equal letters only the first is left
out for the second kind. A place has at most as many different letters as the
alphabet, so no key is hot, however often its words occur; occurrences are counted
first, in tasks, and only counts of words move.

A word's form is its near word of largest count (ties: smallest in code-point order)
if that is at least ``factor`` times its own; roots follow forms to the last by pointer
doubling. Counts grow with each step, so there are no rings.

Nulls: a null text has no words; a null id counts as an empty string in the draw of
deletions. Texts are read whole. Repeated rows count again. An empty table gives no
rows. Extra columns are left behind. Of a word over ``LONG`` code points only hashes
travel with its keys, so its rows grow with its length, not with the square.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, only, ship, shuffle_partitions

LEAST_LENGTH, LEAST_COUNT, FACTOR = 7, 2, 10
#: One occurrence's letter in so many (document, run) pairs is left out; entries of a task's counter.
DROP, HELD = 31, 400_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Longer words send a reference with their keys in place of the string.
LONG = 200


def _letter(codes: np.ndarray) -> np.ndarray:
    """A 64-bit number for each code point."""
    h = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def keys(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For words of one length ``L``: hashes without letter i (``n x L``) and of the whole words (``n``)."""
    size = len(words[0])
    codes = _letter(np.array(words, f"<U{size}").view(np.uint32).reshape(len(words), size))
    power = np.cumprod(np.append(np.uint64(1), np.full(size, _BASE)), dtype=np.uint64)  # modulo 2**64, as all of this
    prefix, suffix = np.zeros((len(words), size + 1), np.uint64), np.zeros((len(words), size + 1), np.uint64)
    for i in range(size):
        prefix[:, i + 1] = prefix[:, i] * _BASE + codes[:, i]
        j = size - 1 - i
        suffix[:, j] = suffix[:, j + 1] + codes[:, j] * power[i]
    return prefix[:, :size] * power[size - 1 :: -1][:size] + suffix[:, 1:], prefix[:, size]


def counted(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LENGTH, drop: int = DROP) -> DataFrame:
    """``word, n``: occurrences of runs of letters of at least ``least`` code points, after the drawn deletions."""
    ship(docs.sparkSession)
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])
    runs = re.compile("[a-zÀ-ÿ]{%d,}" % least)  # only maximal runs match: a shorter one has no such stretch

    def flush(held):
        return pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.string()), pa.array(list(held.values()), pa.int64())], schema=schema)

    def run(batches):
        held: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                text, doc_id = text.as_py(), doc_id.as_py()
                if not text:
                    continue
                start = zlib.crc32(b"%s:" % (b"" if doc_id is None else str(doc_id).encode()))
                for word, n in Counter(runs.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))).items():
                    h = zlib.crc32(word.encode(), start)
                    if h % drop == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least:
                            continue
                    held[word] += n
                if len(held) >= HELD:
                    yield flush(held)
                    held.clear()
        if held:
            yield flush(held)

    slim = only(docs, doc_id=id_col, text=text_col)
    return slim.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def near(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """``word, n`` -> ``word, n_near, form, form_n`` of the words that have near ones."""
    met = met_by_key(words.where(F.char_length("word") <= LONG), factor)
    if not words.where(F.char_length("word") > LONG).isEmpty():
        met = met.unionByName(met_of_long(words.where(F.char_length("word") >= LONG), factor))
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("m"), F.col("form").alias("f"))))  # nulls don't count
    return met.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", F.col("b.f").alias("form"), (-F.col("b.m")).alias("form_n"))


def met_by_key(words: DataFrame, factor: int) -> DataFrame:
    """``word, n_near, form_n, form``: what each word sees under each of its keys; the strings travel with the keys."""
    spark = words.sparkSession
    ship(spark)
    keyed = pa.schema([("key", pa.int64()), ("place", pa.int16()), ("word", pa.string()), ("n", pa.int64())])
    found = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("form_n", pa.int64()), ("form", pa.string())])

    def emit(batches):
        for batch in batches:
            for size, some, counts in by_length(batch):
                without, whole = keys(some)
                row = pa.array(np.repeat(np.arange(len(some)), size + 1))
                key = np.concatenate([without, whole[:, None]], axis=1).ravel().view(np.int64)
                place = np.tile(np.append(np.arange(size), -1), len(some)).astype(np.int16)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(place), pa.array(some, pa.string()).take(row), pa.array(counts, pa.int64()).take(row)], schema=keyed)

    def meet(batches):
        last_key, last, out = None, [], []
        for batch in batches:
            key = batch.column(0).to_numpy()
            cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
            starts, stops = np.append(0, cuts), np.append(cuts, len(key))
            several = (stops - starts > 1) | (starts == 0) | (stops == len(key))  # others meet nobody
            for a, b in zip(starts[several].tolist(), stops[several].tolist()):
                rows = list(zip(*(c.slice(a, b - a).to_pylist() for c in batch.columns[1:])))
                if last_key == key[a]:
                    last += rows
                else:
                    out += group(last)
                    last_key, last = key[a], rows
            if len(out) >= 20_000:
                yield table(out)
                out = []
        out += group(last)
        if out:
            yield table(out)

    def table(out):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), found)], schema=found)

    def group(rows):
        """What the words that share a key see of each other, verified on the strings."""
        if len(rows) < 2:
            return []
        out, wholes, same, shorter = [], {}, {}, {}
        for place, word, n in rows:
            if place < 0:
                wholes[word] = n
                continue
            rest = word[:place] + word[place + 1 :]
            same.setdefault((place, rest), []).append((n, word))
            if not place or word[place] != word[place - 1]:
                shorter.setdefault(rest, []).append((n, word))
        for cell in same.values():
            if len(cell) > 1:
                out += seen(cell, cell)
        for rest, longer in shorter.items():
            if rest in wholes:
                one = [(wholes[rest], rest)]
                out += seen(one, longer) + seen(longer, one)
        return out

    def seen(these, others):
        """For each of these words: how many others, and the best if it is frequent enough."""
        best, out = sorted(others, key=lambda x: (-x[0], x[1]))[:2], []
        for n, word in these:
            m, other = best[0] if best[0][1] != word else best[1]
            fit = m >= factor * n
            out.append((word, len(others) - (these is others), m if fit else None, other if fit else None))
        return out

    spread = words.select("word", "n").mapInArrow(emit, "key long, place short, word string, n long")
    return spread.repartition(shuffle_partitions(spark), "key").sortWithinPartitions("key").mapInArrow(meet, "word string, n_near long, form_n long, form string")


def by_length(batch):
    """Words and counts of a batch by length, in bounded parts."""
    for at in range(0, batch.num_rows, 20_000):
        part, by = batch.slice(at, 20_000), {}
        for word, n in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            by.setdefault(len(word), []).append((word, n))
        for size, pairs in by.items():
            step = max(1, 200_000 // size)
            for low in range(0, len(pairs), step):
                words, counts = zip(*pairs[low : low + step])
                yield size, list(words), list(counts)


def met_of_long(words: DataFrame, factor: int) -> DataFrame:
    """The same for words over ``LONG`` code points, whose strings don't travel with each of their keys.

    Keys and a reference do; pairs that meet fetch their strings and are verified on them.
    """
    ship(words.sparkSession)
    keyed = pa.schema([("key", pa.int64()), ("place", pa.int64()), ("size", pa.int64()), ("fresh", pa.bool_()), ("ref", pa.string())])

    def emit(batches):
        for batch in batches:
            for size, some, refs in by_length(batch):
                without, whole = keys(some)
                for i, ref in enumerate(refs):
                    codes = np.array([some[i]]).view(np.uint32)
                    fresh = np.append(np.append(True, codes[1:] != codes[:-1]), False)
                    key = np.append(without[i], whole[i]).view(np.int64)
                    for at in range(0, size + 1, 50_000):
                        n = len(key[at : at + 50_000])
                        place = np.arange(at, at + n)
                        place[place == size] = -1
                        yield pa.RecordBatch.from_arrays([pa.array(key[at : at + n]), pa.array(place), pa.array(np.full(n, size)), pa.array(fresh[at : at + n]), pa.array([ref] * n)], schema=keyed)

    def verify(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                keep = [one_apart(a, b) for a, b in zip(part.column(0).to_pylist(), part.column(2).to_pylist())]
                yield part.filter(pa.array(keep, pa.bool_()))

    held = cut(words.select("word", "n", F.sha2("word", 256).alias("ref")))
    rows = cut(held.select("word", "ref").mapInArrow(emit, "key long, place long, size long, fresh boolean, ref string"))
    a, b = rows.alias("a"), rows.alias("b")
    replaced = a.where("place >= 0").join(b.where("place >= 0"), ["key", "place", "size"]).where("a.ref < b.ref").where(F.col("size") > LONG)
    removed = a.where("fresh").join(b.where("place < 0"), F.expr("a.key = b.key and a.size = b.size + 1"))
    pairs = replaced.select(F.col("a.ref").alias("x"), F.col("b.ref").alias("y")).unionByName(removed.select(F.col("a.ref").alias("x"), F.col("b.ref").alias("y"))).distinct()
    left, right = (held.select(F.col("ref").alias(r), F.col("word").alias(w), F.col("n").alias(n)) for r, w, n in (("x", "u", "nu"), ("y", "v", "nv")))
    near_pairs = cut(pairs.join(left, "x").join(right, "y").select("u", "nu", "v", "nv").mapInArrow(verify, "u string, nu long, v string, nv long"))
    both = near_pairs.unionByName(near_pairs.select(F.col("v").alias("u"), F.col("nv").alias("nu"), F.col("u").alias("v"), F.col("nu").alias("nv")))
    fit = F.col("nv") >= factor * F.col("nu")
    return both.select(F.col("u").alias("word"), F.lit(1).cast("long").alias("n_near"), F.when(fit, F.col("nv")).alias("form_n"), F.when(fit, F.col("v")).alias("form"))


def one_apart(a: str, b: str) -> bool:
    """Do the strings differ by exactly one inserted, deleted or replaced code point?"""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    low, high = 0, min(len(a), len(b))  # length of the common start, by halving
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle - 1)
    return a[low + (len(a) >= len(b)) :] == b[low + (len(b) >= len(a)) :]


def roots(forms: DataFrame, max_rounds: int = 40) -> DataFrame:
    """``word, form`` -> ``word, root``: forms followed to the last, twice as far each round."""
    now = cut(forms.select("word", F.col("form").alias("root")))
    for _ in range(max_rounds):
        ahead = now.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
        step = cut(now.join(ahead, now["root"] == ahead["_at"], "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")))
        now = step.drop("moved")
        if step.where("moved").isEmpty():
            return now
    raise RuntimeError(f"forms haven't ended in {max_rounds} rounds")


def variants(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, factor: int = FACTOR, drop: int = DROP) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of ``least_length`` and ``least_count`` or more."""
    words = cut(counted(docs, id_col=id_col, text_col=text_col, least=least_length, drop=drop).where(F.col("n") >= least_count))
    met = cut(near(words, factor))
    last = roots(met.where("form is not null").select("word", "form")).withColumnRenamed("word", "_word")
    out = words.join(met, "word", "left")
    out = out.join(last, out["word"] == last["_word"], "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
