"""Language identification: nearest of several centroids per language.

A text becomes counts of hashed letter pairs and triples, weighted by the square
root of the count and inverse document frequency, scaled to length 1. Each
language has up to ``CLUSTERS`` centroids; a text gets the language of the
centroid with the largest cosine. A text that lies farther from its centroid
than nearly all training texts of that centroid did is marked ``rejected``.

Document frequencies cover all training texts. Clusters start from spherical
k-means over a bounded sample (``SAMPLE`` texts in all); each centroid is then
the mean of all training texts of its language that lie nearest to it.

Nulls: a null text, or one without a letter, is ``und`` with score 0. Rows with a
null language are predicted, not learned from. Repeated rows count once each.
Ties go to the language that sorts first. With nothing to learn from, every
text is ``und``. Texts of any length are counted whole; other columns, whatever they
are called, are left behind.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import VECTOR_ROWS, only, ship, sum_vectors, vector_rows

UNKNOWN = "und"
DIMS = 1 << 12
CLUSTERS = 3
#: Training texts that k-means sees, over all languages.
SAMPLE = 3000
ROUNDS = 8

_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTER


def counts(text: str | None, dims: int = DIMS) -> np.ndarray | None:
    """Hashed pairs and triples of letters, runs of anything else being one space; None without a letter."""
    if not text:
        return None
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return None
    codes = np.where(letter, codes, np.uint32(32))
    codes = codes[letter | np.concatenate([[True], letter[:-1]])]
    codes = np.concatenate([[np.uint32(32)], codes, [np.uint32(32)]]).astype(np.uint32)
    pair = codes[:-1] * np.uint32(0x9E3779B1) + codes[1:] * np.uint32(0x85EBCA77)
    triple = pair[:-1] * np.uint32(0xC2B2AE3D) + codes[2:] * np.uint32(0x27D4EB2F)
    shift = np.uint32(32 - dims.bit_length() + 1)
    return np.bincount(np.concatenate([(pair * np.uint32(0x165667B1)) >> shift, (triple * np.uint32(0x9E3779B1)) >> shift]), minlength=dims)


def vector(text: str | None, idf: np.ndarray) -> np.ndarray | None:
    c = counts(text, len(idf))
    if c is None:
        return None
    v = np.sqrt(c) * idf
    return v / np.sqrt(v @ v)


def held_out(id_col: str = "doc_id") -> Column:
    """The fold that nothing is learned from; a null id is in no such fold."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 4 == 2


class Model:
    """``langs[i]`` belongs to row i of ``centroids``; ``reach``: the least usual cosine."""

    def __init__(self, idf: np.ndarray, langs: list[str], centroids: np.ndarray, reach: np.ndarray):
        self.idf, self.langs, self.centroids, self.reach = idf, langs, centroids, reach

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        v = vector(text, self.idf) if self.langs else None
        if v is None:
            return UNKNOWN, 0.0, True
        cosines = self.centroids @ v
        best = int(np.argmax(cosines))
        return self.langs[best], float(min(1.0, max(0.0, cosines[best]))), bool(cosines[best] < self.reach[best])


def kmeans(vectors: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means from far-apart starts; no chance in it."""
    centers = [vectors.mean(axis=0)]
    centers[0] = vectors[np.argmax(vectors @ centers[0])]
    while len(centers) < min(k, len(vectors)):
        centers.append(vectors[np.argmin(np.max(np.stack([vectors @ c for c in centers]), axis=0))])
    c = np.stack(centers)
    for _ in range(rounds):
        nearest = np.argmax(vectors @ c.T, axis=1)
        for i in range(len(c)):
            if (nearest == i).any():
                m = vectors[nearest == i].sum(axis=0)
                c[i] = m / np.linalg.norm(m)
    return c


def fit(training: DataFrame, dims: int = DIMS, clusters: int = CLUSTERS, sample: int = SAMPLE) -> Model:
    """``training``: ``key`` (anything that tells rows apart), ``text, lang``."""
    spark = training.sparkSession
    ship(spark)

    def frequencies(batches):
        df, n = np.zeros(dims), 0
        for batch in batches:
            for text in batch.column(0):
                c = counts(text.as_py(), dims)
                if c is not None:
                    df += c > 0
                    n += 1
        yield from vector_rows({0: df, 1: np.array([n], float)})

    sums = sum_vectors(training.select("text").mapInArrow(frequencies, VECTOR_ROWS), {0: dims, 1: 1})
    idf = np.log((1 + sums[1][0]) / (1 + sums[0])) + 1
    sizes = {r.lang: r.n for r in training.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model(idf, [], np.zeros((0, dims)), np.zeros(0))
    each = max(4 * clusters, sample // len(sizes))
    # the rows of least hash, by a share that gives about ``each`` a language
    share = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(min(1.0, each / n))) for lang, n in sizes.items()])
    place = F.shiftrightunsigned(F.xxhash64("key", "text", F.lit("sample")), 11).cast("double") / F.lit(2.0**53)
    most = 2 * each * len(sizes)  # what reaches the driver; only equal rows tie
    last = training.where(place < share).select(place.alias("p")).orderBy("p").limit(most).agg(F.max("p")).first()[0]
    shared = spark.sparkContext.broadcast(idf)

    def vectors(batches):
        for batch in batches:
            langs, rows = [], []
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist()):
                v = vector(text.as_py(), shared.value)
                if v is not None:
                    langs.append(lang)
                    rows.append(v.astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(rows, pa.binary())], names=["lang", "v"])

    drawn: dict[str, list[np.ndarray]] = {}
    chosen = training.where((place < share) & (place <= F.lit(last))).select("text", "lang")
    for r in chosen.mapInArrow(vectors, "lang string, v binary").limit(most).collect():
        drawn.setdefault(r.lang, []).append(np.frombuffer(bytes(r.v), np.float32).astype(float))
    langs, starts = [], []
    for lang in sorted(drawn):
        drawn[lang].sort(key=lambda v: v.tobytes())  # whatever order they arrived in
        for c in kmeans(np.stack(drawn[lang]), clusters):
            langs.append(lang)
            starts.append(c)
    if not langs:
        return Model(idf, [], np.zeros((0, dims)), np.zeros(0))
    first = np.stack(starts)
    model = spark.sparkContext.broadcast((langs, first))

    def means(batches):
        names, centers = model.value
        of = {lang: np.array([i for i, x in enumerate(names) if x == lang]) for lang in set(names)}
        total, seen = np.zeros((len(names), dims)), np.zeros((len(names), 3))
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist()):
                v = vector(text.as_py(), shared.value)
                if v is None or lang not in of:
                    continue
                cosines = centers[of[lang]] @ v
                i, c = of[lang][int(np.argmax(cosines))], float(cosines.max())
                total[i] += v
                seen[i] += (1, c, c * c)
        yield from vector_rows({**{2 * i: t for i, t in enumerate(total)}, **{2 * i + 1: s for i, s in enumerate(seen)}})

    sizes_of = {k: (dims, 3)[k % 2] for k in range(2 * len(langs))}
    sums = sum_vectors(training.select("text", "lang").mapInArrow(means, VECTOR_ROWS), sizes_of)
    kept = [i for i in range(len(langs)) if sums[2 * i + 1][0] > 0]
    centroids = np.stack([sums[2 * i] / np.linalg.norm(sums[2 * i]) for i in kept])
    n, s, q = (np.array([sums[2 * i + 1][j] for i in kept]) for j in range(3))
    reach = s / n - 4 * np.sqrt(np.maximum(0.0, q / n - (s / n) ** 2))
    return Model(idf, [langs[i] for i in kept], centroids, reach)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs``: ``doc_id, held_out, text`` -> ``doc_id, held_out, lang_pred, score, rejected``."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.idf, model.langs, model.centroids, model.reach))

    def run(batches):
        m = Model(*shared.value)
        for batch in batches:
            found = [m.predict(t.as_py()) for t in batch.column(2)]
            cols = list(zip(*found)) if found else [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.bool_())], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from the rows outside the held-out fold, then predict every row from its text alone."""
    slim = only(docs, doc_id=id_col, text=text_col, lang=lang_col)
    model = fit(slim.where(~held_out() & F.col("lang").isNotNull()).select(F.col("doc_id").alias("key"), "text", "lang"))
    return predict(slim.select("doc_id", held_out().alias("held_out"), "text"), model)
