"""Quality classifier: importance resampling over hashed n-grams.

Two bag-of-n-grams models over hashed words and pairs of words: one of target
text (labelled good and not toxic), one of all the raw text. A document's weight
is the sum of the log ratios of the two over its n-grams, by the root of their
number, so that long and short documents compare; ratios of buckets whose
counts don't differ by more than ``SIGNIFICANT`` standard deviations are 0, so a
few rare n-grams that the target hardly holds aren't lost among many usual ones.

``gumbel_top_k`` draws: the k largest of weight / temperature plus Gumbel noise are a
sample without replacement in which each next document is drawn with a probability
proportional to the exponential of its weight / temperature. ``k`` may be given. Otherwise
it is the number of documents that weigh no less than all but ``SPARE`` of target
documents do, counted on the half of the labelled target documents that the model
isn't fitted on. A filter wants a low temperature: weights of junk lie hundreds below
those of clean text, and a high one would only drop clean documents by chance.

The target model is fitted on at most ``MAX_TARGET`` labelled documents, those
of least hash; the raw counts, weights and the selection cover every document.

Texts of any length are read whole; extra columns are left behind, or kept in a
struct of their own. Nulls: a null text has no n-grams and weight 0, as an empty one has. Null ids
have no label. Noise depends on id and text, so repeated rows share their fate,
and rows tied at the threshold are all kept. Without any label, or on an empty
table, everything is kept.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import VECTOR_ROWS, cut, ship, stage, sum_vectors, vector_rows
from .tokens import release

BUCKETS = 1 << 16
MAX_TARGET = 20_000
#: What weights are divided by beside the Gumbel noise: the lower, the nearer the sample is to the best.
TEMPERATURE = 0.01
#: Pseudo-counts of each bucket in both models, on the scale of the target's counts.
PSEUDO = 1.0
#: Standard deviations by which a bucket's counts must differ to say anything.
SIGNIFICANT = 4.0
#: Share of the target's documents whose weights are set aside as outliers when k is counted.
SPARE = 0.002
_TOKEN = re.compile(r"\w+|[^\w\s]+")


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= 200_000:
            self.clear()
        h = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        return h


_HASHES = _Hashes()


def ngrams(text: str | None, buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of all words, then of all pairs of neighbours."""
    words = _TOKEN.findall((text or "").lower())
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    pairs = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed = np.concatenate([h * np.uint64(0xFF51AFD7ED558CCD), pairs])
    return (((mixed ^ (mixed >> np.uint64(29))) >> np.uint64(16)) & np.uint64(buckets - 1)).astype(np.int64)


def target_ids(docs: DataFrame, labels: DataFrame, max_target: int = MAX_TARGET) -> list[int]:
    """Ids of at most ``max_target`` target documents of the input, in the order of their hash; narrow columns only."""
    wanted = labels.where("doc_id is not null and quality = 1 and coalesce(toxic, 0) <> 1").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    here = wanted.join(docs.select("doc_id"), "doc_id", "left_semi")
    # a share of the hashes that gives about a fifth more is taken first, so tasks send few ids whatever their number
    share = min(1.0, 1.2 * max_target / max(1, here.count()))
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 11).cast("double") / F.lit(2.0**53)
    return [r.doc_id for r in here.where(place < share).orderBy(place, "doc_id").limit(max_target).collect()]


def models(docs: DataFrame, ids: list[int], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the target's and of all n-grams by bucket; one pass over all texts."""
    ship(docs.sparkSession)
    wanted = docs.sparkSession.sparkContext.broadcast(frozenset(ids))  # at most MAX_TARGET ids

    def run(batches):
        release()
        raw, target = np.zeros(buckets), np.zeros(buckets)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                grams = ngrams(text.as_py(), buckets)
                counts = np.bincount(grams, minlength=buckets) if len(grams) > buckets // 8 else None
                for model in (raw, target) if doc_id in wanted.value else (raw,):
                    if counts is None:
                        np.add.at(model, grams, 1.0)
                    else:
                        model += counts
        _HASHES.clear()  # a reused worker keeps nothing for other operators' tasks
        yield from vector_rows({0: raw, 1: target})
        release()

    sums = sum_vectors(docs.select("doc_id", "text").mapInArrow(run, VECTOR_ROWS), {0: buckets, 1: buckets})
    return sums[1], sums[0]


def log_ratios(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Log of target over raw probability per bucket; 0 where they don't differ significantly."""
    if not target.sum() or not raw.sum():
        return np.zeros(len(raw))
    expected = raw * (target.sum() / raw.sum())
    differs = np.abs(target - expected) > SIGNIFICANT * np.sqrt(expected + 1)
    return np.where(differs, np.log((target + PSEUDO) / (expected + PSEUDO)), 0.0)


def weights(docs: DataFrame, ratios: np.ndarray, ids: list[int]) -> DataFrame:
    """``doc_id, n_grams, weight, crc, unseen`` for every document, and its ``row`` if there is one."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((ratios, frozenset(ids)))  # one number a bucket, at most MAX_TARGET ids
    rows = [f for f in docs.schema.fields if f.name == "row"]

    def run(batches):
        release()
        table, unseen = shared.value
        for batch in batches:
            n, w, crc = [], [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                grams = ngrams(text, len(table))
                n.append(len(grams))
                w.append(float(table[grams].sum() / len(grams) ** 0.5) if len(grams) else 0.0)
                crc.append(zlib.crc32(text.encode("utf-8", "surrogatepass")))
            columns = [batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(w, pa.float64()), pa.array(crc, pa.int64()), pa.array([i in unseen for i in batch.column(0).to_pylist()], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*columns, *batch.columns[2:]], names=["doc_id", "n_grams", "weight", "crc", "unseen", *batch.schema.names[2:]])
        _HASHES.clear()
        release()

    schema = StructType([*StructType.fromDDL("doc_id long, n_grams long, weight double, crc long, unseen boolean").fields, *rows])
    return docs.select("doc_id", "text", *[f.name for f in rows]).mapInArrow(run, schema)


def kth_largest(scores: DataFrame, column: str, k: int) -> float:
    """Exact, by counts over ever narrower ranges: at most some 4,096 counts reach the driver each round."""
    s = scores.select(F.col(column).alias("s"))
    row = s.agg(F.min("s").alias("low"), F.max("s").alias("high")).first()
    low, high, above = row.low, row.high, 0
    while low < high:
        width = (high - low) / 4096
        if width == 0.0 or low + width == low:
            break
        at = F.least(F.lit(4095), F.floor((F.col("s") - F.lit(low)) / F.lit(width))).cast("int")
        found = {r.at: r for r in s.where(F.col("s").between(low, high)).groupBy(at.alias("at")).agg(F.count("*").alias("n"), F.min("s").alias("low"), F.max("s").alias("high")).collect()}
        for i in sorted(found, reverse=True):
            if above + found[i].n >= k:
                low, high = found[i].low, found[i].high
                break
            above += found[i].n
    return low


def noisy(weighed: DataFrame, seed: int, temperature: float) -> DataFrame:
    """``score``: the weight, tempered, with Gumbel noise that the row's ``doc_id`` and ``crc`` decide."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "crc"), 11).cast("double") + 0.5) / F.lit(2.0**53)
    return weighed.withColumn("score", F.col("weight") / temperature - F.log(-F.log(u)))


def gumbel_top_k(weighed: DataFrame, k: int, seed: int = 8, temperature: float = 1.0) -> DataFrame:
    """``kept``: a sample of ``k`` rows (all, if there are fewer; tied ones too) of ``doc_id, crc, weight`` rows."""
    scores = cut(noisy(weighed, seed, temperature))
    n = scores.count()
    least = -math.inf if k >= n else math.inf if k <= 0 else kth_largest(scores, "score", k)
    return scores.withColumn("kept", F.col("score") >= F.lit(least))


def resample(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", seed: int = 8, max_target: int = MAX_TARGET, k: int | None = None, temperature: float = TEMPERATURE, whole_rows: bool = False) -> DataFrame:
    """``doc_id, n_grams, weight, score, kept`` for every row of ``docs``.

    ``labels``: ``doc_id, quality, toxic``. ``k``: how many to keep, else it follows from
    unseen target documents. ``whole_rows`` adds ``row``, a struct
    of the input's columns, so that a filter needs no join.
    """
    row = [F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")] if whole_rows else []
    slim = docs.select(docs[f"`{id_col}`"].cast("long").alias("doc_id"), docs[f"`{text_col}`"].alias("text"), *row)
    drawn = target_ids(slim, labels, max_target)
    ids, unseen = drawn[::2], drawn[1::2]
    ratios = log_ratios(*models(slim, ids)) if ids else np.zeros(BUCKETS)
    weighed = noisy(weights(slim, ratios, unseen), seed, temperature)
    scores = stage(weighed, "scores") if whole_rows else cut(weighed)
    least = -math.inf
    if k is not None:
        least = math.inf if k <= 0 else kth_largest(scores, "score", k) if k < scores.count() else least
    elif unseen:
        own = scores.where("unseen")
        usual = kth_largest(own, "weight", math.ceil((1 - SPARE) * own.count()))
        least = kth_largest(scores, "score", scores.where(F.col("weight") >= F.lit(usual)).count())
    return scores.select("doc_id", "n_grams", "weight", "score", (F.col("score") >= F.lit(least)).alias("kept"), *["row"] * whole_rows)
