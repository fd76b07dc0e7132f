"""Quality rules by distribution divergence, in DataFrame expressions only.

One pass turns each text into counts: six character classes and the common words
of each reference language. The references are the summed counts of the corpus's
own documents of that language which are long enough and pass the base rules. A
document is kept if both of its histograms lie within a Jensen-Shannon distance
of some one language's. Languages without a word list have no reference: a
document labelled with one passes this test, and so does one below the guards.

Texts of any length are counted whole. Extra columns are left behind, or kept in
a struct of their own. Nulls: a null text has no words (base rules fail). A null ``lang`` helps no
reference and is compared with all of them. With no reference at all (an empty
table, or no document long enough) only the base rules decide. Repeated rows
count once each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, stage

#: Common words of the reference languages; a parameter of the operator.
COMMON_WORDS = {
    "de": ["der", "die", "das", "und", "in", "den", "von", "zu", "mit", "ist", "im", "für", "auf", "ein", "eine", "des"],
    "en": ["the", "of", "and", "to", "in", "is", "for", "that", "on", "are", "as", "with", "be", "it", "this", "a"],
    "es": ["el", "la", "los", "las", "de", "del", "y", "en", "que", "un", "una", "por", "con", "para", "se", "su"],
    "fr": ["le", "la", "les", "de", "des", "et", "en", "un", "une", "du", "que", "qui", "pour", "dans", "est", "au"],
}
#: Character classes, counted one after another; what is left is the last class.
CLASSES = {"lower": r"[a-z]+", "upper": r"[A-Z]+", "letter": r"\p{L}+", "digit": r"\p{N}+", "mark": r"[.,;:!?'\"()\-]+"}
SPACE = r"[\x20\x09-\x0D]+"
#: Bounds on the distances: (a, b) allows a + b / sqrt(characters or words), as short histograms are noisy.
MAX_CHAR_DISTANCE = (0.165, 2.2)
MAX_WORD_DISTANCE = (0.17, 1.1)
#: Guards: the histograms of shorter texts are too noisy to compare.
MIN_CHARS = 200
MIN_WORDS = 50


def repeated_window_words(hashes: str) -> Column:
    """How many words lie in a window that occurs twice or more; ``hashes``: a column of one hash per window of three."""
    h = F.col(hashes)
    marked = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

    def positions(s: Column) -> Column:
        none = F.array(F.lit(None).cast("bigint"))
        keys = F.transform(s, lambda x: x["h"])
        beside = F.arrays_zip(s.alias("s"), F.concat(none, keys).alias("p"), F.concat(F.slice(keys, 2, F.greatest(F.size(keys) - 1, F.lit(0))), none).alias("n"))
        twice = F.filter(beside, lambda z: (z["s"]["h"] == z["p"]) | (z["s"]["h"] == z["n"]))
        return F.sort_array(F.transform(twice, lambda z: z["s"]["i"]))

    def covered(p: Column) -> Column:
        steps = F.zip_with(p, F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def of_few(s: Column) -> Column:  # s: the hashes in order; those that recur, then where they stand
        again = F.filter(F.zip_with(s, F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))), lambda a, b: F.when(a == b, a)), lambda x: x.isNotNull())
        return let(again, lambda twice: F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(twice, x), i)), lambda i: i.isNotNull()))

    let = lambda value, body: F.transform(F.array(value), body)[0]  # noqa: E731  evaluates the value once
    extra = F.size(h) - F.size(F.array_distinct(h))
    few, many = let(let(F.sort_array(h), of_few), covered), let(let(marked, positions), covered)
    # both forms are exact; looking up each hash among the recurring ones is cheaper while these are few
    counted = let(extra, lambda n: F.when(n == 0, 0).when(n <= 64, few).otherwise(many))
    return counted.cast("long")


def base_counts(docs: DataFrame, text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, and ``_words``, ``_dense``."""
    t = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    df = docs.withColumn("_t", t)
    df = df.withColumns({"_words": F.array_remove(F.split("_t", SPACE), ""), "_lines": F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    df = df.withColumn("_dense", F.array_join("_words", ""))
    n = F.size("_words")
    # one hash per window of three words, from hashes of words and pairs
    after = lambda c, k: F.slice(c, k + 1, F.greatest(n - k, F.lit(0)))
    df = df.withColumn("_h", F.transform("_words", lambda w: F.xxhash64(w)))
    df = df.withColumn("_hashes", F.zip_with(F.zip_with(F.slice("_h", 1, F.greatest(n - 2, F.lit(0))), F.slice("_h", 2, F.greatest(n - 2, F.lit(0))), lambda x, y: F.xxhash64(x, y)), after("_h", 2), lambda x, y: F.xxhash64(x, y)))
    df = df.withColumns({
        "n_words": n.cast("long"),
        "word_chars": F.char_length("_dense").cast("long"),
        "n_symbols": (F.char_length("_dense") - F.char_length(F.regexp_replace("_dense", "[#*$%&|<>]+", ""))).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": repeated_window_words("_hashes"),
    })
    return df.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).drop("_h", "_hashes", "_lines")


def histograms(df: DataFrame) -> DataFrame:
    """Adds ``_chars`` (counts of the classes) and ``_common`` (counts of all common words), from ``_words`` and ``_dense``."""
    rest, sizes = F.col("_dense"), []
    left = [rest]
    for i, pattern in enumerate(CLASSES.values()):
        df = df.withColumn(f"_r{i}", F.regexp_replace(left[-1], pattern, ""))
        sizes.append(F.char_length(left[-1]) - F.char_length(F.col(f"_r{i}")))
        left.append(F.col(f"_r{i}"))
    sizes.append(F.char_length(left[-1]))
    df = df.withColumn("_chars", F.array(*[x.cast("long") for x in sizes])).drop(*[f"_r{i}" for i in range(len(CLASSES))])
    words = sorted({w for ws in COMMON_WORDS.values() for w in ws})
    df = df.withColumn("_short", F.transform(F.filter("_words", lambda w: F.octet_length(w) <= max(len(w.encode()) for w in words)), lambda w: F.lower(w)))
    count = F.transform(F.array(*map(F.lit, words)), lambda w: (F.size("_short") - F.size(F.array_remove("_short", w))).cast("long"))
    return df.withColumn("_common", count).drop("_short")


def _words_of(lang: str) -> list[int]:
    words = sorted({w for ws in COMMON_WORDS.values() for w in ws})
    return [words.index(w) for w in COMMON_WORDS[lang]]


def references(features: DataFrame, langs: list[str]) -> dict[str, tuple[list[float], list[float]]]:
    """Per language: shares of the character classes, and of its common words and all other words. One row a language."""
    sums = [F.sum(F.col("_chars")[i]).alias(f"c{i}") for i in range(len(CLASSES) + 1)]
    n_common = len({w for ws in COMMON_WORDS.values() for w in ws})
    sums += [F.sum(F.col("_common")[i]).alias(f"w{i}") for i in range(n_common)] + [F.sum("n_words").alias("n")]
    out = {}
    for row in features.where(~F.col("base_failed") & F.col("lang").isin(langs)).groupBy("lang").agg(*sums).collect():
        chars = [row[f"c{i}"] for i in range(len(CLASSES) + 1)]
        own = [row[f"w{i}"] for i in _words_of(row.lang)]
        out[row.lang] = ([c / sum(chars) for c in chars], [w / row.n for w in own] + [(row.n - sum(own)) / row.n])
    return out


def js_distance(counts: Column, total: Column, reference: list[float]) -> Column:
    """Square root of the Jensen-Shannon divergence in bits; ``counts``: an array column, ``total``: its sum, not 0."""

    def part(c: Column, q: Column) -> Column:
        p = c.cast("double") / total
        m = (p + q) / 2
        return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0)

    terms = F.zip_with(counts, F.array(*map(F.lit, reference)), part)
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0)))


def assess(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", min_words: int = MIN_WORDS, whole_rows: bool = False) -> DataFrame:
    """Per document: ``doc_id``, the base counts, ``base_failed, char_distance, word_distance, kept``.

    Distances are null where a guard applies or there is no reference. ``min_words``:
    shorter texts fail the base rules. ``whole_rows`` adds ``row``, a struct of
    the input's columns, so that a filter needs no join.
    """
    row = [F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")] if whole_rows else []
    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"), *row)
    measured = histograms(base_counts(slim, min_words=min_words))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    narrow = measured.select("doc_id", "lang", *counts, "_chars", "_common", *["row"] * whole_rows)
    features = stage(narrow, "features") if whole_rows else cut(narrow)
    return verdicts(features, references(features, list(COMMON_WORDS)))


def verdicts(features: DataFrame, refs: dict[str, tuple[list[float], list[float]]]) -> DataFrame:
    long_enough = (F.col("word_chars") >= MIN_CHARS) & (F.col("n_words") >= MIN_WORDS)
    char, word = {}, {}
    total_chars, total_words = F.greatest("word_chars", F.lit(1)), F.greatest("n_words", F.lit(1))
    for lang, (chars, words) in sorted(refs.items()):
        own = F.transform(F.array(*map(F.lit, _words_of(lang))), lambda i: F.col("_common")[i])
        rest = F.col("n_words") - F.aggregate(own, F.lit(0).cast("long"), lambda a, x: a + x)
        char[lang] = F.when(long_enough, js_distance(F.col("_chars"), total_chars, chars))
        word[lang] = F.when(long_enough, js_distance(F.concat(own, F.array(rest)), total_words, words))
    df = features.withColumns({**{f"_c_{k}": v for k, v in char.items()}, **{f"_w_{k}": v for k, v in word.items()}}) if refs else features
    foreign = F.col("lang").isNotNull() & ~F.col("lang").isin(list(refs) or [""])
    near = F.lit(False)
    char_bound = MAX_CHAR_DISTANCE[0] + MAX_CHAR_DISTANCE[1] / F.sqrt(total_chars)
    word_bound = MAX_WORD_DISTANCE[0] + MAX_WORD_DISTANCE[1] / F.sqrt(total_words)
    for lang in sorted(refs):
        near = near | ((F.col(f"_c_{lang}") <= char_bound) & (F.col(f"_w_{lang}") <= word_bound))
    low = lambda p: F.array_min(F.array(*[F.col(f"_{p}_{k}") for k in sorted(refs)])) if refs else F.lit(None).cast("double")
    return df.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        low("c").alias("char_distance"), low("w").alias("word_distance"),
        (~F.col("base_failed") & (foreign | ~long_enough | near if refs else F.lit(True))).alias("kept"), *[c for c in features.columns if c == "row"],
    )
