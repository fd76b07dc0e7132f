"""The registered queries of this subpackage: thin digests of the operators' results.

Each takes ``(spark, sf_dir)`` and runs its operator over the whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, decontaminate, divergence, divergence_sql, edit_counts, html_region, hypershuffle, importance, kk_pack, minhash, prefix_trie, rans, simhash_gray, spelling
from .common import stage
from .tokens import vocabulary_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("found", 4).alias("found"), F.round("common", 4).alias("common"))


def op2_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = rans.write(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"))
    return rans.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_gray_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_gray.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash_gray.hexadecimal().alias("fingerprint"), "component_id")


def op4_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = divergence.assess(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("char_distance", 4).alias("char_distance"), F.round("word_distance", 4).alias("word_distance"),
    )


def op5_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hypershuffle.write_shards(table(spark, sf_dir, "documents"), 8, seed=5)  # the documents themselves; digests are of what was written
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_scored_html_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    weights = html_region.weights_from(html_region.labelled_sample(pages, "page_id"))
    return html_region.extract_main_text(pages, weights).withColumn("n_chars", F.char_length("text").cast("long"))


def op7_differencing_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = kk_pack.pack(table(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_grams", "weight", "score", "kept")


def op9_nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.identify(table(spark, sf_dir, "documents"))


def op10_edit_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = vocabulary_path("byte_bpe_50k.json")
    trees = stage(edit_counts.build_trees(table(spark, sf_dir, "documents"), vocabulary), "trees")  # kept; the edits below are another job's
    edited = edit_counts.update_trees(trees, vocabulary, edit_counts.redactions)
    return edited.select("doc_id", "n_before", "n_edits", "n_tokens", "reencoded_chars", F.char_length("text").cast("long").alias("n_chars"))


def op11_deletion_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_one_permutation_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stage(prefix_trie.turns(table(spark, sf_dir, "conversations")), "numbered")
    most, conv = 5, F.col("conv_id")
    lent = F.crc32(conv.cast("string")) % (most + 1)
    rebuilt = stage(prefix_trie.spliced(rows, conv - F.pmod(conv, F.lit(100)), lent, most), "rebuilt")
    return prefix_trie.trie(rebuilt, rows.select("conv_id"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_latent_decontamination": op1_latent_decontamination,
    "op2_rans_tokens": op2_rans_tokens,
    "op3_gray_simhash": op3_gray_simhash,
    "op4_distribution_divergence": op4_distribution_divergence,
    "op5_hypergeometric_shards": op5_hypergeometric_shards,
    "op6_scored_html_region": op6_scored_html_region,
    "op7_differencing_pack": op7_differencing_pack,
    "op8_importance_resampling": op8_importance_resampling,
    "op9_nearest_centroid": op9_nearest_centroid,
    "op10_edit_token_counts": op10_edit_token_counts,
    "op11_deletion_variants": op11_deletion_variants,
    "op12_one_permutation_minhash": op12_one_permutation_minhash,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE_SQL: dict[str, str] = {"op4_distribution_divergence": divergence_sql.oracle()}
