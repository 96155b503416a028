"""The operators as named queries over the given tables, and their SQL where SQL can express them."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, exactdedup, hardneg, langid, license, quality, setsketch, substring, tokenfile, toxicity, urlfilter, whitening
from .sql import ORACLES  # noqa: F401
from .words import read_table

# The rules of the url query.
URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def _remainder(column, n: int):
    return F.crc32(column.cast("string")) % n


def op1_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents")
    model = langid.fit(docs, _remainder(F.col("doc_id"), 4) != 2)
    held_out = F.coalesce(_remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    return model.predict(docs.select("doc_id", "text")).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_url_filters(spark: SparkSession, sf: str) -> DataFrame:
    return urlfilter.judge_urls(read_table(spark, sf, "pages"), spark.createDataFrame(URL_RULES, "rule string, verdict string"))


def op3_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exactdedup.duplicate_groups(read_table(spark, sf, "documents")).drop("digest")


def op4_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return substring.remove_repeats(read_table(spark, sf, "documents")).drop("kept_text")


def op5_license_scans(spark: SparkSession, sf: str) -> DataFrame:
    return license.scan_licenses(read_table(spark, sf, "documents")).drop("spans")


def op6_bpe(spark: SparkSession, sf: str) -> DataFrame:
    done = bpe.encode_texts(read_table(spark, sf, "documents"))
    return done.select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


def op7_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    done = decontam.find_contamination(read_table(spark, sf, "documents"), read_table(spark, sf, "benchmark"))
    return done.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def op8_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents")
    model = toxicity.fit(docs, read_table(spark, sf, "labels"), F.crc32("id") % 5 != 0)
    held_out = F.coalesce(_remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    return model.score(docs).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_token_files(spark: SparkSession, sf: str) -> DataFrame:
    manifest, ranks = tokenfile.write_token_files(read_table(spark, sf, "documents"))
    return tokenfile.read_token_files(manifest, ranks).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return setsketch.near_duplicates(read_table(spark, sf, "documents"), size=3, similarity=0.85)


def op11_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.whiten(read_table(spark, sf, "embeddings"))


def op12_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    rows = read_table(spark, sf, "embeddings").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.mine_hard_negatives(rows.withColumn("label", moved), F.col("id") % 100 == 0)


def op13_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents")
    model = quality.fit(docs, read_table(spark, sf, "labels"), F.crc32("id") % 4 != 2)
    held_out = F.coalesce(_remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    return model.score(docs).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_language_id, op2_url_filters, op3_exact_dedup, op4_substring_dedup, op5_license_scans, op6_bpe, op7_decontamination, op8_toxicity, op9_token_files, op10_near_dedup, op11_whitening, op12_hard_negatives, op13_quality)
}
