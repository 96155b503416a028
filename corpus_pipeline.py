"""A training corpus from documents: language, exact copies, near copies, benchmark passages, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages the rows are written
as Parquet into the shared folder and read again. All stages but the last return the columns of documents.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from insolvia.llm import bpe, decontam, exactdedup, langid, setsketch
from insolvia.llm.words import read_table
from insolvia.session import materialize

# A document is rejected when no language is found (no letter in it) or none reaches this calibrated probability.
LEAST_LANGUAGE_SCORE = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a recognisable language."""
    model = langid.fit(docs, F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    judged = model.predict(docs, language="_language", score="_language_score")
    return judged.where((F.col("_language") != langid.UNKNOWN) & (F.col("_language_score") >= LEAST_LANGUAGE_SCORE)).select(*docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space one stays."""
    return exactdedup.drop_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles with a similarity of 0.8 or more one stays."""
    return setsketch.keep_one(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    return decontam.clean_documents(docs, read_table(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian 32-bit) and digests of the ids and of the decoded text."""
    done = bpe.encode_texts(docs)
    return done.select("doc_id", "n_tokens", "ids", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language_id", language_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("decontamination", benchmark_stage), ("bpe", token_stage)]

# Language scores and token ids are beyond SQL: the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
