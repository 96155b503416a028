"""Exact duplicate removal with DataFrame functions only.

A text is compared after deleting the ASCII white space. Rows are grouped by the 128-bit MD5 of
that normalised text together with the text itself: the map-side combine and the hash aggregate
compare the bytes, so a digest shared by different texts gives several classes, not one wrong group.
A hot group of copies reaches the shuffle once per map task. Rows then learn their class over the
digest alone (16 bytes); only digests that hold several classes are looked up by their bytes.

Defined cases: a null text counts as empty; among equal texts the row with the most code points in
the original stays, then the smallest id; a null id comes after every other id; rows that share id
and text are one document and get the same answer; an empty table gives an empty result. Only the
two named columns are read, so other columns never clash.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .words import free_names

WHITE_RUN = r"[\x20\x09-\x0D]+"

# A keeper's rank is one number: code points first, then the id counted down, so that max() finds it
# with a fixed-width buffer. Ids fill 64 bits and one more value stands for null.
_STEP = "36893488147419103232"  # 2^65
_TOP = "9223372036854775807"


def normalised(text: str = "text"):
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), WHITE_RUN, "")


def _rank(length, ident):
    down = F.coalesce(F.lit(_TOP).cast("decimal(20,0)") - ident.cast("decimal(20,0)"), F.lit(-1).cast("decimal(20,0)"))
    return (length.cast("decimal(17,0)") * F.lit(_STEP).cast("decimal(20,0)") + down).cast("decimal(38,0)")


def duplicate_groups(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, digest."""
    rows = docs.select(F.col(ident).cast("long").alias("doc_id"), normalised(text).alias("norm"), F.length(F.coalesce(F.col(text), F.lit(""))).alias("points"))
    rows = rows.withColumn("digest", F.unhex(F.md5("norm")))
    classes = materialize(
        rows.groupBy("digest", "norm")
        .agg(F.max(_rank(F.col("points"), F.col("doc_id"))).alias("rank"), F.count("*").alias("group_size"))
        .select("digest", F.sha2("norm", 256).alias("text_sha256"), "group_size", _id_of(F.col("rank")).alias("keep_id"), F.xxhash64("norm").alias("mark")),
        "exact-classes",
    )
    per_digest = classes.groupBy("digest").agg(F.count("*").alias("classes"))
    shared = per_digest.where("classes > 1")
    answer = ["doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "digest"]
    if shared.isEmpty():
        return rows.select("doc_id", "digest").join(classes, "digest").select(*answer)
    # Different texts met under one digest: those rows find their class by SHA-256 and a second hash.
    clean = classes.join(shared, "digest", "left_anti")
    mixed = classes.join(shared, "digest", "left_semi")
    apart = rows.join(shared.select("digest"), "digest", "left_semi")
    apart = apart.select("doc_id", "digest", F.sha2("norm", 256).alias("text_sha256"), F.xxhash64("norm").alias("mark"))
    return (
        rows.select("doc_id", "digest").join(clean, "digest").select(*answer)
        .unionByName(apart.join(mixed, ["digest", "text_sha256", "mark"]).select(*answer))
    )


def _id_of(rank):
    """The id inside a keeper's rank (null for the value that stands for a null id)."""
    step = F.lit(_STEP).cast("decimal(20,0)")
    down = F.pmod(rank + F.lit(1).cast("decimal(38,0)"), step.cast("decimal(38,0)")) - F.lit(1).cast("decimal(38,0)")
    return F.when(down >= 0, (F.lit(_TOP).cast("decimal(38,0)") - down).cast("long"))


def drop_duplicates(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with all their columns; of rows that share id and text one stays."""
    groups = duplicate_groups(docs, ident, text).where("kept")
    own, mark, count = free_names(docs, "_id", "_digest", "_rows")
    keys = materialize(groups.groupBy(F.col("doc_id").alias(own), F.col("digest").alias(mark)).agg(F.count("*").alias(count)), "exact-kept")
    marked = docs.withColumn(own, F.col(ident).cast("long")).withColumn(mark, F.unhex(F.md5(normalised(text))))
    match = marked[own].eqNullSafe(keys[own]) & (marked[mark] == keys[mark])
    single, several = keys[count] == 1, keys[count] > 1
    if keys.where(several).isEmpty():
        return marked.join(keys, match, "left_semi").drop(own, mark)
    once = marked.join(keys.where(single), match, "left_semi")
    again = marked.join(keys.where(several), match, "left_semi")
    return once.unionByName(again.dropDuplicates([own, mark])).drop(own, mark)
