"""URL filtering by hashed host-suffix and path-prefix expressions.

Every different (host, path) of the input is judged once. It is expanded into its host suffixes
combined with those path prefixes whose length occurs among the rules (a rule's path may end inside
a path segment). Expressions meet the rules on the first 4 bytes of their SHA-256 in an equi-join;
a match counts once the full digests agree. Of the rules that fit, the longest expression wins; for
rules of equal length `block` wins. The verdict then joins back to all rows of its (host, path).

Rules are host + path, such as `net/` or `example.org/en/1`; they fit the host, all its subdomains
and every path that begins with theirs. Without a fitting rule a row with a host is allowed and a
row without one blocked: the method can say nothing good of what is no url.

Defined cases: a null url or one without `://` has empty host and path; repeated rows each get their
answer; the same rule given as allow and block counts as block; empty rules or pages give no match
or no rows; only the two named columns are read.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import max_driver_rows

DEFAULT_VERDICT, NO_HOST_VERDICT = "allow", "block"
PREFIX_HEX = 8  # 4 bytes


def split_url(url):
    """Host (A-Z lowered) and path of a url column."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def judge_urls(pages: DataFrame, rules: DataFrame, ident: str = "page_id", url: str = "url") -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict. rules has the columns rule and verdict."""
    host, path = split_url(F.col(url))
    rows = pages.select(F.col(ident).alias("page_id"), host.alias("host"), path.alias("path"))
    book = (
        rules.where(F.col("rule").isNotNull() & F.col("rule").contains("/"))
        .groupBy("rule").agg(F.max(F.col("verdict") == "block").alias("block"))
        .select("rule", "block", F.sha2("rule", 256).alias("digest"), F.length(F.substring_index("rule", "/", 1)).alias("n_host"), F.length("rule").alias("n_rule"))
        .select("*", F.substring("digest", 1, PREFIX_HEX).alias("prefix"))
    )
    # Lengths of rule paths and depths of rule hosts: two short lists whatever the number of rules.
    sizes = book.select((F.col("n_rule") - F.col("n_host")).alias("path_size"), F.size(F.split(F.substring_index("rule", "/", 1), r"\.")).alias("depth"))
    lists = sizes.agg(F.sort_array(F.collect_set("path_size")).alias("path_sizes"), F.sort_array(F.collect_set("depth")).alias("depths")).first()
    answer = rows.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("boolean").alias("block"))
    if lists["path_sizes"]:
        places = rows.where((F.col("host") != "") & (F.col("path") != "")).select("host", "path").distinct()
        depths = F.array(*[F.lit(d) for d in lists["depths"]])
        lengths = F.array(*[F.lit(n) for n in lists["path_sizes"]])
        suffixes = F.transform(F.filter(depths, lambda d: d <= F.size(F.split("host", r"\."))), lambda d: F.concat_ws(".", F.slice(F.split("host", r"\."), -d, d)))
        prefixes = F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
        expressions = (
            places.select("host", "path", F.explode(suffixes).alias("suffix"))
            .select("host", "path", "suffix", F.explode(prefixes).alias("start"))
            .select("host", "path", F.sha2(F.concat("suffix", "start"), 256).alias("full"))
            .select("host", "path", "full", F.substring("full", 1, PREFIX_HEX).alias("prefix"))
        )
        # The rules are broadcast only when they are counted to be few; else both sides are shuffled on the prefix.
        limit = max_driver_rows(pages.sparkSession)
        few = book.limit(limit + 1).count() <= limit
        met = expressions.join(F.broadcast(book) if few else book.hint("shuffle_merge"), "prefix").where("full = digest")
        verdicts = met.groupBy("host", "path").agg(F.max(F.struct("n_rule", "block", "rule")).alias("best")).select("host", "path", "best.rule", "best.block")
        answer = rows.join(verdicts, ["host", "path"], "left")
    verdict = F.when(F.col("block"), "block").when(~F.col("block"), "allow").when(F.col("host") == "", NO_HOST_VERDICT).otherwise(DEFAULT_VERDICT)
    return answer.select("page_id", "host", "path", "rule", verdict.alias("verdict"))
