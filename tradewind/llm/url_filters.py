"""URL rules by host-suffix and path-prefix expressions.

Each URL is expanded into expressions host suffix + path prefix, of the label counts and
path lengths that occur among the rules, so a URL has at most as many expressions as the
rules have distinct shapes. Expressions and rules meet in an equi join on the first bytes
of their SHA-256 digest; the full digests and the texts confirm the match, and the longest
rule wins.

Defined results: a null URL or one without ``://`` has an empty host and path and fits no
rule; a host or path is taken literally (ports and user names belong to the host, only A-Z
are lower-cased); of rules of equal length the one with the longer host wins, then block
before allow; rules with a null part are skipped; repeated rules count once; rows with equal
or null ids are judged one by one; without a rule the verdict is ``allow``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, with_row_id

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hexadecimal digits of the digest that route the join: 32 bits.
PREFIX_DIGITS = 8
DEFAULT_VERDICT = "allow"


def rules_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Rules given as (verdict, host, path)."""
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL, both empty without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    known = url.contains("://")
    host = F.translate(F.regexp_extract(url, pattern, 1), UPPER, LOWER)
    path = F.regexp_extract(url, pattern, 2)
    empty = F.lit("")
    return F.when(known, host).otherwise(empty), F.when(known, path).otherwise(empty)


def _prepared(rules: DataFrame) -> DataFrame:
    """One row per rule with its digest, best verdict first for repeated rules."""
    return (
        rules.filter("host is not null and path is not null and verdict is not null")
        .select(F.translate("host", UPPER, LOWER).alias("rule_host"), F.col("path").alias("rule_path"), "verdict")
        .groupBy("rule_host", "rule_path")
        .agg(F.max(F.struct((F.col("verdict") == "block").alias("strict"), "verdict")).alias("best"))
        .select(
            "rule_host",
            "rule_path",
            F.col("best.verdict").alias("rule_verdict"),
            F.sha2(_expression(F.col("rule_host"), F.col("rule_path")), 256).alias("rule_digest"),
        )
        .withColumn("short", F.substring("rule_digest", 1, PREFIX_DIGITS))
    )


def _expression(host: Column, path: Column) -> Column:
    # A host has no blank of its own behind the first slash: the line break keeps the parts apart.
    return F.concat(host, F.lit("\n"), path)


def judge_urls(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict``."""
    rules = _prepared(rules)
    # At most as many values as the longest rule has labels and characters.
    shape = rules.agg(
        F.collect_set(F.size(F.split("rule_host", r"\."))).alias("labels"),
        F.collect_set(F.length("rule_path")).alias("lengths"),
    ).first()
    label_counts = F.array(*[F.lit(n) for n in sorted(shape["labels"])]).cast("array<int>")
    lengths = F.array(*[F.lit(n) for n in sorted(shape["lengths"])]).cast("array<int>")

    host, path = url_parts(F.col("url"))
    urls = with_row_id(documents(pages, "page_id", "url")).select("row_id", "page_id", host.alias("host"), path.alias("path"))
    parts = urls.withColumn("parts", F.split("host", r"\."))
    suffixes = F.transform(
        F.filter(label_counts, lambda n: n <= F.size("parts")),
        lambda n: F.array_join(F.slice("parts", F.size("parts") - n + 1, n), "."),
    )
    prefixes = F.transform(
        F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substring("path", F.lit(1), n)
    )
    expressions = F.flatten(
        F.transform(
            suffixes,
            lambda s: F.transform(prefixes, lambda p: F.struct(s.alias("suffix"), p.alias("prefix"))),
        )
    )
    expanded = (
        parts.select("row_id", "page_id", "host", "path", F.explode_outer(expressions).alias("e"))
        .withColumn("digest", F.sha2(_expression(F.col("e.suffix"), F.col("e.prefix")), 256))
        .withColumn("short", F.substring("digest", 1, PREFIX_DIGITS))
    )
    fits = expanded.join(rules, "short", "left").withColumn(
        "fit",
        F.when(
            (F.col("digest") == F.col("rule_digest"))
            & (F.col("e.suffix") == F.col("rule_host"))
            & (F.col("e.prefix") == F.col("rule_path")),
            F.struct(
                (F.length("rule_host") + F.length("rule_path")).alias("size"),
                F.length("rule_host").alias("host_size"),
                (F.col("rule_verdict") == "block").alias("strict"),
                F.concat("rule_host", "rule_path").alias("rule"),
                F.col("rule_verdict").alias("verdict"),
            ),
        ),
    )
    best = fits.groupBy("row_id", "page_id", "host", "path").agg(F.max("fit").alias("fit"))
    return best.select(
        "page_id",
        "host",
        "path",
        F.col("fit.rule").alias("rule"),
        F.coalesce(F.col("fit.verdict"), F.lit(DEFAULT_VERDICT)).alias("verdict"),
    )
