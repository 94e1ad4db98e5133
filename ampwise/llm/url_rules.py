"""URL verdicts by host-suffix and path-prefix expressions, joined to rules on short hash prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ampwise.session import small

RULES = [  # host, path, verdict
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]
DEFAULT = "allow"
PREFIX_DIGITS = 8  # hex digits of the digest that the join compares
BROADCAST_RULES = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*", 0), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """Behind the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def _labels(host: str | Column) -> Column:
    return F.split(host, r"\.", -1)


def expressions(host: Column, path: Column, label_counts: list[int], path_lengths: list[int]) -> Column:
    """Host suffixes of so many labels, each with the path prefixes of so many characters."""
    labels = _labels(host)
    pairs = [
        F.when(
            (F.size(labels) >= n) & (F.length(path) >= k),
            F.concat(F.array_join(F.slice(labels, -n, n), "."), F.substring(path, 1, k)),
        )
        for n in label_counts
        for k in path_lengths
    ]
    return F.array_compact(F.array(*pairs)) if pairs else F.array().cast("array<string>")


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of ``pages``.

    A rule fits its host and every subdomain of it, if the path starts with the rule's. The longest rule wins, by the
    characters of host and path, then of the host; of rules with the same host and path the greater verdict. Without a
    rule the verdict is ``default``. Only label counts and path lengths that rules have are expanded, which is exact:
    no other expression can equal a rule. A null url, or one without ``://``, has an empty host and path. Rules with a
    null are left out. Repeated rows are judged alike; an empty table gives no rows.
    """
    rules = rules.dropna(subset=["host", "path", "verdict"])
    rules = rules.select(
        F.translate("host", UPPER, LOWER).alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict")
    ).select("*", F.sha2(F.concat("rule_host", "rule_path"), 256).alias("rule_digest"))
    rules = rules.withColumn("short", F.substring("rule_digest", 1, PREFIX_DIGITS))
    counts = sorted(r[0] for r in rules.select(F.size(_labels("rule_host"))).distinct().collect())
    lengths = sorted(r[0] for r in rules.select(F.length("rule_path")).distinct().collect())
    source = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    asked = source.select(
        F.col("page_id").alias("asked_id"),
        F.col("url").alias("asked_url"),
        F.explode(F.transform(expressions(F.col("host"), F.col("path"), counts, lengths), lambda e: F.sha2(e, 256))).alias("digest"),
    ).withColumn("short", F.substring("digest", 1, PREFIX_DIGITS))
    length = F.length("rule_host") + F.length("rule_path")
    best = (
        asked.join(small(rules, BROADCAST_RULES), "short")
        .where("digest = rule_digest")
        .groupBy("asked_id", "asked_url")
        .agg(
            F.max(
                F.struct(
                    length.alias("length"),
                    F.length("rule_host").alias("host_length"),
                    F.col("rule_verdict").alias("verdict"),
                    F.concat("rule_host", "rule_path").alias("rule"),
                )
            ).alias("best")
        )
    )
    same = F.col("page_id").eqNullSafe(F.col("asked_id")) & (F.col("url") == F.col("asked_url"))
    return source.join(best, same, "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
