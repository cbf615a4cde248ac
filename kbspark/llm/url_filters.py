"""URL filters: each URL is expanded into host-suffix and path-prefix expressions, which meet the rules on short hash prefixes; full digests then confirm, and the longest rule wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RULES_DDL = "host string, path string, verdict string"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hexadecimal digits of a digest that the join is made on (32 bits).
PREFIX_DIGITS = 8


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; empty for null or without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty for null or without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, RULES_DDL)


def judge_paths(places: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, verdict) of the distinct places that a rule fits.

    Suffixes are taken with as many labels, and prefixes with as many characters, as some rule has, so a place gives at most (different
    label counts) x (different path lengths) expressions, however long it is. These two sets of numbers are all that the driver sees.
    """
    # no host has over 127 labels that resolves; both sets are of small numbers whatever the number of rules
    shape = rules.select(F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("chars")).agg(F.collect_set("labels").alias("labels"), F.collect_set("chars").alias("chars")).first()
    labels, chars = sorted(shape["labels"]), sorted(shape["chars"])
    if not labels:
        return places.where("false").select("host", "path", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    keyed = rules.select(
        F.sha2(F.concat("host", "path"), 256).alias("rule_digest"), F.concat("host", "path").alias("rule"), F.length(F.concat("host", "path")).alias("rule_length"), (F.col("verdict") == "block").alias("blocks")
    ).withColumn("prefix", F.substring("rule_digest", 1, PREFIX_DIGITS))
    parts = F.split("host", r"\.")
    suffixes = F.array_compact(F.array(*[F.when(F.size(parts) >= k, F.substring_index("host", ".", -k)) for k in labels]))
    prefixes = F.array_compact(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in chars]))
    expressions = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    digests = places.select("host", "path", F.explode(expressions).alias("expression")).select("host", "path", F.sha2("expression", 256).alias("digest"))
    met = digests.withColumn("prefix", F.substring("digest", 1, PREFIX_DIGITS)).join(keyed, "prefix").where("digest = rule_digest")
    best = met.groupBy("host", "path").agg(F.max(F.struct("rule_length", "blocks", "rule")).alias("best"))
    return best.select("host", "path", F.col("best.rule").alias("rule"), F.when(F.col("best.blocks"), "block").otherwise("allow").alias("verdict"))


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict`` added (columns of these names are replaced).

    A rule (host, path, verdict) fits its host and all its subdomains where the URL's path starts with the rule's; the longest rule
    wins, a block before an allow of the same text. Without a fitting rule ``rule`` is null and the verdict ``default``. Null URLs and
    those without ``://`` have an empty host and path and so get the default. Every row is kept, repeated ones too; an empty table
    gives none. Each different (host, path) is judged once, so repeated URLs cost one row per map task; rules are broadcast only where
    Spark's size limit allows, and else joined on their short prefixes.
    """
    placed = pages.drop("host", "path", "rule", "verdict").withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))})
    judged = judge_paths(placed.select("host", "path").distinct(), rules)
    # the third key gives both sides an exchange of their own, so that adaptive execution can split a place with very many rows
    judged = judged.withColumn("__path_chars", F.length("path"))
    out = placed.withColumn("__path_chars", F.length("path")).join(judged, ["host", "path", "__path_chars"], "left")
    kept = [c for c in placed.columns]
    return out.select(*kept, "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
