"""Allow and block rules for URLs, matched by hashed host-suffix and path-prefix expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mileglass.llm.text import free_name, lower_ascii

ALLOW, BLOCK = "allow", "block"
PREFIX_DIGITS = 8  # hexadecimal digits of the digest that are joined on


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://``."""
    return F.coalesce(lower_ascii(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str]]) -> DataFrame:
    """Rules given as (verdict, host and path), such as ``("block", "net/")``, as a table (rule, verdict)."""
    return spark.createDataFrame([(rule, verdict) for verdict, rule in rules], "rule string, verdict string")


def _digested_rules(rules: DataFrame) -> DataFrame:
    """One row per rule text: its shape, its digest, and the verdict (block beats allow for the same text)."""
    at = F.instr("rule", "/")
    host = F.when(at > 0, F.substring("rule", F.lit(1), at - 1)).otherwise(F.col("rule"))
    path = F.when(at > 0, F.substring("rule", at, F.length("rule"))).otherwise(F.lit(""))
    return (rules.filter(F.col("rule").isNotNull() & F.col("verdict").isin(ALLOW, BLOCK))
            .select("rule", "verdict", lower_ascii(host).alias("host"), path.alias("path"))
            .groupBy("host", "path").agg(F.max("verdict").alias("verdict"), F.min("rule").alias("rule"))
            .select("rule", "verdict", F.size(F.split("host", r"\.")).alias("labels"),
                    F.length("path").alias("path_len"), _digest(F.col("host"), F.col("path")).alias("digest"))
            .withColumn("short", F.substring("digest", 1, PREFIX_DIGITS)))


def _digest(host: Column, path: Column) -> Column:
    # Hosts hold no slash and a path starts with one, so the joined text has one reading only.
    return F.sha2(F.concat(host, path), 256)


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = ALLOW) -> DataFrame:
    """``pages`` with the columns host, path, rule and verdict (replacing columns of these names).

    A rule fits its host and all subdomains if the path of the URL starts with the rule's path.  The longest
    fitting rule wins; among equally long ones the longer host, then block.  Without a fitting rule, ``rule`` is
    NULL and the verdict is ``default``.

    Every distinct URL is expanded once into its host suffixes and path prefixes, but only in the shapes (labels
    of the host, characters of the path) that some rule has.  The expressions meet the rules in an equi-join on
    the first digits of their digests; the full digest is compared afterwards.  The rules are joined like any
    table, so their number is not limited.  A URL held by a third of all rows is judged once; the join back to the
    pages can split its rows.

    NULL, empty and unparsable URLs have an empty host and path and get the default.  Repeated rows stay repeated.
    Rules that are NULL or whose verdict is neither allow nor block are ignored.  Empty tables give empty results.
    """
    known = _digested_rules(rules)
    # Pairs of small numbers: there are no more than labels times characters of the longest rule.
    shapes = [(r.labels, r.path_len) for r in known.select("labels", "path_len").distinct().collect()]
    urls = (pages.select(F.col(url).alias("u")).filter(F.col("u").isNotNull()).distinct()
            .select("u", url_host(F.col("u")).alias("host"), url_path(F.col("u")).alias("path"))
            .withColumn("parts", F.split("host", r"\.")))
    shape_rows = F.array(*[F.struct(F.lit(n).alias("labels"), F.lit(k).alias("path_len")) for n, k in sorted(shapes)])
    if not shapes:
        best = pages.sparkSession.createDataFrame([], "u string, found struct<rule:string,verdict:string>")
    else:
        suffix = F.array_join(F.slice("parts", F.size("parts") - F.col("s.labels") + 1, F.col("s.labels")), ".")
        expressions = (
            urls.select("u", "parts", "path", F.explode(shape_rows).alias("s"))
            .filter((F.size("parts") >= F.col("s.labels")) & (F.length("path") >= F.col("s.path_len")))
            .select("u", "s.labels", "s.path_len",
                    _digest(suffix, F.substring("path", F.lit(1), F.col("s.path_len"))).alias("url_digest"))
            .withColumn("short", F.substring("url_digest", 1, PREFIX_DIGITS)))
        rank = F.struct((F.length("rule")).alias("length"), F.col("known.labels").alias("labels"),
                        (F.col("verdict") == BLOCK).alias("blocks"), F.col("rule").alias("rule"),
                        F.col("verdict").alias("verdict"))
        best = (expressions.alias("e").join(known.alias("known"), "short")
                .filter(F.col("url_digest") == F.col("digest"))
                .groupBy("u").agg(F.max(rank).alias("found")))
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    key, found = free_name(kept, "__u"), free_name(kept, "found")
    judged = pages.select(*[F.col(f"`{c}`") for c in kept], F.col(url).alias(key),
                          url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    best = best.select(F.col("u").alias(f"{key}_other"), F.col("found").alias(found))
    return (judged.join(best, F.col(key) == F.col(f"{key}_other"), "left")
            .select(*[F.col(f"`{c}`") for c in kept], "host", "path", F.col(f"{found}.rule").alias("rule"),
                    F.coalesce(F.col(f"{found}.verdict"), F.lit(default)).alias("verdict")))
