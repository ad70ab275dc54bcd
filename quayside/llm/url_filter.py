"""URL filters: host-suffix and path-prefix expressions, hash-prefix join, digest check.

Each URL is expanded into every host suffix combined with every path prefix
whose length some rule has.  Expressions and rules meet in an equi-join on the
first bytes of their SHA-256 digests; the full digests then confirm the match,
and the longest matching rule decides.  Everything runs as DataFrame
expressions.

A rule fits its host and all subdomains, when the path starts with the rule's.
URLs are judged once per distinct (host, path), so a page that is listed very
often costs one expansion.

The rule table is broadcast when it has at most ``BROADCAST_RULES`` rows, each
under ``RULE_CHARS`` characters (so under 48 MB); a longer table is joined by
shuffle, where adaptive execution splits hash prefixes that many URLs share.

Defined results: a null URL, or one without ``://``, has an empty host and
path, no rule and the default verdict; rules with a null part are ignored;
equal rules with different verdicts resolve to ``block``, and of fitting rules of
one length the last in order of host and path counts; repeated rows are judged each; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PREFIX_BYTES = 4
BROADCAST_RULES, RULE_CHARS = 20_000, 2_400
RULE_SCHEMA = "host string, path string, verdict string"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_suffixes(host: Column) -> Column:
    """``a.b.c`` gives ``a.b.c``, ``b.c`` and ``c``; an empty host gives none."""
    labels = F.split(host, r"\.", -1)
    every = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(every)


def match_rules(urls: DataFrame, rules: DataFrame, *, url_col: str = "url", default: str = "allow") -> DataFrame:
    """``urls`` with host, path, rule (host and path of the winner) and verdict, in struct column ``judged``."""
    site, key = "__url_filter_site", "__url_filter_key"
    named = rules.select("host", "path", "verdict").dropna().groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    lengths = [r[0] for r in named.select(F.char_length("path").alias("n")).distinct().orderBy("n").collect()]  # at most one for each possible path length
    rule_rows = named.select(
        F.concat("host", "path").alias("rule"),
        "verdict",
        F.sha2(F.concat_ws("\n", "host", "path"), 256).alias("rule_digest"),
    ).withColumn("short", F.substring("rule_digest", 1, 2 * PREFIX_BYTES))
    n_rules, widest = rule_rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.char_length("rule")), F.lit(0))).first()

    judged = urls.select(F.struct(host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path")).alias(site))
    sites = judged.distinct().withColumn("host", F.col(f"{site}.host")).withColumn("path", F.col(f"{site}.path"))
    sized = F.array(*[F.lit(n) for n in lengths]).cast("array<int>")
    prefixes = F.transform(F.filter(sized, lambda n: n <= F.char_length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    expressions = (
        sites.withColumn("suffix", F.explode(host_suffixes(F.col("host"))))
        .withColumn("prefix", F.explode(prefixes))
        .withColumn("digest", F.sha2(F.concat_ws("\n", "suffix", "prefix"), 256))
        .withColumn("short", F.substring("digest", 1, 2 * PREFIX_BYTES))
        .select(site, "digest", "short")
    )
    small = n_rules <= BROADCAST_RULES and widest <= RULE_CHARS
    found = expressions.join(F.broadcast(rule_rows) if small else rule_rows, "short").where(F.col("digest") == F.col("rule_digest"))
    best = found.groupBy(site).agg(F.max(F.struct(F.char_length("rule").alias("n"), "rule", "verdict")).alias("best"))
    best = best.select(F.col(site).alias(key), "best")
    out = urls.withColumn(site, F.struct(host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path")))
    out = out.join(best, F.col(site) == F.col(key), "left")
    return out.withColumn(
        "judged",
        F.struct(F.col(f"{site}.host").alias("host"), F.col(f"{site}.path").alias("path"), F.col("best.rule").alias("rule"), F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict")),
    ).drop(site, key, "best")
