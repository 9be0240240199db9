"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a regular expression over ``host || path`` with the literal tokens
(runs of ``[a-z0-9]``) that every URL it fits must contain.  The frequency of
those tokens over all URLs decides under which one (the rarest; ties by name)
each rule is indexed.  A URL's tokens fetch candidate rules from the index by
an equi-join and only the candidates run their expression.  A rule without a
literal token is a candidate for every URL.

Verdict: the longest fitting host rule decides; without one a URL is blocked
if any block pattern fits, else allowed.

Everything is DataFrame expressions.  The index has one row per rule; up to
``BROADCAST_RULES`` rules it is broadcast, beyond that it is joined by shuffle,
where the skew join splits a token that very many URLs hold.

Defined cases: a null URL, or one without ``://``, has empty host and path;
repeated rows and null ids give one row each; no rows give no rows; other
columns are not looked at.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


BROADCAST_RULES = 20_000


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str
    tokens: tuple[str, ...]
    verdict: str
    host_rule: bool


def host_rule(verdict: str, host: str, path: str) -> Rule:
    """Fits ``host`` and its subdomains if the URL's path starts with ``path``."""
    pattern = r"^([^/]*\.)?" + re.sub(r"([^A-Za-z0-9/_-])", r"\\\1", host + path)
    # a path's last token may go on in the URL: only tokens with both ends in the rule count
    tokens = re.findall(r"[a-z0-9]+", host) + re.findall(r"(?<![a-z0-9])[a-z0-9]+(?=[^A-Za-z0-9])", path)
    return Rule(host + path, pattern, tuple(dict.fromkeys(tokens)), verdict, True)


def word_rule(verdict: str, word: str) -> Rule:
    """Fits a URL with ``word`` as a whole token of its host or path."""
    return Rule(word, f"(^|[^a-z0-9]){word}([^a-z0-9]|$)", (word,), verdict, False)


#: The host rules of the query's contract.
HOST_RULES = (
    host_rule("allow", "com", "/"),
    host_rule("block", "example.com", "/en/"),
    host_rule("allow", "www.example.com", "/en/"),
    host_rule("block", "net", "/es/"),
    host_rule("block", "net", "/fr/"),
)
BLOCKED_WORDS = ("bet", "bets", "betting", "casino", "pills", "poker", "porn", "viagra", "warez", "xxx")
RULES = HOST_RULES + tuple(word_rule("block", w) for w in BLOCKED_WORDS)


def host_and_path(url: Column) -> tuple[Column, Column]:
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, parts, 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, parts, 2), F.lit(""))


def url_tokens(host: Column, path: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(
        F.concat(host, F.lit(" "), F.translate(path, UPPER, LOWER)), F.lit("([a-z0-9]+)"), F.lit(1)))


def rule_index(spark: SparkSession, rules, urls: DataFrame) -> DataFrame:
    """One row per rule, keyed by its rarest literal token over ``urls`` ('' if it has none)."""
    frame = spark.createDataFrame(
        [(i, r.name, r.pattern, list(r.tokens) or [""], r.verdict, r.host_rule) for i, r in enumerate(rules)],
        "rule_id int, rule string, pattern string, literals array<string>, rule_verdict string, host_rule boolean")
    literals = frame.select("rule_id", F.explode("literals").alias("token"))
    wanted = spark.createDataFrame([(t,) for t in sorted({t for r in rules for t in r.tokens})], "token string")
    seen = (urls.select(F.explode("tokens").alias("token"))
            .join(_small(wanted, rules), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n")))
    chosen = (literals.join(seen, "token", "left")
              .groupBy("rule_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("best"))
              .select("rule_id", F.col("best.token").alias("token")))
    return _small(chosen.join(frame.drop("literals"), "rule_id"), rules)


def _small(df: DataFrame, rules) -> DataFrame:
    """A table with at most a few rows per rule: broadcast if there are few rules."""
    return F.broadcast(df) if len(rules) <= BROADCAST_RULES else df


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, pattern_rule) per row of ``pages(page_id, url)``."""
    spark = pages.sparkSession
    host, path = host_and_path(F.col("url"))
    urls = (pages.select("page_id", host.alias("host"), path.alias("path"))
            .withColumn("tokens", url_tokens(F.col("host"), F.col("path"))))
    index = rule_index(spark, rules, urls)
    # the empty token gives every URL a row of its own and fetches the rules without a literal
    rows = urls.withColumn("row", F.monotonically_increasing_id()).select(
        "row", "page_id", "host", "path",
        F.explode(F.concat(F.array(F.lit("")), F.col("tokens"))).alias("token"))
    tried = rows.join(index, "token", "left")
    fits = F.expr("pattern IS NOT NULL AND regexp_like(concat(host, path), pattern)")
    best = lambda mine: F.max(F.when(mine & F.col("fits"), F.struct(
        F.length("rule").alias("chars"), F.col("rule").alias("rule"), F.col("rule_verdict").alias("verdict"))))
    found = (tried.withColumn("fits", fits).groupBy("row", "page_id", "host", "path")
             .agg(best(F.col("host_rule")).alias("host_hit"),
                  best(~F.col("host_rule") & (F.col("rule_verdict") == "block")).alias("word_hit")))
    return found.select(
        "page_id", "host", "path", F.col("host_hit.rule").alias("rule"),
        F.coalesce(F.col("host_hit.verdict"), F.col("word_hit.verdict"), F.lit("allow")).alias("verdict"),
        F.col("word_hit.rule").alias("pattern_rule"))


_SQL_WORDS = ", ".join(f"('{w}')" for w in BLOCKED_WORDS)
URL_SQL = rf"""
WITH u AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
r(verdict, rhost, rpath) AS (VALUES
  ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
  ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
w(word) AS (VALUES {_SQL_WORDS}),
hit AS (
  SELECT *,
    (SELECT max(struct_pack(n := length(rhost || rpath), rule := rhost || rpath, verdict := r.verdict)) FROM r
     WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) AS best,
    (SELECT max(struct_pack(n := length(word), rule := word)) FROM w
     WHERE regexp_matches(host || path, '(^|[^a-z0-9])' || word || '([^a-z0-9]|$)')) AS word
  FROM u)
SELECT page_id, host, path, best.rule AS rule,
       coalesce(best.verdict, CASE WHEN word IS NOT NULL THEN 'block' END, 'allow') AS verdict,
       word.rule AS pattern_rule
FROM hit
"""
