"""URL filters: host-suffix and path-prefix expressions met with rules by short hash prefix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import BROADCAST_ROWS, ascii_lower

#: Everything after the first "://": the host up to / ? or #, then the path up to ? or #.
URL_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Hex digits of a digest that the equi-join uses; the rest is confirmed on the joined rows.
SHORT = 8


def with_url_parts(df: DataFrame, url: str = "url", host: str = "host", path: str = "path") -> DataFrame:
    """Add host (A-Z lower-cased) and path; both are empty for a null url or one without ``://``."""
    text = F.coalesce(F.col(url), F.lit(""))
    return df.withColumn(host, ascii_lower(F.regexp_extract(text, URL_PARTS, 1))).withColumn(path, F.regexp_extract(text, URL_PARTS, 2))


def _labels(host):
    return F.size(F.split(host, r"\."))


def judge_urls(urls: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """Give each row of ``urls`` the verdict of the longest rule that fits it.

    rules: host, path, verdict; a rule fits its host and all subdomains if the url's path starts
    with the rule's path. The longest host + path wins; then the longer host, then the greater
    rule text, then the greater verdict ("block" over "allow").
    Returns key, host, path, rule (host + path of the winner, else null), verdict (else ``default``).

    Null urls and urls without ``://`` have an empty host and path and meet no rule; repeated rows
    and null keys are each judged on their own; other columns of ``urls`` are ignored; no rules:
    every verdict is the default.

    One row per (suffix, prefix) is formed only for label counts and path lengths that rules have.
    The expanded rows are folded per url before the only shuffle, so a common host costs nothing
    extra. Rules are broadcast if they are at most BROADCAST_ROWS, else joined by shuffle, where
    AQE may split a common prefix.
    """
    rules = rules.select(ascii_lower(F.coalesce("host", F.lit(""))).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), F.col("verdict").alias("rule_verdict")).filter(F.col("rule_host") != "").distinct()
    shapes = rules.select(_labels(F.col("rule_host")).alias("labels"), F.length("rule_path").alias("n")).distinct().limit(BROADCAST_ROWS + 1).collect()
    few = len(shapes) <= BROADCAST_ROWS
    depths = sorted({r["labels"] for r in shapes})
    lengths = sorted({r["n"] for r in shapes})

    rows = with_url_parts(urls.select(F.col(key).alias("_key"), F.col(url).alias("url"))).drop("url").withColumn("_row", F.monotonically_increasing_id())
    parts = F.split("host", r"\.")
    all_depths = F.array(*[F.lit(d) for d in depths]).cast("array<int>") if few else F.sequence(F.lit(1), F.size(parts))
    all_lengths = F.array(*[F.lit(n) for n in lengths]).cast("array<int>") if few else F.sequence(F.lit(0), F.length("path"))
    suffixes = F.transform(F.filter(all_depths, lambda d: d <= F.size(parts)), lambda d: F.array_join(F.slice(parts, -d, d), "."))
    prefixes = F.transform(F.filter(all_lengths, lambda n: n <= F.length("path")), lambda n: F.col("path").substr(F.lit(1), n))
    expressions = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    digest = F.sha2(F.col("expression"), 256)
    expanded = (
        rows.select("*", F.explode_outer(expressions).alias("expression"))
        .withColumn("digest", digest)
        .withColumn("short", F.substring("digest", 1, SHORT))
        .drop("expression")
    )
    listed = (
        rules.withColumn("rule", F.concat("rule_host", "rule_path"))
        .withColumn("rule_digest", F.sha2(F.col("rule"), 256))
        .withColumn("short", F.substring("rule_digest", 1, SHORT))
        .withColumn("weight", F.struct(F.length("rule").alias("n"), F.length("rule_host").alias("h"), F.col("rule"), F.col("rule_verdict")))
        .select("short", "rule_digest", "weight")
    )
    if len(rules.limit(BROADCAST_ROWS + 1).take(BROADCAST_ROWS + 1)) <= BROADCAST_ROWS:
        listed = F.broadcast(listed)
    met = expanded.join(listed, "short", "left").withColumn("weight", F.when(F.col("digest") == F.col("rule_digest"), F.col("weight")))
    best = met.groupBy("_row", "_key", "host", "path").agg(F.max("weight").alias("weight"))
    return best.select(
        F.col("_key").alias(key), "host", "path", F.col("weight.rule").alias("rule"), F.coalesce("weight.rule_verdict", F.lit(default)).alias("verdict")
    )
