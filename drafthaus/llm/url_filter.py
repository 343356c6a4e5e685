"""URL filter lists: host-suffix and path-prefix expressions, joined on short hash prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, small

#: Rules that may be broadcast (each under a kilobyte); beyond that both sides are shuffled.
BROADCAST_RULES = 100_000
#: Hexadecimal digits of a SHA-256 on which expressions and rules meet.
SHORT = 8


def url_host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_after(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path).cast("binary"), 256)


def url_filter(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """The rule that judges each url.  rules: host, path, verdict ('allow' or 'block').

    Returns id_col, host, path, rule (its host and path as one string, else null) and verdict (the rule's, else
    default), one row per row of pages.  A rule fits its host and all subdomains if the url's path starts with the
    rule's path; of several the longest string wins, of equally long ones the longer host, and if two rules have the
    same host and path, 'block'.

    A null url, or one without '://', has an empty host and path, as has an empty string; an empty host fits only a
    rule for the empty host.  Rules with a null host are ignored, a null path is empty, rule hosts are lower-cased.
    Repeated rows come back as often.  Other columns of pages are not read.  Empty tables work: no rules means the
    default for all.

    A url has an expression for each suffix of its host.  Those that meet a rule's host are expanded by the path prefixes
    of the lengths that this host's rules have, and these meet the rules, so every fitting rule is found.  Both joins
    are on short hashes, confirmed by the full digest.  Equal rows are grouped before anything is shuffled.
    """
    if default not in ("allow", "block"):
        raise ValueError("default: allow or block")
    rules = rules.where("host is not null").select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    most = rules.agg(F.max(F.size(F.split("host", r"\.", -1)))).first()[0] or 0
    lookup = rules.select(
        _digest(F.col("host"), F.col("path")).alias("full"), F.substring(_digest(F.col("host"), F.col("path")), 1, SHORT).alias("short"),
        F.struct(F.length(F.concat("host", "path")).alias("size"), F.length("host").alias("host_size"), (F.col("verdict") == "block").alias("block"), F.concat("host", "path").alias("rule")).alias("found"),
    )
    nothing = F.lit("")
    hosts = rules.groupBy(F.col("host").alias("rule_host")).agg(F.collect_set(F.length("path")).alias("sizes"))  # at most the longest rule's length
    hosts = hosts.select(_digest(F.col("rule_host"), nothing).alias("host_full"), F.substring(_digest(F.col("rule_host"), nothing), 1, SHORT).alias("host_short"), "sizes")

    urls = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).groupBy("id", "url").agg(F.count("*").alias("rows"))
    parsed = urls.withColumns({"host": url_host(F.col("url")), "path": url_path(F.col("url"))})
    labels = F.split("host", r"\.", -1)
    counts = F.slice(F.sequence(F.lit(1), F.size(labels)), 1, most)
    parsed = parsed.withColumn("labels", F.explode_outer(counts))
    parsed = parsed.withColumn("suffix", F.array_join(F.slice(labels, F.size(labels) - F.col("labels") + 1, F.col("labels")), ".")).drop("labels")
    parsed = parsed.withColumn("whole_host", _digest(F.col("suffix"), nothing)).withColumn("host_short", F.substring("whole_host", 1, SHORT))
    known = parsed.join(small(hosts, BROADCAST_RULES), "host_short", "left")
    lengths = F.when(F.col("whole_host") == F.col("host_full"), F.filter("sizes", lambda n: n <= F.length("path")))
    expanded = known.withColumn("chars", F.explode_outer(lengths))
    expression = expanded.withColumn("whole", F.when(F.col("chars").isNotNull(), _digest(F.col("suffix"), F.substring(F.col("path"), F.lit(1), F.col("chars"))))).withColumn("short", F.substring("whole", 1, SHORT))
    joined = expression.select("id", "url", "rows", "host", "path", "whole", "short").join(small(lookup, BROADCAST_RULES), "short", "left")
    confirmed = F.when(F.col("whole") == F.col("full"), F.col("found"))
    best = joined.groupBy("id", "url", "rows", "host", "path").agg(F.max(confirmed).alias("best"))
    out = best.select(
        F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce(F.when(F.col("best.block"), F.lit("block")).when(F.col("best").isNotNull(), F.lit("allow")), F.lit(default)).alias("verdict"), F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("_copy"),
    )
    return out.drop("_copy")
