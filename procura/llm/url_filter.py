"""URL filter: rules indexed by their rarest literal token."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii

RULE_SCHEMA = "action string, host string, path string"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): the host after the first ``://`` up to ``/ ? #``, A-Z
    lower-cased; the path from there up to ``? #``. NULL or no ``://``: both ''."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, url.substr(at + F.lit(3), F.length(url))), F.lit(""))
    return (lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0)),
            F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def _quoted(text: Column) -> Column:
    """``text`` as a literal inside a Java regular expression; ``*`` matches anything."""
    escaped = F.regexp_replace(text, r"([^\p{L}\p{N}_/*-])", r"\\$1")
    return F.regexp_replace(escaped, r"\*+", ".*")


def compile_rules(rules: DataFrame) -> DataFrame:
    """(action, host, path) -> rule text, regular expression and literal tokens.

    A token is a whole host label (``h:example``) or a path segment closed on
    both sides (``p:en`` of ``/en/``): text that every matching URL has as a
    token of its own. A rule without any (an empty host with path ``/``) gets
    the token ``*``, which every URL has."""
    host, path = lower_ascii(F.col("host")), F.coalesce(F.col("path"), F.lit(""))
    labels = F.transform(F.filter(F.split(host, r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("h:"), x))
    inner = F.regexp_extract(path, r"^/(.*)/[^/]*$", 1)
    segments = F.transform(F.filter(F.split(inner, "/"), lambda x: (x != "") & ~x.contains("*")),
                           lambda x: F.concat(F.lit("p:"), x))
    tokens = F.array_distinct(F.concat(labels, segments))
    pattern = F.concat(F.when(host == "", F.lit("^[^/]*")).otherwise(F.concat(F.lit(r"^(?:[^/]*\.)?"), _quoted(host))),
                       _quoted(path))
    return rules.select(
        F.concat(host, path).alias("rule"), F.col("action"), pattern.alias("pattern"),
        F.when(F.size(tokens) > 0, tokens).otherwise(F.array(F.lit("*"))).alias("tokens")).distinct()


def _url_tokens(host: Column, path: Column) -> Column:
    labels = F.transform(F.filter(F.split(host, r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("h:"), x))
    segments = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.concat(F.lit("p:"), x))
    return F.array_distinct(F.concat(labels, segments, F.array(F.lit("*"))))


def filter_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow",
                payload: tuple[str, ...] = ()) -> DataFrame:
    """Judge every URL: host, path, the winning rule (longest text; then ``block``
    before ``allow``, then code point order; NULL if none) and the verdict.

    ``rules`` has (action, host, path). A rule fits its host and all
    subdomains if the URL's path starts with the rule's path; ``*`` in a path
    matches anything.

    Each rule is filed under the one of its tokens that the fewest distinct
    sites of the table have (ties: the longer token). URLs are reduced to
    distinct (host, path) pairs; a pair looks up the rules filed under its
    tokens and runs only their regular expressions.

    The rule table is joined without a hint: Spark broadcasts it only when its
    measured size allows, else the lookup is a shuffle join whose hot tokens
    AQE splits. ``payload`` columns pass through.

    Cases: NULL, empty or scheme-less URLs have empty host and path and get the
    default unless a host-less rule exists. Repeated rows are judged alike.
    With no rules everything gets the default; no pages give no rows."""
    host, path = split_url(F.col(url_col))
    rows = pages.select(*payload, host.alias("host"), path.alias("path"))
    sites = rows.select("host", "path").distinct()
    compiled = compile_rules(rules)

    filed = compiled.select("rule", "action", "pattern", F.explode("tokens").alias("token"))
    wanted = filed.select("token").distinct()
    seen = sites.select(F.explode(_url_tokens(F.col("host"), F.col("path"))).alias("token")) \
        .join(wanted, "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    index = filed.join(seen.select(F.concat(F.lit("="), "token").alias("t"), "n"),
                       F.concat(F.lit("="), "token") == F.col("t"), "left") \
        .groupBy("rule", "action", "pattern") \
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), (-F.length("token")).alias("l"),
                            F.col("token"))).alias("rarest")) \
        .select("rule", "action", "pattern", F.col("rarest.token").alias("token"))

    hits = sites.select("host", "path", F.explode(_url_tokens(F.col("host"), F.col("path"))).alias("token")) \
        .join(index, "token") \
        .filter(F.expr("concat(host, path) rlike pattern"))
    best = hits.groupBy("host", "path").agg(F.min(F.struct(
        (-F.length("rule")).alias("l"), (F.col("action") != "block").alias("a"), F.col("rule"),
        F.col("action"))).alias("best"))
    verdicts = best.select(F.concat("host", "path").alias("site"),
                           F.col("best.rule").alias("rule"), F.col("best.action").alias("verdict"))
    return rows.withColumn("site", F.concat("host", "path")).join(verdicts, "site", "left") \
        .select(*payload, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
