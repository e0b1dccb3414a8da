"""Verdicts on URLs by rules over host suffixes and path prefixes.

A rule is a host and the beginning of a path. Every URL is expanded into the
expressions that any rule could equal: a suffix of its host's labels with a
prefix of its path. Expressions and rules meet in an equality join on a short
hash prefix; the full digest confirms a meeting, and the longest rule wins.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALLOW, BLOCK = "allow", "block"
# Hexadecimal digits of the digest that are joined on.
SHORT = 8

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 1),
                       string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 2)


def _labels(host: Column) -> Column:
    return F.size(F.split(host, r"\."))


def _expression(host: Column, path: Column) -> Column:
    # A host holds no slash, so the first one parts the two.
    return F.concat(host, F.lit("/"), path)


def _digest(expression: Column) -> Column:
    return F.sha2(expression.cast("binary"), 256)


def _prepared(rules: DataFrame) -> DataFrame:
    """The rules with their digest, shape and precedence; of equal rules block wins."""
    host = F.translate("host", string.ascii_uppercase, string.ascii_lowercase)
    return (
        rules.select(host.alias("host"), "path", "verdict").dropna()
        .groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
        .select(
            F.concat("host", "path").alias("rule"), "verdict",
            _digest(_expression(F.col("host"), F.col("path"))).alias("digest"),
            _labels(F.col("host")).alias("labels"), F.length("path").alias("reach"),
            F.length("host").alias("width")))


def judged(pages: DataFrame, rules: DataFrame, id_column: str = "page_id",
           url_column: str = "url", default: str = ALLOW, short: int = SHORT) -> DataFrame:
    """One row per input row: id, host, path, rule, verdict.

    ``rules`` has the columns host, path, verdict (``allow`` or ``block``). A
    rule fits its host and all subdomains where the URL's path starts with the
    rule's, character by character. The longest rule wins (characters of host
    and path together), then the one with the longer host; where one host and
    path has both verdicts, block wins. Without a fitting rule, ``rule`` is
    null and the verdict ``default``: these are filters, so what no rule names
    passes.

    A null URL, an empty one and one without ``://`` have an empty host and
    path, which no rule with a host fits. Ports and user names are part of the
    host, as written. Rules with a null in any column are left out; no rules
    leave the default everywhere. Null and repeated ids each keep their row.
    An empty table gives an empty result. Other columns are not read.

    URLs alike in host and as much of the path as any rule reads are judged
    once, so a site with a third of all rows is one row of the search; the way
    back is an equality join whose hot keys adaptive execution splits. Which
    side is broadcast is left to Spark, which checks sizes: rules may be many.
    What the driver gets is the rules' distinct shapes (labels, path length).
    """
    rules = _prepared(rules)
    shapes = [(r["labels"], r["reach"]) for r in rules.select("labels", "reach").distinct().collect()]
    reach = max((length for _, length in shapes), default=0)
    url = F.col(url_column)
    urls = pages.select(F.col(id_column).alias("_id"), host_of(url).alias("host"), path_of(url).alias("path")
                        ).withColumn("head", F.substring("path", 1, reach))
    if not shapes:
        return urls.select(F.col("_id").alias(id_column), "host", "path",
                           F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))

    forms = F.array(*[F.struct(F.lit(k).alias("labels"), F.lit(n).alias("reach")) for k, n in sorted(shapes)])
    fitting = F.filter(forms, lambda s: (s["labels"] <= F.col("labels")) & (s["reach"] <= F.length("head")))
    expressions = (
        urls.select("host", "head").distinct()
        .withColumn("labels", _labels(F.col("host")))
        .select("host", "head", F.explode(fitting).alias("form"))
        .select("host", "head", _expression(
            F.call_function("substring_index", F.col("host"), F.lit("."), -F.col("form.labels")),
            F.substring("head", F.lit(1), F.col("form.reach"))).alias("expression"))
        .withColumn("short", F.substring(_digest(F.col("expression")), 1, short)))

    met = expressions.join(rules.withColumn("short", F.substring("digest", 1, short)), "short")
    confirmed = met.filter(_digest(F.col("expression")) == F.col("digest"))
    precedence = F.struct(F.length("rule"), "width", "rule")
    best = confirmed.groupBy("host", "head").agg(
        F.max_by(F.struct("rule", "verdict"), precedence).alias("best"))
    return urls.join(best, ["host", "head"], "left").select(
        F.col("_id").alias(id_column), "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
