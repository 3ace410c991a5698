"""URL filters: expressions of host suffix and path prefix join rules on short hash prefixes.

A rule is a host with its path (``example.org/es/``) and a verdict. Every URL is expanded into the expressions that could
be a rule: suffixes of its host at label borders, times prefixes of its path, but only of the shapes (labels in the host,
characters in the path) that some rule has. Expressions meet rules on the first bytes of their digest; the full digest
confirms a match, and the longest rule wins. Only distinct URLs are expanded, so a URL that a third of all rows share is
judged once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billquarry.llm.shared import stash

#: Hexadecimal digits of the digest that rules and expressions are joined on.
PREFIX = 8


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.encode(F.concat(host, path), "UTF-8"), 256)


def _labels(host: Column) -> Column:
    return F.size(F.split(host, r"\."))


def judge(pages: DataFrame, rules: DataFrame, otherwise: str = "allow", url: str = "url") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules``: ``host``, ``path``, ``verdict``; a rule fits its host and all subdomains, where the URL's path starts with
    the rule's. Of those that fit, the longest host and path together wins, then the longer host, then a block. Without
    a fitting rule ``rule`` is null and the verdict is ``otherwise``. A null URL, or one without ``://``, has an empty
    host and path. All rows of ``pages`` stay; columns of the four names are replaced. Rules with a null part fit nothing.
    """
    kept = [F.col("`" + c.replace("`", "``") + "`") for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    value = F.col("`" + url.replace("`", "``") + "`")
    known = rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL").select(
        F.concat("host", "path").alias("rule"), F.length("host").alias("host_length"), "verdict", _digest(F.col("host"), F.col("path")).alias("rule_digest"),
        _labels(F.col("host")).alias("labels"), F.length("path").alias("characters"),
    )
    # as many shapes as there are pairs of a label count and a path length, whatever the number of rules
    shapes = sorted((r.labels, r.characters) for r in known.select("labels", "characters").distinct().collect())
    # places, not URLs, are what rules are about: many URLs share one
    places = pages.select(host_of(value).alias("host"), path_of(value).alias("path")).distinct()
    every = F.array(*[F.struct(F.lit(n).alias("labels"), F.lit(c).alias("characters")) for n, c in shapes]) if shapes else F.expr("CAST(ARRAY() AS ARRAY<STRUCT<labels: INT, characters: INT>>)")
    labels, characters = _labels(F.col("host")), F.length("path")
    shaped = places.select("host", "path", F.explode(F.filter(every, lambda s: (s["labels"] <= labels) & (s["characters"] <= characters))).alias("s"))
    expressions = shaped.select(
        "host", "path", _digest(F.expr("substring_index(host, '.', -s.labels)"), F.expr("substring(path, 1, s.characters)")).alias("digest")
    ).withColumn("short", F.substring("digest", 1, PREFIX))
    met = expressions.join(known.withColumn("short", F.substring("rule_digest", 1, PREFIX)), "short").where(F.col("digest") == F.col("rule_digest"))
    first = F.struct(F.length("rule"), "host_length", "verdict")  # block comes after allow
    best = met.groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), first).alias("best"))
    fitting = best.select(F.col("host").alias("fit_host"), F.col("path").alias("fit_path"), F.col("best.rule").alias("fit_rule"), F.col("best.verdict").alias("fit_verdict"))
    fitting = stash(fitting, "fitting-rules")  # the join below is then fed by shuffles alone, and a hot place can be split
    row = pages.select(F.struct(*kept).alias("row") if kept else F.lit(None).alias("row"), host_of(value).alias("host"), path_of(value).alias("path"))
    joined = row.join(fitting, (F.col("host") == F.col("fit_host")) & (F.col("path") == F.col("fit_path")), "left")
    return joined.select(
        *[F.col("row")[c].alias(c) for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")],
        "host", "path", F.col("fit_rule").alias("rule"), F.coalesce("fit_verdict", F.lit(otherwise)).alias("verdict"),
    )
