"""URL filters by many pattern rules, of which each URL runs only a few.

A rule is written as in block lists: literal text, ``*`` for anything, ``^`` for a separator or the end, ``||`` at
the start for a host and all its subdomains, ``|`` at the start for the start of the URL. Words of a rule that
stand between separators are literal tokens: every URL that the rule fits has them. A rule is indexed by the
token that is rarest among all URLs. A URL's tokens fetch its candidate rules, and only these run their regular
expressions. Only DataFrame functions run on the executors.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doclake.sources.scratch import freeze


@dataclass(frozen=True)
class Rule:
    """``pattern`` as above. ``on``: ``place`` (host, A-Z lowered, and path) or ``url`` (whole, A-Z lowered).

    Of the rules that fit, the one of the highest ``level`` wins, then the longest pattern, then allow.
    """
    pattern: str
    action: str
    on: str = "url"
    level: int = 0


# Rules by host and path, which come before all others.
PLACE_RULES = [
    Rule("net/", "block", "place", 1),
    Rule("example.net/en/", "allow", "place", 1),
    Rule("example.com/de/", "block", "place", 1),
    Rule("org/fr/", "allow", "place", 1),
]
PATTERN_RULES = [
    Rule("||ads-track.", "block"), Rule(".ads-track.", "block"), Rule("/ads/", "block"), Rule("^utm_campaign=", "block"),
    Rule("||doubleclick.", "block"), Rule("/track/*pixel^", "block"), Rule("^affiliate_id=", "block"),
    Rule("||casino*.example.", "block"), Rule("/login^", "block"), Rule("/wp-admin/", "block"),
    Rule("/robots.txt^", "allow"), Rule("||docs.", "allow"),
]


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered; empty without ``://``."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def regex(rule: Rule) -> str:
    """The rule as a regular expression that is searched in its text."""
    pattern = rule.pattern
    if rule.on == "place":
        return "(?s)^(?:[^/]*\\.)?" + re.escape(pattern)
    head = ""
    if pattern.startswith("||"):
        head, pattern = "^[^:/?#]*://(?:[^/?#]*\\.)?", pattern[2:]
    elif pattern.startswith("|"):
        head, pattern = "^", pattern[1:]
    parts = {"*": ".*", "^": "(?:[^0-9a-z_.%-]|$)"}
    return "(?s)" + head + "".join(parts.get(c) or re.escape(c) for c in pattern)


def literal_tokens(rule: Rule) -> list[str]:
    """Runs of letters and digits that stand as whole tokens in every text that the rule fits."""
    anchored = rule.on == "place" or rule.pattern.startswith("|")
    text = rule.pattern.lstrip("|").lower()
    out = []
    for m in re.finditer("[0-9a-z]+", text):
        left = text[m.start() - 1] if m.start() else ("/" if anchored else "*")
        right = text[m.end()] if m.end() < len(text) else "*"
        if left != "*" and right != "*" and ord(left) < 128 and ord(right) < 128:
            out.append(m[0])
    return out


def _tokens(text: Column) -> Column:
    return F.array_remove(F.array_distinct(F.split(text, "[^0-9a-z]+")), "")


def _values(rule: Rule) -> tuple:
    return rule.pattern, rule.action, rule.on, rule.level, regex(rule)


def indexed(spark: SparkSession, rules: list[Rule], urls: DataFrame) -> DataFrame:
    """``token, pattern, action, kind, level, regex`` of the rules with literal tokens, by the one rarest in ``urls`` (``tokens``).

    Tokens are counted and looked up by joins, so a list of many thousand rules is a table like any other.
    """
    rows = [(n, *_values(r), literal_tokens(r)) for n, r in enumerate(rules)]
    table = spark.createDataFrame(
        [r for r in rows if r[-1]],
        "no long, pattern string, action string, kind string, level int, regex string, tokens array<string>")
    literals = table.select("no", F.explode("tokens").alias("token"))
    counts = (urls.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
              .join(literals.select("token").distinct(), "token"))
    rarest = (literals.join(counts, "token", "left")
              .groupBy("no").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token")))
    # stored, so that its size is known where it is joined
    return freeze(table.drop("tokens").join(rarest, "no").drop("no"), "url_rules")


def judged(pages: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict, pattern`` for each row of ``pages`` (``page_id, url``).

    ``rule`` is the winning place rule, else null; ``pattern`` the winning rule of any kind; ``verdict`` is its
    action, allow without one. A null url, or one without ``://``, has an empty host and path and is allowed.
    Repeated urls are judged once and get the same verdict; urls of any length are read whole, other columns play no part. Rules without a literal token are fetched by every url.
    """
    rules = PLACE_RULES + PATTERN_RULES if rules is None else rules
    lower = F.translate(F.col("url"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    pages = pages.select("page_id", "url")
    # path keeps its case in the text of place rules, tokens are taken from the lowered url
    urls = (pages.filter(F.instr("url", "://") > 0).select("url").distinct()
            .select("url", F.concat(host(F.col("url")), path(F.col("url"))).alias("place"), lower.alias("lower")))
    urls = freeze(urls.withColumn("tokens", _tokens(F.col("lower"))), "urls")
    index = indexed(pages.sparkSession, rules, urls)
    found = urls.select("url", "place", "lower", F.explode("tokens").alias("token")).join(index, "token")
    # Rules without a token run on every url; only they stand in the plan as values.
    always = [r for r in rules if not literal_tokens(r)]
    columns = ["pattern", "action", "kind", "level", "regex"]
    candidates = found.select("url", "place", "lower", *columns)
    if always:
        every = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(columns, _values(r))]) for r in always])
        candidates = candidates.unionByName(
            urls.select("url", "place", "lower", F.explode(every).alias("r")).select("url", "place", "lower", "r.*"))
    # an expression is compiled once for all rows of a rule in a task
    candidates = candidates.sortWithinPartitions("regex")
    fits = F.expr("CASE WHEN kind = 'place' THEN place RLIKE regex ELSE lower RLIKE regex END")
    # the order of the wins as one comparable value
    order = F.struct("level", F.length("pattern").alias("n"), (F.col("action") == "allow").alias("allow"),
                     "pattern", "action", "kind")
    best = candidates.filter(fits).groupBy("url").agg(F.max(order).alias("best"))
    return (pages.join(best, "url", "left")
            .select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"),
                    F.when(F.col("best.kind") == "place", F.col("best.pattern")).alias("rule"),
                    F.coalesce("best.action", F.lit("allow")).alias("verdict"), F.col("best.pattern").alias("pattern")))
