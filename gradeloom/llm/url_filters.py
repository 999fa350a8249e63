"""URL filters: pattern rules found through their rarest literal token.

A rule is a host and a path prefix. Its literal tokens are the labels of its host and
the complete segments of its path; each rule is filed under the token that the fewest
URLs of the table hold. A URL's own tokens fetch its candidate rules, and only those
run their regular expression. With up to ``PLAN_RULES`` rules all of it is one projection of
the URL column, without a shuffle; longer lists are a table that Spark sends to every task
while it is small, and the URLs' tokens are joined with it. No Python in either.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.common import Carried, ascii_lower, named, with_outputs

#: Up to so many rules are part of the plan; longer lists are joined as a table, with the same verdicts.
PLAN_RULES = 2000


@dataclass(frozen=True)
class Rule:
    """``host`` with all its subdomains, under paths that start with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path

    @property
    def pattern(self) -> str:
        return rf"^(?:[^/]*\.)?{re.escape(self.host)}{re.escape(self.path)}"

    @property
    def tokens(self) -> list[str]:
        segments = self.path.split("/")[:-1]  # the last one may go on in the URL
        return [f"h:{x}" for x in self.host.split(".") if x] + [f"p:{x}" for x in segments if x]


def url_host(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_tokens(url: Column) -> Column:
    hosts = F.transform(F.split(url_host(url), r"\."), lambda x: F.concat(F.lit("h:"), x))
    paths = F.transform(F.split(url_path(url), "/"), lambda x: F.concat(F.lit("p:"), x))
    return F.concat(hosts, paths)


def token_counts(pages: DataFrame, rules: list[Rule], url_col: str = "url") -> dict[str, int]:
    """In how many URLs each literal token of the rules occurs, over the whole table.

    The result has one row for each of the rules' own tokens at most.
    """
    known = sorted({token for rule in rules for token in rule.tokens})
    if not known:
        return {}
    tokens = url_tokens(pages[f"`{url_col}`"])
    if len(rules) <= PLAN_RULES:
        found = pages.select(F.explode(F.array_intersect(tokens, F.array(*[F.lit(x) for x in known]))).alias("token"))
    else:
        own = pages.sparkSession.createDataFrame([(x,) for x in known], "token string")
        found = pages.select(F.explode(F.array_distinct(tokens)).alias("token")).join(own, "token")
    return {row["token"]: row["count"] for row in found.groupBy("token").count().collect()}


def rarest_token_index(rules: list[Rule], counts: dict[str, int]) -> dict[str, list[Rule]]:
    index: dict[str, list[Rule]] = {}
    for rule in rules:
        if not rule.tokens:
            raise ValueError(f"a rule needs a literal token: {rule}")
        index.setdefault(min(rule.tokens, key=lambda x: (counts.get(x, 0), x)), []).append(rule)
    return index


def filter_urls(pages: DataFrame, rules: list[Rule], url_col: str = "url", default: str = "allow") -> DataFrame:
    """Judge every row's URL; returns the rows with ``host path rule verdict``.

    The longest fitting rule wins, and a later text in sort order where two are as long;
    without a fitting rule ``rule`` is null and the verdict is ``default``. A null URL, or
    one without ``://``, has an empty host and path, so no rule fits it. Each row is judged
    alone: repeated rows get the same verdict. An input column with the name of an output, in
    any case of letters, is replaced; other columns stay. An empty table gives an empty result.
    """
    url = pages[f"`{url_col}`"]
    host, path = url_host(url), url_path(url)
    outputs = {"host": host, "path": path, "rule": F.lit(None).cast("string"), "verdict": F.lit(default)}
    if not rules:
        return with_outputs(pages, outputs)
    index = rarest_token_index(rules, token_counts(pages, rules, url_col))
    if len(rules) > PLAN_RULES:
        return _filter_by_table(pages, index, url_col, default)

    def literal(rule: Rule) -> Column:
        parts = {"length": len(rule.text), "rule": rule.text, "verdict": rule.verdict, "pattern": rule.pattern}
        return F.struct(*[F.lit(value).alias(name) for name, value in parts.items()])

    filed = F.create_map(*[x for token, found in sorted(index.items()) for x in (F.lit(token), F.array(*map(literal, found)))])
    tokens = F.array_intersect(url_tokens(url), F.array(*[F.lit(x) for x in sorted(index)]))
    candidates = F.flatten(F.transform(tokens, lambda token: filed[token]))
    best = F.array_max(F.filter(candidates, lambda rule: F.rlike(F.concat(host, path), rule["pattern"])))
    outputs |= {"rule": best["rule"], "verdict": F.coalesce(best["verdict"], F.lit(default))}
    return with_outputs(pages, outputs)


def _filter_by_table(pages: DataFrame, index: dict[str, list[Rule]], url_col: str, default: str) -> DataFrame:
    """The same for a long list: distinct URLs' tokens meet the rules filed under them in a join."""
    rows = [(token, len(rule.text), rule.text, rule.verdict, rule.pattern) for token, found in sorted(index.items()) for rule in found]
    filed = pages.sparkSession.createDataFrame(rows, "token string, length int, rule string, verdict string, pattern string")
    held = Carried(pages, [url_col], ["host", "path", "rule", "verdict"])
    url = F.col(url_col)
    urls = held.df.select(url.alias("url")).filter(F.col("url").contains("://")).distinct()
    asked = urls.select("url", F.concat(url_host(F.col("url")), url_path(F.col("url"))).alias("whole"), F.explode(F.array_distinct(url_tokens(F.col("url")))).alias("token"))
    met = asked.join(filed, "token").filter(F.rlike(F.col("whole"), F.col("pattern")))
    best = met.groupBy(F.col("url").alias("met_url")).agg(F.max(F.struct("length", "rule", "verdict")).alias("best"))
    joined = held.df.join(best, url == F.col("met_url"), "left")
    outputs = [url_host(url).alias("host"), url_path(url).alias("path"), F.col("best.rule").alias("rule"), F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict")]
    return named(joined, held.rest, outputs)
