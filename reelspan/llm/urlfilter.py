"""URL filters: pattern rules indexed by their rarest literal token; only the rules that a URL's tokens fetch run their regular expression."""

import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most rules that are sent to every executor; a larger rule table is joined by shuffle instead.
BROADCAST_RULES = 100_000
#: Splits hosts, paths and rules into literal tokens.
SPLIT = "[^a-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """verdict allow or block; host with all its subdomains; path prefix; or, for pattern rules, text with * wildcards anywhere in the URL."""

    verdict: str
    host: str = ""
    path: str = ""
    pattern: str = ""

    @property
    def name(self) -> str:
        return self.pattern or self.host + self.path

    @property
    def regex(self) -> str:
        """Over host + path for host rules, over the lower-cased URL for pattern rules."""
        if self.pattern:
            return ".*".join(re.escape(x).replace("/", "\\/") for x in self.pattern.split("*"))
        return rf"^([^\/]*\.)?{re.escape(self.host)}{re.escape(self.path)}"

    @property
    def tokens(self) -> list[str]:
        """Literal tokens that every URL that the rule fits must hold whole."""
        if self.pattern:
            parts = re.split(r"([^a-z0-9]+)", self.pattern)
            return [x for i, x in enumerate(parts) if i % 2 == 0 and x and 0 < i < len(parts) - 1]
        whole = [x for x in re.split(SPLIT, self.host) if x]
        inner = re.split(r"([^a-z0-9]+)", self.path.lower())  # the last part is a prefix unless a separator follows
        return whole + [x for x in inner[:-1:2] if x]


#: Contract rules, by host and path prefix; the longest that fits wins.
PREFIX_RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)
#: What the method adds for URLs that no prefix rule fits: block if one of these fits, else allow.
PATTERN_RULES = (
    Rule("block", pattern="?utm_source="),
    Rule("block", pattern="&utm_source="),
    Rule("block", pattern="/track/"),
    Rule("block", pattern="/ads/"),
    Rule("block", pattern=".doubleclick."),
    Rule("block", pattern="/login?*session="),
)


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without one."""
    return _ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?:\/\/([^\/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host, up to ? or # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?:\/\/[^\/?#]*([^?#]*)", 1), F.lit(""))


def _ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rule_index(rules: tuple[Rule, ...]) -> list[tuple]:
    """One row per rule under its rarest literal token (ties: longest, then first); rules without one are under the empty token."""
    often = Counter(t for r in rules for t in set(r.tokens))
    return [(min(set(r.tokens), key=lambda t: (often[t], -len(t), t), default=""), r.name, r.verdict, r.regex, bool(r.pattern), len(r.name)) for r in rules]


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = PREFIX_RULES + PATTERN_RULES, url: str = "url") -> DataFrame:
    """pages plus host, path, rule, verdict; columns of these names in the input are replaced.

    Each distinct URL is judged once. Its tokens (and the empty token) fetch candidate rules from the index; only those
    run their regular expression. The longest host rule that fits gives rule and verdict; without one, rule is null and
    verdict is block if a pattern rule fits, else allow. Null URLs and URLs without :// have empty host and path and are
    allowed unless a pattern fits. Repeated rows, null ids and extra columns are kept as they are; an empty table gives an
    empty table.
    """
    spark = pages.sparkSession
    index = spark.createDataFrame(rule_index(rules), "token string, rule string, verdict string, regex string, is_pattern boolean, size int")
    if len(rules) <= BROADCAST_RULES:
        index = F.broadcast(index)
    urls = pages.select(F.col(url).alias("u")).where("u is not null").distinct()
    urls = urls.select("u", host_of(F.col("u")).alias("h"), path_of(F.col("u")).alias("p"))
    fold = _ascii_lower(F.col("u"))
    tokens = F.array_distinct(F.concat(F.split(fold, SPLIT), F.array(F.lit(""))))
    fetched = urls.select("u", "h", "p", fold.alias("low"), F.explode(tokens).alias("token")).join(index, "token")
    fits = fetched.where(F.when(F.col("is_pattern"), F.expr("low rlike regex")).otherwise(F.expr("concat(h, p) rlike regex")))
    best = fits.groupBy("u").agg(
        F.max(F.when(~F.col("is_pattern"), F.struct("size", "rule", "verdict"))).alias("best"),
        F.max(F.when(F.col("is_pattern"), F.col("verdict") == "block")).alias("hit"),
    )
    judged = best.select("u", F.col("best.rule").alias("_rule"), F.coalesce("best.verdict", F.when(F.col("hit"), "block"), F.lit("allow")).alias("_verdict"))
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    return pages.join(judged, pages[url] == judged["u"], "left").select(
        *[pages[c] for c in keep],
        host_of(pages[url]).alias("host"),
        path_of(pages[url]).alias("path"),
        judged["_rule"].alias("rule"),
        F.coalesce(judged["_verdict"], F.lit("allow")).alias("verdict"),
    )


SQL = r"""
WITH u AS (
  SELECT page_id, coalesce(url, '') AS url,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
    translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low
  FROM pages),
r AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM u)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN contains(low, '?utm_source=') OR contains(low, '&utm_source=') OR contains(low, '/track/') OR contains(low, '/ads/')
      OR contains(low, '.doubleclick.') OR regexp_matches(low, '/login\?.*session=') THEN 'block'
    ELSE 'allow' END AS verdict
FROM r
"""
