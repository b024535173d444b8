"""URL filters: pattern rules are found by their rarest literal token.

Rules come as a table of (kind, action, rule), of any length. A rule of kind `site` is a host and the
beginning of a path, and fits the host and all its subdomains. A rule of kind `pattern` is text that
may stand anywhere in host and path, whatever its case, with `*` for any characters, `^` for an ASCII
mark, the beginning or the end, `|` at its beginning or end for that of the URL, and `||` at its
beginning for that of the host or of one of its parent domains.

From each rule come, by expressions, a regular expression and the literal tokens (runs of ASCII letters
and digits between marks) that any URL it matches must hold. How often each of those tokens occurs is
counted over all URLs, and a rule is filed under its rarest one (under the empty token, which every URL
has, if it holds none). The tokens of a URL fetch the rules filed under them; only those rules'
expressions run. All of it is DataFrame expressions.

The site rule with the longest text decides; without one, the longest pattern, to block before to
allow, then the last by name; without any, the verdict is allow.

Nulls and odd input: a null URL, or one without "://", has an empty host and path and no token but the
empty one. Rules that are null, empty or of another kind fit nothing. Repeated rows keep one result
each. URLs may repeat without limit: rules run once for each distinct URL, and rows of a hot one aren't
gathered. An empty table, of rows or of rules, gives an empty result or the default. Columns pass
through but for those of the result, which are replaced.
"""

from __future__ import annotations

import re
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from citegrain.llm.common import free_names, hot_join, table, written

#: Rules of host and path that the query is asked to apply.
SITE_RULES = """
allow org/
block example.org/es/
block example.org/en/1
allow com/fr/
block com/de/
"""
#: Rules for URLs that no rule of host and path fits: unwanted sites, machine pages and files.
PATTERN_RULES = """
block ^bets^
block ^casino^
block ^pills^
block ^poker^
block ^warez^
block ^xxx^
block ||ads.
block ||track*.
block ^sponsored^
block ^popunder^
block ^affiliate^*^click^
block /cgi-bin/
block /wp-admin/
block /wp-login.php|
block /xmlrpc.php
block ^login^|
block ^signup^|
block ^cart^checkout^
block ^search^*^page^
block ^print^|
block .exe|
block .apk|
block .iso|
block .torrent|
block ^download*.zip|
block ^sessionid^
block ||cdn*.js|
block |free-*.example.com/*/9
allow ^poker^rules^
allow ||www.*/help/
"""
#: Rules up to which their table is sent to all executors; above, Spark joins it by shuffle.
BROADCAST_RULES = 50_000
#: ASCII characters that end a token; the same but for *, which may stand for more of a token.
_BREAK = r"[\x00-/:-@\[-`{-\x7F]"
_FIRM = r"[\x00-)+-/:-@\[-`{-\x7F]"


def rules_of(spark: SparkSession, sites: str = "", patterns: str = "") -> DataFrame:
    """(kind, action, rule) from lines of an action and a rule."""
    texts = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(t).alias("text")) for k, t in (("site", sites), ("pattern", patterns))])
    rows = spark.range(1).select(F.inline(texts)).select("kind", F.explode(F.split("text", "\n")).alias("line")).where("line <> ''")
    return rows.select("kind", F.substring_index("line", " ", 1).alias("action"), F.regexp_replace("line", "^[^ ]* ", "").alias("rule"))


def _quoted(literal: Column, but: str = "") -> Column:
    """The text as a regular expression: ASCII marks get a backslash, but for some."""
    marks = "".join(c for c in string.punctuation if c not in but)
    return F.regexp_replace(literal, "([" + re.sub(r"(.)", r"\\\1", marks) + "])", r"\\$1")


def parsed(rules: DataFrame) -> DataFrame:
    """(id, kind, action, rule, regex, tokens, priority) of rules; those that mean nothing go."""
    rule = F.col("rule")
    at = F.instr(rule, "/")
    host, path = F.when(at > 0, F.substring(rule, F.lit(1), at - 1)).otherwise(rule), F.when(at > 0, F.substring(rule, at, F.length(rule))).otherwise("/")
    site = F.concat(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path)
    inner = F.regexp_replace(rule, r"^\|\|?|\|$", "")
    body = F.replace(F.replace(_quoted(inner, "*^"), F.lit("*"), F.lit(".*")), F.lit("^"), F.lit(f"(?:^|{_BREAK}|\\z)"))
    begin = F.when(rule.startswith("||"), r"^(?:[^/]*\.)?").when(rule.startswith("|"), "^").otherwise("")
    pattern = F.concat(F.lit("(?is)"), begin, body, F.when(F.length(inner) + F.length(F.regexp_extract(rule, r"^\|\|?", 0)) < F.length(rule), r"\z").otherwise(""))
    known = rules.where("rule <> '' AND kind IN ('site', 'pattern') AND action IN ('allow', 'block')").distinct()
    is_site = F.col("kind") == "site"
    text = F.when(is_site, F.concat(F.lit("|"), site)).otherwise(rule)
    tokens = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"(?<={_FIRM})[0-9a-z]+(?={_FIRM})"), F.lit(0)))
    return known.select(
        F.xxhash64("kind", "action", "rule").alias("id"), "kind", "action", "rule",
        F.when(is_site, F.concat(F.lit(r"^(?:[^/]*\.)?"), _quoted(site))).otherwise(pattern).alias("regex"), tokens.alias("tokens"), F.length("rule").alias("priority"),
    )


def url_host(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)


def url_path(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def filed(rules: DataFrame, tokens: DataFrame) -> DataFrame:
    """Parsed rules with the one token that each is filed under: its rarest among tokens (token), or blank."""
    wanted = rules.select("id", F.explode("tokens").alias("token"))
    counts = tokens.join(F.broadcast(wanted.select("token").distinct()) if rules.count() <= BROADCAST_RULES else wanted.select("token").distinct(), "token", "left_semi")
    counts = counts.groupBy("token").agg(F.count("*").alias("n"))
    ranked = wanted.join(counts, "token", "left").withColumn("at", F.row_number().over(Window.partitionBy("id").orderBy(F.coalesce("n", F.lit(0)), "token")))
    return rules.drop("tokens").join(ranked.where("at = 1").select("id", "token"), "id", "left").withColumn("token", F.coalesce("token", F.lit("")))


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """pages with host, path, rule, verdict and filter: `rule` is the rule of host and path that
    decided, `filter` the pattern that did where no such rule fits."""
    rules = written(parsed(rules), "rules")
    key = F.coalesce(F.col(url), F.lit(""))
    urls = pages.groupBy(key.alias("u")).agg(F.count("*").alias("n"))
    urls = urls.select("u", "n", F.concat(url_host(F.col("u")), url_path(F.col("u"))).alias("target"))
    tokens = urls.select("u", "n", "target", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), F.split(F.lower("target"), _BREAK + "+")))).alias("token"))
    index = filed(rules, tokens.select("token"))
    index = F.broadcast(index) if rules.count() <= BROADCAST_RULES else index

    found = tokens.join(index, "token").where(F.expr("target rlike regex"))
    order = F.struct((F.col("kind") == "site").alias("s"), F.col("priority").alias("p"), (F.col("action") == "block").alias("b"), F.col("rule").alias("r"))
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "filter")]
    own, best = free_names(pages, "__url", "__best")
    decided = found.groupBy(F.col("u").alias(own)).agg(F.max_by(F.struct("kind", "action", "rule"), order).alias(best), F.max("n").alias("n"))
    judged = hot_join(pages.select(*kept, key.alias(own)), written(decided, "decided"), [own], "n", "left")
    is_site = F.col(f"{best}.kind") == "site"
    return judged.select(
        *kept,
        url_host(F.col(own)).alias("host"),
        url_path(F.col(own)).alias("path"),
        F.when(is_site, F.col(f"{best}.rule")).alias("rule"),
        F.coalesce(f"{best}.action", F.lit("allow")).alias("verdict"),
        F.when(~is_site, F.col(f"{best}.rule")).alias("filter"),
    )


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, rules_of(spark, SITE_RULES, PATTERN_RULES)).select("page_id", "host", "path", "rule", "verdict", "filter")


def pattern_sql(rule: str) -> str:
    """A pattern as the oracle's regular expression."""
    begin = r"^(?:[^/]*\.)?" if rule.startswith("||") else "^" if rule.startswith("|") else ""
    inner = re.sub(r"^\|\|?", "", rule)
    end = r"\z" if inner.endswith("|") else ""
    parts = {"*": ".*", "^": r"(?:^|[\x00-/:-@\[-`{-\x7F]|\z)"}
    return "(?is)" + begin + "".join(parts.get(c, re.escape(c)) for c in inner.removesuffix("|")) + end


_PATTERNS = ", ".join(f"('{a}', '{r}', '{pattern_sql(r)}')" for a, r in (x.split(" ") for x in PATTERN_RULES.split("\n") if x))

OP10_SQL = rf"""
WITH p AS (
  SELECT page_id, CASE WHEN url IS NULL OR position('://' IN url) = 0 THEN '' ELSE substr(url, position('://' IN url) + 3) END AS rest
  FROM pages
), q AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM p
), r(action, rule, rhost, rpath) AS (
  VALUES ('allow', 'org/', 'org', '/'), ('block', 'example.org/es/', 'example.org', '/es/'), ('block', 'example.org/en/1', 'example.org', '/en/1'),
    ('allow', 'com/fr/', 'com', '/fr/'), ('block', 'com/de/', 'com', '/de/')
), fit AS (
  SELECT page_id, max_by(rule, length(rule)) AS rule, max_by(action, length(rule)) AS action
  FROM q JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY page_id
), w AS (
  SELECT page_id, first(prule ORDER BY length(prule) DESC, paction = 'block' DESC, prule DESC) AS filter,
    first(paction ORDER BY length(prule) DESC, paction = 'block' DESC, prule DESC) AS action
  FROM q JOIN (VALUES {_PATTERNS}) AS v(paction, prule, regex) ON regexp_matches(host || path, regex)
  GROUP BY page_id
)
SELECT q.page_id, q.host, q.path, fit.rule, coalesce(fit.action, w.action, 'allow') AS verdict,
  CASE WHEN fit.rule IS NULL THEN w.filter END AS filter
FROM q LEFT JOIN fit USING (page_id) LEFT JOIN w USING (page_id)
"""
