"""URL filter (operator 9): host/path policy plus token-indexed pattern rules.

Pattern rules are written in a small filter syntax over the lower-cased URL:

* ``*``  any run of characters,
* ``^``  a separator: one character outside ``[a-z0-9]``, or an end of the URL,
* anything else stands for itself.

Each rule is indexed under the *rarest* of its literal tokens, rarity being the
number of URLs of the whole table that hold the token.  The tokens of a URL
fetch the rules indexed under them, and only these run their regular
expression.  A rule without a complete literal token is indexed under the empty
token, which every URL holds.  A matching ``allow`` rule wins over matching
``block`` rules.

Rules are a table.  Counting joins the URLs' tokens to the rules' tokens, fetching
joins them to the index; the index is broadcast up to ``BROADCAST_RULES`` rules and
shuffled beyond, so their number has no limit.  A URL that many rows hold is judged
once; verdicts meet the rows again by the URL, those of hot URLs by broadcast.
Everything is DataFrame expressions; the driver reads one number, the rows' count.

Defined cases: a null or empty URL, or one without ``://``, has empty host and
path; no policy rule fits it and pattern rules see its lower-cased text (null:
empty).  Repeated rows each get their own, equal, verdict.  Extra input columns
are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.skew import join_counted

from .stored import stored

# Up to this many rules (a few hundred bytes each) the index is broadcast.
BROADCAST_RULES = 50_000
SALTS = 32

# host/path policy of the query contract.
POLICY = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]

# Production pattern rules (filter syntax, see the module text).
PATTERNS = [
    ("block", "^casino^"),
    ("block", "^free^bets^"),
    ("block", "^online^poker^"),
    ("block", "^cheap^pills^"),
    ("block", "^buy^viagra^"),
    ("block", "^adult^"),
    ("block", "^xxx^"),
    ("block", "^porn^"),
    ("block", "^spam^"),
    ("block", "^ads^track^"),
    ("block", "^adserver^"),
    ("block", "^clickbait^"),
    ("block", "^payday^loan*^"),
    ("allow", "^casino^review^board^"),
    ("allow", "^adult^education^"),
    ("allow", "^spam^report^"),
]

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()


@dataclass(frozen=True)
class PatternRule:
    action: str
    text: str

    @property
    def regex(self) -> str:
        out = []
        for ch in self.text:
            out.append(".*" if ch == "*" else "(?:[^a-z0-9]|^|$)" if ch == "^"
                       else ch if ch.isalnum() else "\\" + ch)
        return "(?s)" + "".join(out)

    @property
    def tokens(self) -> list[str]:
        """Literal tokens that every matching URL holds as whole tokens: both
        neighbours are a separator sign or a literal outside ``[a-z0-9]``."""
        found = []
        for m in re.finditer(r"[a-z0-9]+", self.text):
            before = self.text[m.start() - 1] if m.start() else "*"
            after = self.text[m.end()] if m.end() < len(self.text) else "*"
            if "*" not in (before, after):
                found.append(m[0])
        return sorted(set(found))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, ASCII_UPPER, ASCII_LOWER)


def url_host(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return ascii_lower(host)


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def url_tokens(lowered: Column) -> Column:
    """The distinct tokens of a URL, and the empty one."""
    return F.array_distinct(F.concat(F.array(F.lit("")), F.split(lowered, "[^a-z0-9]+")))


def policy_rule(host: Column, path: Column, policy: Sequence[tuple[str, str]]) -> Column:
    """The longest fitting policy rule's text, else null."""
    whens = []
    for _, rule in sorted(policy, key=lambda r: (-len(r[1]), r[1])):
        at = rule.index("/")
        h, p = rule[:at], rule[at:]
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        whens.append(F.when(fits, F.lit(rule)))
    return F.coalesce(*whens, F.lit(None).cast("string"))


def distinct_urls(pages: DataFrame, url: str) -> DataFrame:
    """Each lower-cased URL once: low, weight (rows that hold it)."""
    low = pages.select(ascii_lower(F.coalesce(F.col(url), F.lit(""))).alias("low"))
    return stored(low.groupBy("low").agg(F.count("*").alias("weight")), "urlfilter")


def index_rules(urls: DataFrame, rules: Sequence[PatternRule]) -> DataFrame:
    """One row per rule: rule (its text), regex, allow and the token it is fetched by:
    the one that the fewest rows of the whole table hold (ties: the first), or the
    empty one for a rule without tokens.  ``urls`` as from ``distinct_urls``."""
    rows = [(k, r.text, r.regex, r.action == "allow", r.tokens) for k, r in enumerate(rules)]
    table = urls.sparkSession.createDataFrame(rows, "n int, rule string, regex string, allow boolean, tokens array<string>")
    held = table.select("n", F.explode("tokens").alias("token"))
    wanted = _small(held.select("token").distinct(), sum(len(r.tokens) for r in rules))
    counts = (urls.select("weight", F.explode(url_tokens(F.col("low"))).alias("token"))
              .join(wanted, "token", "left_semi").groupBy("token").agg(F.sum("weight").alias("k")))
    rarity = F.struct(F.coalesce("k", F.lit(0)).alias("k"), "token")
    rarest = held.join(counts, "token", "left").groupBy("n").agg(F.min(rarity)["token"].alias("token"))
    return table.join(rarest, "n", "left").select("rule", "regex", "allow", F.coalesce("token", F.lit("")).alias("token"))


def _small(table: DataFrame, rows: int) -> DataFrame:
    """``table``, of at most ``rows`` rows, marked for broadcast within the bound."""
    return F.broadcast(table) if rows <= BROADCAST_RULES else table


def pattern_verdicts(urls: DataFrame, rules: Sequence[PatternRule]) -> DataFrame:
    """Each URL once: low, weight, by_pattern (``allow`` or ``block``; no match: allow)."""
    # beyond the broadcast, a token that most URLs hold is dealt over SALTS tasks
    salts = 1 if len(rules) <= BROADCAST_RULES else SALTS
    index = index_rules(urls, rules).select("regex", "allow", "token", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    tokens = urls.select("low", "weight", F.explode(url_tokens(F.col("low"))).alias("token"),
                         F.pmod(F.xxhash64("low"), F.lit(salts)).cast("int").alias("salt"))
    fetched = tokens.join(_small(index, len(rules)), ["token", "salt"], "left")
    allowed = F.max(F.when(F.rlike("low", F.col("regex")), F.col("allow")))
    verdict = F.when(F.coalesce(allowed, F.lit(True)), "allow").otherwise("block")
    return fetched.groupBy("low").agg(F.max("weight").alias("weight"), verdict.alias("by_pattern"))


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
               policy: Sequence[tuple[str, str]] = tuple(POLICY),
               patterns: Sequence[tuple[str, str]] = tuple(PATTERNS)) -> DataFrame:
    """One row per input row: id, host, path, rule, verdict (see the module text)."""
    rules = [PatternRule(a, t) for a, t in patterns]
    url = F.col(url_col)
    parts = pages.select(F.col(id_col).alias("id"), ascii_lower(F.coalesce(url, F.lit(""))).alias("low"),
                         url_host(url).alias("host"), url_path(url).alias("path"))
    urls = distinct_urls(pages, url_col)
    total = urls.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    ruled = (join_counted(parts, stored(pattern_verdicts(urls, rules), "urlfilter"), ["low"], total)
             .withColumn("rule", policy_rule(F.col("host"), F.col("path"), policy)))
    by_rule = F.coalesce(*(F.when(F.col("rule") == r, F.lit(a)) for a, r in policy))
    return ruled.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce(by_rule, "by_pattern").alias("verdict"))


def oracle_sql(policy: Sequence[tuple[str, str]] = tuple(POLICY),
               patterns: Sequence[tuple[str, str]] = tuple(PATTERNS)) -> str:
    """DuckDB: every pattern on every URL, no index."""
    fits, verdicts = [], []
    for a, rule in sorted(policy, key=lambda r: (-len(r[1]), r[1])):
        at = rule.index("/")
        h, p = rule[:at], rule[at:]
        fits.append(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{rule}'")
        verdicts.append(f"WHEN rule = '{rule}' THEN '{a}'")
    match = {a: " OR ".join(f"regexp_matches(low, '{PatternRule(x, t).regex}')" for x, t in patterns if x == a)
             or "false" for a in ("allow", "block")}
    return f"""
WITH parts AS (
  SELECT page_id, translate(coalesce(url, ''), '{ASCII_UPPER}', '{ASCII_LOWER}') AS low,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{ASCII_UPPER}', '{ASCII_LOWER}') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
ruled AS (SELECT *, CASE {' '.join(fits)} END AS rule FROM parts)
SELECT page_id, host, path, rule,
       CASE {' '.join(verdicts)} WHEN {match['allow']} THEN 'allow' WHEN {match['block']} THEN 'block' ELSE 'allow' END AS verdict
FROM ruled"""
