"""URL filtering with an index of pattern rules by their rarest literal token.

A rule's pattern is a regular expression with literal tokens that every
matching URL must hold. URL tokens are counted over the whole table; each rule
is filed under the rarest of its tokens, each URL's distinct tokens fetch the
rules filed under them, and only those run their regular expression.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: The rule index is broadcast up to this many rules, else joined by a shuffle.
BROADCAST_RULES = 20_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``pattern`` is searched in host + path; ``tokens`` occur in any match; the largest ``rank`` wins."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    rank: int
    base: bool


def domain_rule(verdict: str, host: str, path: str) -> Rule:
    """A rule for a host with all its subdomains and a path prefix."""
    name = host + path
    tokens = tuple(sorted({*re.findall("[a-z0-9]+", host)}))
    return Rule(name, verdict, f"^([^/]*\\.)?{re.escape(host)}{re.escape(path)}".replace("\\-", "-"), tokens, 1_000 + len(name), True)


#: The given rules.
BASE_RULES = (
    domain_rule("block", "net", "/"),
    domain_rule("allow", "example.net", "/en/"),
    domain_rule("block", "example.com", "/de/"),
    domain_rule("allow", "org", "/fr/"),
)

#: Words of unwanted hosts and paths, by kind; a rule is made of each.
WORDS = {
    "gambling": "bets betting bingo blackjack casino jackpot lottery poker roulette slots sportsbook wager",
    "pharmacy": "cialis pharmacy pills steroids tramadol viagra xanax",
    "adult": "adult camgirls escort hentai nude porn sex xxx",
    "piracy": "cracked keygen nulled pirate serialkey torrent warez",
    "scam": "airdrop cryptodouble freegift getrich giveaway mlm payday phishing spam winner",
}
#: Rules on the shape of a url: name, pattern over host and path, tokens of every match.
SHAPES = (
    ("ads", "^([^/]*[.])?ads[.-]", ("ads",)),
    ("adserver", "^([^/]*[.])?adserver[.-]", ("adserver",)),
    ("tracker", "^([^/]*[.])?tracker[.-][^/]*/(pixel|open|click)", ("tracker",)),
    ("login", "^[^/]*(secure|account|verify)[^/]*/([^/]*/)*wp-login[.]php", ("wp", "login", "php")),
    ("install", "/wp-admin/install[.]php", ("wp", "admin", "install", "php")),
    ("executable", "/(setup|download|update)[^/]*[.]exe$", ("exe",)),
    ("calendar", "/calendar/[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}/", ("calendar",)),
    ("jsessionid", "/jsessionid[=/][0-9a-f]{8}", ("jsessionid",)),
    ("phpsessid", "/phpsessid[=/][0-9a-f]{8}", ("phpsessid",)),
)


def own_rules() -> tuple[Rule, ...]:
    """The operator's own rules, which speak where no base rule does."""
    words = sorted({w for x in WORDS.values() for w in x.split()})
    named = [Rule(w, "block", f"(^|[.-]){w}([.-])", (w,), 10, False) for w in words]
    return (*named, *(Rule(n, "block", p, t, 10, False) for n, p, t in SHAPES))


OWN_RULES = own_rules()


def parts(url):
    """(host, path) columns of a url column; both empty where it is null or has no ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def judge(pages: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + OWN_RULES, default: str = "allow", id_col: str = "page_id", url_col: str = "url", broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule (a base rule's name or null), verdict.

    Null urls and urls without ``://`` have an empty host and path, no rule and
    the default verdict. Base rules go before own rules; the highest rank wins,
    then the smaller name. Repeated rows are all returned. Other columns are
    ignored.
    """
    spark = pages.sparkSession
    host, path = parts(F.col(url_col).cast("string"))
    urls = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    tokens = F.array_distinct(F.filter(F.split(F.translate(F.concat("host", "path"), _UPPER, _LOWER), "[^a-z0-9]+"), lambda t: t != ""))
    rows = urls.withColumn("_tokens", tokens)
    if not rules:
        return urls.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    table_of_rules = spark.createDataFrame(
        [(r.name, r.verdict, r.pattern, list(r.tokens), r.rank, r.base) for r in rules], "name string, act string, pattern string, tokens array<string>, rank long, base boolean"
    )
    literal = table_of_rules.select("name", F.explode("tokens").alias("token"))
    small = len(rules) <= broadcast_rules
    hint = F.broadcast if small else (lambda d: d)
    counts = rows.select(F.explode("_tokens").alias("token")).join(hint(literal.select("token").distinct()), "token").groupBy("token").count()
    rarest = literal.join(hint(counts) if small else counts, "token", "left").groupBy("name").agg(F.min_by("token", F.struct(F.coalesce("count", F.lit(0)), "token")).alias("token"))
    index = table_of_rules.drop("tokens").join(rarest, "name")
    # one row per token of a page, and one that stands for the page itself
    posed = rows.select("page_id", "host", "path", F.explode(F.concat(F.array(F.lit("")), "_tokens")).alias("token"))
    fits = F.expr("rlike(concat(host, path), pattern)")
    best = F.max(F.when(fits, F.struct("rank", F.struct("name", "act", "base").alias("what")))).alias("best")
    found = (
        posed.join(hint(index), "token", "left")
        .groupBy("page_id", "host", "path")
        .agg(F.sum(F.when(F.col("token") == "", 1).otherwise(0)).alias("_copies"), best)
    )
    what = F.col("best.what")
    return found.select("page_id", "host", "path", F.when(what["base"], what["name"]).alias("rule"), F.coalesce(what["act"], F.lit(default)).alias("verdict"), "_copies").select(
        "page_id", "host", "path", "rule", "verdict", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))).alias("_copy")
    ).drop("_copy")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


def _sql_rules() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    return ", ".join(f"({quote(r.pattern)})" for r in OWN_RULES)


#: The four base rules are stated anew, longest first; own rules only block, so any that fits decides.
OP9_SQL = f"""
WITH r(pattern) AS (VALUES {_sql_rules()}),
u AS (SELECT page_id, regexp_extract(coalesce(url, ''), '^(?s:.*?)://((?s:.*))$', 1) AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
b AS (SELECT *, CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
                     WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
                     WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
                     WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       WHEN EXISTS (SELECT 1 FROM r WHERE regexp_matches(host || path, pattern)) THEN 'block' ELSE 'allow' END AS verdict
FROM b
"""
