"""URL filters whose rules are indexed by their rarest literal token; DataFrame operations only.

A rule is one line: ``allow`` or ``block``, then a pattern. In a pattern ``||`` at the start stands for the beginning of
the host or of one of its parent domains, ``*`` for anything, ``^`` for an end of the address or any character but
``A-Z a-z 0-9``; all else is literal. A pattern of ``||``, a host and a path is a *site rule*: it fits its host and all
subdomains where the path starts with the rule's. The longest site rule that fits decides; otherwise the *pattern
rules* decide: block, if one fits and no allowing one does.

Of each rule's literal tokens (runs of letters and digits with a fixed boundary on both sides) the one that the fewest
urls hold is its key. An address fetches the rules of its own tokens by a join, and only those run their regular
expression on it. Rules without a token are candidates of every address.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: More rules than this are joined by a shuffle, not broadcast.
BROADCAST_RULES = 50_000

#: The site rules.
SITE_RULES = ("allow ||org/", "block ||example.org/es/", "block ||example.org/en/1", "allow ||com/fr/", "block ||com/de/")
#: Words of unwanted sites, as whole tokens of an address.
PATTERN_RULES = (
    "block ^casino^",
    "block ^bets^",
    "block ^pills^",
    "block ^adult^",
    "block ^porn^",
    "block ^xxx^",
    "block ^spam^",
    "block ^ads^",
    "block ^tracker^",
    "block ^phishing^",
    "block ^redirect*url=http",
    "allow ^adult^education^",
    "allow ^spam^filter^",
)

_SITE = re.compile(r"\|\|[^/?#^*]+/[^?#^*]*")
_BOUND = "(?:^|$|[^A-Za-z0-9])"


def compiled(line: str) -> tuple[str, str, str, str, list[str]]:
    """A rule's (rule, kind, action, regular expression, literal tokens)."""
    action, _, pattern = line.strip().partition(" ")
    pattern = pattern.strip()
    if action not in ("allow", "block") or not pattern:
        raise ValueError(f"not a rule: {line!r}")
    kind = "site" if _SITE.fullmatch(pattern) else "pattern"
    anchored = pattern.startswith("||")
    body = pattern[2:] if anchored else pattern
    parts = {"*": ".*", "^": _BOUND}
    expression = ("(?s)" if kind == "site" else "(?is)") + (r"^(?:[^/?#]*\.)?" if anchored else "") + "".join(parts.get(c) or re.sub(r"([^A-Za-z0-9])", r"\\\1", c) for c in body)
    fixed = ("^" if anchored else "*") + body + "*"
    tokens = [m[0].lower() for m in re.finditer(r"(?<![A-Za-z0-9*])[A-Za-z0-9]+(?![A-Za-z0-9*])", fixed)]
    return (body if kind == "site" else pattern), kind, action, expression, sorted(set(tokens))


def rules_table(spark: SparkSession, lines=SITE_RULES + PATTERN_RULES) -> DataFrame:
    """rule, kind, action, regex, tokens, place: one row per line. A site rule's name is its host and path. Of the rules
    of a kind that fit, the one with the greatest place decides: of site rules the longest, of pattern rules an allowing
    one (ties: the greatest name)."""
    known = sorted(map(compiled, lines), key=lambda r: (r[1], len(r[0]) if r[1] == "site" else r[2] == "allow", r[0]))
    rows = [
        F.struct(F.lit(rule).alias("rule"), F.lit(kind).alias("kind"), F.lit(action).alias("action"), F.lit(regex).alias("regex"), F.array(*map(F.lit, tokens)).cast("array<string>").alias("tokens"), F.lit(place).cast("long").alias("place"))
        for place, (rule, kind, action, regex, tokens) in enumerate(known)
    ]
    if not rows:
        return spark.range(0).select(*[F.lit("").alias(c) for c in ("rule", "kind", "action", "regex")], F.array(F.lit("")).alias("tokens"), F.col("id").alias("place"))
    return spark.range(1).select(F.inline(F.array(*rows)))


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty for null and for urls without it."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(rest: Column) -> Column:
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(rest: Column) -> Column:
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def tokens_of(address: Column) -> Column:
    """The distinct tokens of an address, and the empty one, under which rules without a token stand."""
    return F.array_distinct(F.concat(F.array(F.lit("")), F.split(F.translate(address, UPPER, LOWER), "[^a-z0-9]+")))


def rule_index(addresses: DataFrame, rules: DataFrame, few: bool) -> DataFrame:
    """``rules`` with ``token``, the one of each rule's tokens that the fewest of all ``addresses`` hold (ties: the least
    token). Only tokens that some rule has are counted."""
    wanted = rules.select(F.explode("tokens").alias("token")).distinct()
    held = addresses.select(F.explode(tokens_of(F.col("address"))).alias("token"))
    counts = held.join(F.broadcast(wanted) if few else wanted, "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    by_token = rules.select("place", "kind", "regex", F.explode_outer("tokens").alias("token")).join(counts, "token", "left")
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))
    return by_token.groupBy("place", "kind", "regex").agg(rarest.alias("x")).select("place", "kind", "regex", F.coalesce("x.token", F.lit("")).alias("token"))


def judge(pages: DataFrame, rules: DataFrame | None = None, key: str = "page_id") -> DataFrame:
    """(key, host, path, rule, verdict, pattern), one row per row of ``pages``.

    ``rule`` is the longest site rule that fits, else null; ``pattern`` is the pattern rule that
    decided where none fits. Without either the verdict is ``allow``. A url that is null or has no ``://`` has empty host
    and path, and no rule but patterns of ends alone fits it. Repeated rows and null keys keep rows of their own; other
    columns, of whatever name, aren't read. Very long urls only have more tokens. An empty table gives an empty result.

    Urls are read twice: once for the tokens' counts, of which there are as many as the rules have tokens, and once to
    judge. Candidates and matches of a url are brought together within its task before one shuffle of a row per page."""
    rules = rules_table(pages.sparkSession) if rules is None else rules
    few = rules.count() <= BROADCAST_RULES
    rest = after_scheme(F.col("__url"))
    parts = pages.select(F.col(f"`{key}`").alias("__key"), F.col("url").cast("string").alias("__url")).select("__key", host_of(rest).alias("host"), path_of(rest).alias("path"), F.concat(host_of(rest), F.regexp_replace(rest, r"^[^/?#]*", "")).alias("address"))
    index = rule_index(parts, rules, few)
    asked = parts.withColumn("__row", F.monotonically_increasing_id()).withColumn("token", F.explode(tokens_of(F.col("address"))))
    found = asked.join(F.broadcast(index) if few else index, "token", "left").withColumn("fits", F.regexp_like("address", "regex"))
    best = lambda kind: F.max(F.when(F.col("fits") & (F.col("kind") == kind), F.col("place")))
    judged = found.groupBy("__row", "__key", "host", "path").agg(best("site").alias("__site"), best("pattern").alias("__pattern"))
    named = rules.select(F.col("place").alias("__place"), F.col("rule").alias("__rule"), F.col("action").alias("__action"))
    named = judged.join(F.broadcast(named) if few else named, F.coalesce("__site", "__pattern") == F.col("__place"), "left")
    by_site = F.col("__site").isNotNull()
    return named.select(
        F.col("__key").alias(key), "host", "path", F.when(by_site, F.col("__rule")).alias("rule"),
        F.coalesce("__action", F.lit("allow")).alias("verdict"), F.when(~by_site, F.col("__rule")).alias("pattern"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every url of ``pages`` by the site rules, and by the pattern rules where none of these fits."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


SQL = r"""
WITH r AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
a AS (
  SELECT row_number() OVER () AS id, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_replace(rest, '^[^/?#]*', '') AS tail FROM r),
s(host_rule, path_rule, action) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fits AS (
  SELECT id, max_by(host_rule || path_rule, length(host_rule || path_rule)) AS rule, max_by(action, length(host_rule || path_rule)) AS action
  FROM a JOIN s ON (host = host_rule OR ends_with(host, '.' || host_rule)) AND starts_with(path, path_rule) GROUP BY id),
w(pattern, action, regex) AS (
  VALUES ('^casino^', 'block', 'casino'), ('^bets^', 'block', 'bets'), ('^pills^', 'block', 'pills'), ('^adult^', 'block', 'adult'), ('^porn^', 'block', 'porn'),
         ('^xxx^', 'block', 'xxx'), ('^spam^', 'block', 'spam'), ('^ads^', 'block', 'ads'), ('^tracker^', 'block', 'tracker'), ('^phishing^', 'block', 'phishing'),
         ('^adult^education^', 'allow', 'adult[^a-z0-9]education'), ('^spam^filter^', 'allow', 'spam[^a-z0-9]filter')),
hits AS (
  SELECT id, pattern, action FROM a JOIN w ON regexp_matches(host || tail, '(?is)(^|[^a-z0-9])' || regex || '($|[^a-z0-9])')
  UNION ALL SELECT id, '^redirect*url=http', 'block' FROM a WHERE regexp_matches(host || tail, '(?is)(^|[^a-z0-9])redirect.*url=http')),
best AS (SELECT id, max({'allows': action = 'allow', 'pattern': pattern}) AS h FROM hits GROUP BY id)
SELECT page_id, host, path, fits.rule AS rule,
       coalesce(fits.action, CASE WHEN h IS NULL OR h.allows THEN 'allow' ELSE 'block' END) AS verdict,
       CASE WHEN fits.rule IS NULL THEN h.pattern END AS pattern
FROM a LEFT JOIN fits USING (id) LEFT JOIN best USING (id)
"""
