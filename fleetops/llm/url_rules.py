"""URL filter by association rules.

URLs become sets of tokens: the host's labels, the path's segments and the names of query fields. From all tokens of
labelled URLs Spark's PrefixSpan, pattern growth with a bound on the length of patterns, mines the combinations of up to
MAX_TOKENS tokens that go with unwanted pages: FP-growth knows no such bound, and a URL of many tokens has too many
subsets. Rules keep those of enough support and confidence, and drop each rule of which a part is as confident. Rules are matched by an
inverted index: each is listed under its rarest token only, a URL's tokens look up the rules listed under them, and a
rule found so fits if the URL has all its tokens. Hosts that are listed by hand are judged by the longest listed rule.

All is DataFrame functions, and the miner is Spark's own. Rows are told apart by a number, so a host or URL of a third
of all rows is spread like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import PrefixSpan
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetops.llm.runtime import checkpointed, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK, ALLOW = "block", "allow"
# The hosts and paths that are judged by hand.
LISTED = (("net/", BLOCK), ("example.net/en/", ALLOW), ("example.com/de/", BLOCK), ("org/fr/", ALLOW))
MAX_TOKENS = 3  # tokens of a rule
MIN_SHARE = 0.002  # share of the labelled URLs that have a rule's tokens and are unwanted
MIN_ROWS = 3  # and how many of them at least
MIN_CONFIDENCE = 0.5  # share of unwanted ones among the labelled URLs that have a rule's tokens
UNWANTED = " "  # the mined item for an unwanted page; no token is a space
LOCAL_ITEMS = 1_000_000  # tokens that the miner brings together in one task, those of the URLs with a pattern's first tokens


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def split_url(url: Column) -> tuple[Column, Column, Column]:
    """Host, path and query of a URL; all empty for null and for texts without ``://``."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    part = lambda pattern: F.regexp_extract(rest, pattern, 1)
    return (
        lower_ascii(part(r"^([^/?#]*)")),
        part(r"^[^/?#]*([^?#]*)"),
        part(r"^[^?#]*\?([^#]*)"),
    )


def tokens(host: Column, path: Column, query: Column) -> Column:
    """The different tokens of a URL, host labels from the right first: ``h:`` label, ``p:`` segment, ``q:`` field name."""
    listed = F.concat(
        F.transform(F.reverse(F.split(host, r"\.")), lambda x: F.concat(F.lit("h:"), x)),
        F.transform(F.split(path, "/"), lambda x: F.concat(F.lit("p:"), lower_ascii(x))),
        F.transform(F.split(query, "&"), lambda x: F.concat(F.lit("q:"), lower_ascii(F.split(x, "=")[0]))),
    )
    return F.array_distinct(F.filter(listed, lambda x: F.length(x) > 2))


def listed_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest listed rule (host, then path from the first slash) that fits, and its verdict; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # the last ones decide first
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def mined(labelled: DataFrame) -> DataFrame:
    """Rules (rule, confidence, n) from rows (tokens, unwanted): ``rule`` is a sorted array, ``n`` its unwanted URLs.

    Rows without a label take no part, nor do empty token sets. No labelled row, or no unwanted one, gives no rules. What the
    driver gets is the miner's list of frequent tokens, at most 1 / MIN_SHARE times those of a mean URL and one, and the
    frequent patterns that begin those of more than LOCAL_ITEMS tokens.
    """
    spark = labelled.sparkSession
    marked = F.when(F.col("unwanted"), F.concat("tokens", F.array(F.lit(UNWANTED)))).otherwise(F.col("tokens"))
    known = labelled.filter(F.col("unwanted").isNotNull() & (F.size("tokens") > 0))
    baskets = checkpointed(known.select(F.array(marked).alias("sequence"), "unwanted"))
    total, bad = baskets.agg(F.count("*"), F.count_if("unwanted")).first()
    least = max(MIN_ROWS, -int(-MIN_SHARE * total // 1))
    if bad < least:
        return spark.createDataFrame([], "rule array<string>, confidence double, n long")
    # Half a row less, so that rounding cannot ask for one more. A sequence of one set has that set's subsets as patterns.
    miner = PrefixSpan(minSupport=(least - 0.5) / total, maxPatternLength=MAX_TOKENS + 1, maxLocalProjDBSize=LOCAL_ITEMS)
    frequent = miner.findFrequentSequentialPatterns(baskets.select("sequence")).select(F.col("sequence")[0].alias("items"), "freq")
    unwanted = F.array_contains("items", UNWANTED)
    counted = frequent.groupBy(F.array_sort(F.array_remove("items", UNWANTED)).alias("rule")).agg(
        F.max(F.when(unwanted, F.col("freq"))).alias("n"), F.max(F.when(~unwanted, F.col("freq"))).alias("urls")
    )
    confidence = F.col("n").cast("double") / F.col("urls")
    kept = counted.filter(F.col("n").isNotNull() & F.size("rule").between(1, MAX_TOKENS)).select("rule", confidence.alias("confidence"), "n")
    rules = checkpointed(kept.filter(F.col("confidence") >= MIN_CONFIDENCE))
    # A rule goes if a part of it is as confident: all parts of one or two of its tokens are looked up.
    singles = F.transform("rule", lambda x: F.array(x))
    without_one = F.transform("rule", lambda x: F.array_remove("rule", x))
    parts = rules.select("rule", "confidence", F.explode(F.array_distinct(F.concat(singles, without_one))).alias("part"))
    shorter = rules.select(F.col("rule").alias("part"), F.col("confidence").alias("of_part"))
    proper = parts.filter((F.size("part") > 0) & (F.size("part") < F.size("rule")))
    weak = proper.join(shorter, "part").filter("of_part >= confidence").select("rule").distinct()
    return rules.join(weak, "rule", "left_anti")


def index(rules: DataFrame, counts: DataFrame) -> DataFrame:
    """Rows (token, rule, confidence, n): each rule under its rarest token by ``counts`` (token, urls)."""
    found = rules.select("rule", "confidence", "n", F.explode("rule").alias("token")).join(counts, "token", "left")
    rarest = F.min(F.struct(F.coalesce("urls", F.lit(0)).alias("urls"), "token")).alias("rarest")
    return found.groupBy("rule", "confidence", "n").agg(rarest).select(F.col("rarest.token").alias("token"), "rule", "confidence", "n")


def matches(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """For each row (row, tokens) that a rule fits: row, and its most confident rule with confidence."""
    wanted = rules.select(F.explode("rule").alias("token")).distinct()
    listed = rows.select("row", F.explode("tokens").alias("token"), "tokens")
    counts = listed.select("token").join(wanted, "token").groupBy("token").agg(F.count("*").alias("urls"))
    looked_up = stored(index(rules, counts))
    found = listed.join(looked_up, "token").filter(F.size(F.array_except("rule", "tokens")) == 0)
    best = F.max_by(F.struct("rule", "confidence"), F.struct("confidence", "n", F.size("rule"), "rule")).alias("best")
    return found.groupBy("row").agg(best).select("row", F.col("best.rule").alias("mined_rule"), F.col("best.confidence").alias("confidence"))


def judge(pages: DataFrame, labels: DataFrame, listed: Sequence[tuple[str, str]] = LISTED) -> DataFrame:
    """One row per row of ``pages`` (page_id, url): page_id, host, path, rule, verdict, mined_rule, confidence.

    ``labels`` has rows (page_id, unwanted); several of one page say unwanted if any does, and rows with a null in either
    column say nothing. A listed rule decides alone; else a mined rule that fits blocks and all other pages are allowed.
    A null or empty url, or one without ``://``, has an empty host and path, fits no rule and is allowed. Repeated rows are
    judged each, long urls whole, an empty table gives no rows. Other columns are not read.
    """
    host, path, query = split_url(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"), query.alias("query"))
    rule, verdict = listed_rule(F.col("host"), F.col("path"), listed)
    rows = stored(
        parts.select(
            F.monotonically_increasing_id().alias("row"),
            "page_id",
            "host",
            "path",
            tokens(F.col("host"), F.col("path"), F.col("query")).alias("tokens"),
            rule.alias("rule"),
            verdict.alias("listed_verdict"),
        )
    )
    said = labels.filter(F.col("page_id").isNotNull()).groupBy("page_id").agg(F.bool_or("unwanted").alias("unwanted"))
    rules = mined(rows.join(said, "page_id").select("tokens", "unwanted"))
    found = matches(rows.filter(F.col("rule").isNull()).select("row", "tokens"), stored(rules))
    blocked = F.when(F.col("mined_rule").isNotNull(), BLOCK).otherwise(ALLOW)
    return rows.join(found, "row", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("listed_verdict", blocked).alias("verdict"), "mined_rule", "confidence"
    )


def page_labels(labels: DataFrame) -> DataFrame:
    """Labels (doc_id, quality, toxic) as labels of the pages of that number: toxic or of no quality is unwanted."""
    unwanted = (F.col("toxic") == 1) | (F.col("quality") == 0)
    return labels.select(F.col("doc_id").alias("page_id"), unwanted.alias("unwanted"))


def op12_url_rules(spark, sf_dir: str) -> DataFrame:
    pages, labels = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("pages", "labels"))
    judged = judge(pages, page_labels(labels)).withColumn("mined_rule", F.array_join("mined_rule", " "))
    return judged.select("page_id", "host", "path", "rule", "verdict", "mined_rule")


OP12_SQL = r"""
WITH u AS (
  SELECT page_id, row_number() OVER () AS r, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), v AS (
  SELECT page_id, r, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*\?([^#]*)', 1) AS query FROM u
), w AS (
  SELECT *, CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
      WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
      WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
      WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule,
    list_transform(list_reverse(string_split(host, '.')), lambda x: 'h:' || x)
      || list_transform(string_split(path, '/'), lambda x: 'p:' || translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))
      || list_transform(string_split(query, '&'), lambda x: 'q:' || translate(string_split(x, '=')[1], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS listed
  FROM v
), i AS (
  SELECT r, t, min(place) AS place FROM (SELECT r, unnest(listed) AS t, unnest(range(len(listed))) AS place FROM w) a WHERE length(t) > 2 GROUP BY r, t
), said AS (
  SELECT doc_id AS page_id, bool_or(toxic = 1 OR quality = 0) AS unwanted FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), known AS (
  SELECT w.r, s.unwanted FROM w JOIN said s ON s.page_id = w.page_id WHERE s.unwanted IS NOT NULL AND w.r IN (SELECT r FROM i)
), least AS (
  SELECT greatest(3, CAST(ceil(0.002 * count(*)) AS BIGINT)) AS n FROM known
), l AS (
  SELECT k.r, k.unwanted, t FROM (SELECT r, t, row_number() OVER (PARTITION BY r ORDER BY place) AS nth FROM i) x JOIN known k ON k.r = x.r WHERE nth <= 16
), sets AS (
  SELECT [t] AS s, unwanted FROM l
  UNION ALL SELECT [a.t, b.t], a.unwanted FROM l a JOIN l b ON a.r = b.r AND a.t < b.t
  UNION ALL SELECT [a.t, b.t, c.t], a.unwanted FROM l a JOIN l b ON a.r = b.r AND a.t < b.t JOIN l c ON c.r = a.r AND b.t < c.t
), counted AS (
  SELECT s, count(*) AS c, count(*) FILTER (WHERE unwanted) AS n FROM sets GROUP BY s HAVING 2 * count(*) FILTER (WHERE unwanted) >= count(*)
), rules AS (
  SELECT s, c, counted.n FROM counted, least WHERE counted.n >= least.n
), best AS (
  SELECT r.* FROM rules r WHERE NOT EXISTS (SELECT 1 FROM rules q WHERE len(q.s) < len(r.s) AND list_has_all(r.s, q.s) AND q.n * r.c >= r.n * q.c)
), sets_of AS (
  SELECT r, list(t) AS ts FROM i GROUP BY r
), fits AS (
  SELECT w.r, b.s, row_number() OVER (PARTITION BY w.r ORDER BY b.n / b.c DESC, b.n DESC, len(b.s) DESC, b.s DESC) AS nth
  FROM w JOIN sets_of o ON o.r = w.r JOIN best b ON list_has_all(o.ts, b.s) WHERE w.rule IS NULL
)
SELECT page_id, host, path, rule, CASE rule WHEN 'example.net/en/' THEN 'allow' WHEN 'org/fr/' THEN 'allow' WHEN 'net/' THEN 'block'
    WHEN 'example.com/de/' THEN 'block' ELSE CASE WHEN fits.s IS NULL THEN 'allow' ELSE 'block' END END AS verdict,
  array_to_string(fits.s, ' ') AS mined_rule
FROM w LEFT JOIN fits ON fits.r = w.r AND fits.nth = 1
"""
