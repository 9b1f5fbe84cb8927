"""URL filter: path rules first, then a list of canonical URLs behind a blocked Bloom filter.

Native: only DataFrame functions.  A null url, or one without ``://``, has an empty host
and path, fits no rule and is allowed.  Repeated rows each get their own, equal result;
other columns of the input are ignored; an empty table or list gives an empty result or
allows everything.  Among rules of equal length the alphabetically first wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from subdiv.session import materialize

#: Bits of the Bloom filter per listed URL; eight of a block's 512 bits are set for each.
BITS_PER_URL = 16
_BLOCK_BITS = 512
_WORDS = 8

# Path rules of the query, and host labels whose pages are listed.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
LISTED_LABELS = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"]

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without www. or m., path without .html or a closing slash, query without utm parameters; null without a host."""
    query = F.coalesce(F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1), F.lit(""))
    query = F.regexp_replace(F.regexp_replace(query, r"(^|&)utm_[^&]*", ""), r"^&+", "")
    short = F.regexp_replace(host(url), r"^(www|m)\.", "")
    where = F.regexp_replace(path(url), r"(/|\.html)$", "")
    return F.when(host(url) != "", F.concat(short, where, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def rule_of(host_: Column, path_: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, both null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, said in sorted(rules, key=lambda r: (len(r[0]), [-ord(c) for c in r[0]])):
        name, slash, rest = text.partition("/")
        fits = ((host_ == name) | host_.endswith("." + name)) & path_.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks))


def _bit(url: Column, word: int) -> Column:
    """Word ``word`` of a URL's mask: one bit out of 64."""
    at = F.shiftrightunsigned(F.xxhash64(url, F.lit(1)), 6 * word).bitwiseAND(F.lit(63).cast("long")).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), at)


def bloom_filter(listed: DataFrame, blocks: int) -> DataFrame:
    """One row per used block of ``listed(canonical)``: the block's number and its eight 64-bit words."""
    return listed.groupBy(_block(F.col("canonical"), blocks).alias("block")).agg(
        *[F.bit_or(_bit(F.col("canonical"), i)).alias(f"w{i}") for i in range(_WORDS)]
    )


def filter_urls(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Verdict for every page; ``listed`` has one column ``canonical``.

    Only pages that the Bloom filter lets through are shuffled for the exact join.  The
    filter takes BITS_PER_URL bits per listed URL; it is written first, so that Spark
    sees its size and broadcasts it only below its own threshold.
    """
    listed = materialize(listed.where(F.col("canonical").isNotNull()).select("canonical").distinct(), "url-list")
    blocks = max(1, -(-listed.count() * BITS_PER_URL // _BLOCK_BITS))
    words = materialize(bloom_filter(listed, blocks), "url-bloom")
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    judged = (
        pages.select(F.col("page_id"), host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), canonical(F.col("url")).alias("canonical"))
        .withColumns({"rule": rule, "said": said, "at": _block(F.col("canonical"), blocks)})
        .join(words, F.col("at") == F.col("block"), "left")
    )
    passes = F.lit(True)
    for i in range(_WORDS):
        passes = passes & (F.col(f"w{i}").bitwiseAND(_bit(F.col("canonical"), i)) != 0)
    judged = judged.withColumn("maybe", F.coalesce(passes & F.col("said").isNull(), F.lit(False)))
    keep = ["page_id", "host", "path", "rule"]
    rest = judged.where(~F.col("maybe")).select(*keep, F.coalesce("said", F.lit("allow")).alias("verdict"))
    exact = listed.select(F.col("canonical").alias("listed")).hint("shuffle_hash")
    hits = judged.where("maybe").select(*keep, "canonical").join(exact, F.col("canonical") == F.col("listed"), "left")
    return rest.unionByName(hits.select(*keep, F.when(F.col("listed").isNotNull(), F.lit("block")).otherwise("allow").alias("verdict")))


def listed_urls(pages: DataFrame, labels: list[str]) -> DataFrame:
    """Canonical URLs of the pages on hosts with one of the given labels."""
    url = F.col("url")
    return pages.where(F.arrays_overlap(F.split(host(url), r"\."), F.array(*[F.lit(x) for x in labels]))).select(canonical(url).alias("canonical"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return filter_urls(pages, listed_urls(pages, LISTED_LABELS), RULES)


OP1_SQL = r"""
WITH parts AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path,
    regexp_replace(regexp_replace(coalesce(regexp_extract(url, '(?s)^[^?#]*\?([^#]*)', 1), ''), '(^|&)utm_[^&]*', '', 'g'), '^&+', '') AS query
  FROM pages
), named AS (
  SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '(/|\.html)$', '')
      || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS canonical
  FROM parts
), listed AS (
  SELECT DISTINCT canonical FROM named
  WHERE list_has_any(string_split(host, '.'), ['ads-track', 'adult-x', 'casino-win', 'cheap-pills', 'free-bets', 'spam-farm'])
    AND canonical IS NOT NULL
), rules(rule, name, start, said) AS (
  VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
         ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')
), fitting AS (
  SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(said, length(rule)) AS said
  FROM (SELECT DISTINCT host, path FROM named) JOIN rules
    ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, start)
  GROUP BY host, path
)
SELECT page_id, host, path, rule,
  coalesce(said, CASE WHEN canonical IN (SELECT canonical FROM listed) THEN 'block' ELSE 'allow' END) AS verdict
FROM named LEFT JOIN fitting USING (host, path)
"""
