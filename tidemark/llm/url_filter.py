"""URL filter: a blocked Bloom filter of listed canonical URLs before an exact hash join.

Rules name a host and a path prefix; a rule fits its host and all subdomains, the longest wins. The
candidate keys of a URL (each suffix of its host with each prefix of its path that has the length of
some rule's path) and its canonical form are looked up in blocked Bloom filters: a key selects one
block and eight bits in it, so a lookup is one equi-join with the table of blocks. What passes goes
to an exact join with the list, which removes false positives.

The table of blocks is broadcast only while the number of listed keys keeps it under BROADCAST_BYTES;
beyond that both joins are shuffled by key, and joins are on keys that are unique on the list's side.

Defined results: a url that is null or has no `://` has an empty host and path, fits no rule and is
allowed; empty lists allow everything; repeated rows are judged each on its own; a url of any length is judged whole; of
rules with one host and path (a tie) the verdict that is last in the alphabet holds; an empty table gives no rows; other
columns are not read, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the query: (host, path, verdict).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
BITS_PER_KEY = 16
BLOCK_BITS = 256
WORDS = BLOCK_BITS // 64
BROADCAST_BYTES = 32 << 20
#: Query parameters that do not change what a page shows.
TRACKING = r"(?i)^(utm_[a-z]+|ref|fbclid|gclid)(=|$)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first `://`, up to `/`, `?`, `#` or the end; A-Z lower-cased; empty for none."""
    at = F.locate("://", url)
    rest = F.substring(url, at + 3, F.length(url))
    return F.when(at > 0, F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)).otherwise("")


def path_of(url: Column) -> Column:
    """After the host, up to `?`, `#` or the end; empty for none."""
    at = F.locate("://", url)
    rest = F.substring(url, at + 3, F.length(url))
    return F.when(at > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def canonical(url: Column) -> Column:
    """Host without a leading `www.`, path without a trailing `/`, query without tracking parameters; null for no `://`."""
    at = F.locate("://", url)
    rest = F.substring(url, at + 3, F.length(url))
    query = F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)), "&")
    base = F.concat(F.regexp_replace(host_of(url), r"^www\.", ""), F.regexp_replace(path_of(url), r"/+$", ""))
    return F.when(at > 0, F.when(kept == "", base).otherwise(F.concat(base, F.lit("?"), kept)))


class BlockedBloom:
    """Blocked Bloom filter of the distinct non-null keys of a one-column table."""

    def __init__(self, keys: DataFrame):
        self.keys = keys.toDF("__key").filter("__key is not null").distinct()
        self.n = self.keys.count()
        self.blocks = max(1, -(-self.n * BITS_PER_KEY // BLOCK_BITS))
        self.bounded = self.blocks * (8 + 8 * WORDS) <= BROADCAST_BYTES
        masks = self.masks(F.col("__key"))
        self.table = self.keys.select(self.block(F.col("__key")).alias("__block"), *(m.alias(f"__w{i}") for i, m in enumerate(masks))).groupBy("__block").agg(*(F.bit_or(f"__w{i}").alias(f"__w{i}") for i in range(WORDS)))

    def block(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.blocks))

    def masks(self, key: Column) -> list[Column]:
        """Eight bits of one block, two in each word, from a second hash."""
        h = F.xxhash64(key, F.lit("bits"))
        bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(63).cast("int"))
        return [bit(2 * i).bitwiseOR(bit(2 * i + 1)) for i in range(WORDS)]

    def passing(self, rows: DataFrame, key: str) -> DataFrame:
        """The rows whose key may be listed: all that are, and a few others."""
        table = F.broadcast(self.table) if self.bounded else self.table
        masks = self.masks(F.col(key))
        hit = None
        for i, m in enumerate(masks):
            one = F.col(f"__w{i}").bitwiseAND(m) == m
            hit = one if hit is None else hit & one
        return rows.withColumn("__block", self.block(F.col(key))).join(table, "__block").filter(hit).drop("__block", *(f"__w{i}" for i in range(WORDS)))

    def exact(self, rows: DataFrame, key: str) -> DataFrame:
        """The rows whose key is listed."""
        listed = self.keys.withColumnRenamed("__key", key)
        return self.passing(rows, key).join(F.broadcast(listed) if self.bounded and self.n <= 1 << 16 else listed, key, "left_semi")


def judge(pages: DataFrame, key: str, url: str, rules: DataFrame, listed: DataFrame) -> DataFrame:
    """key, host, path, rule, verdict.

    rules: (host, path, verdict), one row a rule; listed: one column of canonical URLs to block.
    A rule's verdict stands; else a listed canonical URL is blocked and any other allowed.
    """
    rules = rules.select(F.concat("host", "path").alias("__rule"), F.length("path").alias("__cut"), F.col("verdict").alias("__verdict"))
    # Different lengths alone: no more of them than the longest rule path has characters.
    cuts = sorted(r[0] for r in rules.select("__cut").distinct().collect())
    by_rule, by_url = BlockedBloom(rules.select("__rule")), BlockedBloom(listed)
    rows = pages.select(F.col(key).alias("__id"), F.col(url).alias("__url"))
    # Each distinct URL is judged once: repeated ones join the answer by the URL itself.
    urls = rows.select("__url").distinct().select("__url", host_of(F.col("__url")).alias("host"), path_of(F.col("__url")).alias("path"), canonical(F.col("__url")).alias("__canonical"))
    parts = F.split("host", r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    prefixes = F.transform(F.filter(F.array(*map(F.lit, cuts)), lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n)) if cuts else F.array().cast("array<string>")
    keyed = urls.filter("host != ''").select("__url", F.explode(hosts).alias("__h"), prefixes.alias("__p")).select("__url", F.explode("__p").alias("__pp"), "__h").select("__url", F.concat("__h", "__pp").alias("__rule"))
    small = by_rule.bounded and by_rule.n <= 1 << 16
    fits = by_rule.passing(keyed, "__rule").join(F.broadcast(rules) if small else rules, "__rule")
    best = fits.groupBy("__url").agg(F.max_by(F.struct("__rule", "__verdict"), F.struct(F.length("__rule"), "__rule", "__verdict")).alias("__best"))
    hits = by_url.exact(urls.filter("__canonical is not null").select("__url", "__canonical"), "__canonical").select("__url", F.lit(True).alias("__listed"))
    # One row a URL with all that is known of it, by aggregation of the three sources.
    none = F.lit(None)
    known = (
        urls.select("__url", "host", "path", none.cast("string").alias("rule"), none.cast("string").alias("__v"), none.cast("boolean").alias("__listed"))
        .unionByName(best.select("__url", none.cast("string").alias("host"), none.cast("string").alias("path"), F.col("__best.__rule").alias("rule"), F.col("__best.__verdict").alias("__v"), none.cast("boolean").alias("__listed")))
        .unionByName(hits.select("__url", none.cast("string").alias("host"), none.cast("string").alias("path"), none.cast("string").alias("rule"), none.cast("string").alias("__v"), "__listed"))
        .groupBy("__url")
        .agg(*(F.max(c).alias(c) for c in ("host", "path", "rule", "__v", "__listed")))
    )
    verdict = F.coalesce("__v", F.when(F.col("__listed"), "block").otherwise("allow"))
    known = known.select("__url", "host", "path", "rule", verdict.alias("verdict"))
    return rows.join(known, rows["__url"].eqNullSafe(known["__url"])).select(F.col("__id").alias(key), "host", "path", "rule", "verdict")


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    """Listed: canonical URLs of the pages whose id is divisible by 50, so their other spellings are blocked too."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    listed = pages.filter("page_id % 50 = 0").select(canonical(F.col("url")))
    return judge(pages, "page_id", "url", rules, listed)


ORACLE = r"""
WITH p AS (
  SELECT page_id, url, coalesce(strpos(url, '://'), 0) AS a,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest
  FROM pages),
h AS (
  SELECT page_id, rest,
         CASE WHEN a > 0 THEN translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN a > 0 THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM p),
c AS (
  SELECT page_id, host, path,
         CASE WHEN rest IS NOT NULL THEN regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '') END AS base,
         array_to_string(list_filter(string_split(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '&'),
           lambda q: q <> '' AND NOT regexp_matches(q, '(?i)^(utm_[a-z]+|ref|fbclid|gclid)(=|$)')), '&') AS kept
  FROM h),
k AS (SELECT page_id, host, path, CASE WHEN kept = '' THEN base ELSE base || '?' || kept END AS canon FROM c),
r AS (
  SELECT *, CASE
      WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
      WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
      WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
      WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM k)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN canon IN (SELECT canon FROM k WHERE page_id % 50 = 0 AND canon IS NOT NULL) THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""
