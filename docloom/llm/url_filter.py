"""URL filters: listed rules found through a blocked Bloom filter, then an exact hash join.

A rule is host/path-prefix with a verdict; it fits its host and all subdomains if the url's path starts with
its path. A listed url is canonical: host in lower case and path. Every key a url could meet (each host
suffix with each path prefix of a listed length, and the whole url) is tested against the filter: one block
of eight 32-bit words a key, one bit in each word. Only possible hits are joined with the exact keys, which
removes false positives; of the rules left the longest wins. Without a rule a listed url is blocked, any
other allowed.

The filter is a table of blocks in the shared folder, one row a block, and grows with the list; candidate
keys, each once however many urls have it, meet it by their block number. The optimizer broadcasts the table
where its size allows and else joins by a shuffle of the keys. All of it is DataFrame functions.

Edge rules: a null url, or one without "://", has an empty host and path, meets no rule and is allowed;
repeated rows repeat; very long urls are taken whole; columns besides page_id and url are ignored, whatever
their names; null rules and listed urls are none; an empty list allows everything; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, stored

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
BITS_PER_KEY = 16
#: The query lists the pages whose html holds this run of signs: keyboard junk.
JUNK = "$$$"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first "://" up to / ? # or end; then up to ? # or end."""
    rest = F.when(F.locate("://", url) > 0, F.regexp_replace(url, r"(?s)^.*?://", ""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def canonical(url: Column) -> Column:
    host, path = split_url(url)
    return F.concat(F.lit("="), host, path)


def _hashes(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    """Block of a key, and its bit in each of the block's eight words."""
    h = F.xxhash64(key)
    block = F.pmod(F.shiftrightunsigned(h, 20), F.lit(blocks)).cast("int")
    g = F.xxhash64(key, F.lit(7))
    return block, [F.shiftrightunsigned(g, 5 * i).bitwiseAND(31).cast("int") for i in range(8)]


def bloom(keys: DataFrame) -> tuple[DataFrame, int]:
    """(table of blocks (block, w0 .. w7), number of blocks) of a blocked Bloom filter of keys(key)."""
    blocks = max(1, -(-keys.count() * BITS_PER_KEY // 256))
    block, bits = _hashes(F.col("key"), blocks)
    one = F.lit(1).cast("bigint")
    words = [F.bit_or(F.call_function("shiftleft", one, b)).alias(f"w{i}") for i, b in enumerate(bits)]
    return stored(keys.groupBy(block.alias("block")).agg(*words)), blocks


def possible(keys: DataFrame, filtered: DataFrame, blocks: int) -> DataFrame:
    """The keys(key) that the filter may hold."""
    block, bits = _hashes(F.col("key"), blocks)
    set_ = [F.call_function("shiftrightunsigned", F.col(f"w{i}"), b).bitwiseAND(F.lit(1).cast("bigint")) == 1 for i, b in enumerate(bits)]
    met = keys.withColumn("at", block)
    hit = met["at"] == filtered["block"]
    for c in set_:
        hit = hit & c
    return met.join(filtered, hit, "left_semi").select("key")


def rules_frame(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "rule string, verdict string")


def filter_urls(pages: DataFrame, rules: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """(page_id, url, host, path, rule, verdict) for each row of pages(page_id, url).

    rules(rule, verdict): "host/path prefix"; listed(url): urls to block where no rule fits.
    """
    cut = F.locate("/", F.col("rule"))
    exact = rules.where(F.col("rule").isNotNull() & (cut > 0)).select(F.col("rule").alias("key"), "rule", "verdict", (F.length("rule") - cut + 1).alias("n"))
    lengths = sorted(r["n"] for r in exact.select("n").distinct().collect())  # as many as rule paths have lengths
    exact = exact.groupBy("key").agg(F.max("rule").alias("rule"), F.max("verdict").alias("verdict"))  # of two verdicts for one rule, block
    if listed is not None:
        urls = listed.where("url is not null").select(canonical(F.col("url")).alias("key")).distinct()
        exact = exact.unionByName(urls.select("key", F.lit(None).cast("string").alias("rule"), F.lit("block").alias("verdict")))
    exact = stored(exact)
    host, path = split_url(F.col("url"))
    whole = F.coalesce(F.locate("://", F.col("url")) > 0, F.lit(False))
    base = pages.select(F.col("page_id"), F.col("url").cast("string").alias("url")).withColumn("whole", whole).withColumn("host", host).withColumn("path", path)
    # each host and path once, however many rows have it
    places = base.where("whole").select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]), lambda x: x.isNotNull()) if lengths else F.expr("cast(array() as array<string>)")
    keys = F.concat(F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p)))), F.array(F.concat(F.lit("="), F.col("host"), F.col("path"))))
    candidates = places.select("host", "path", F.explode(keys).alias("key"))
    hits = possible(candidates.select("key").distinct(), *bloom(exact.select("key")))
    found = exact.join(hits, "key", "left_semi")
    order = F.struct(F.col("rule").isNotNull().alias("is_rule"), F.coalesce(F.length("rule"), F.lit(0)).alias("n"), F.col("rule").alias("rule"), F.col("verdict").alias("verdict"))
    best = candidates.join(found, "key").groupBy("host", "path").agg(F.max(order).alias("best")).withColumn("whole", F.lit(True))
    return base.join(best, ["whole", "host", "path"], "left").select("page_id", "url", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four rules, and as list of urls those of the junk pages."""
    pages = read(spark, sf_dir, "pages")
    listed = pages.where(F.col("html").contains(JUNK)).select("url")
    return filter_urls(pages, rules_frame(spark), listed).select("page_id", "host", "path", "rule", "verdict")


OP3_SQL = r"""
WITH r(rule, verdict) AS (VALUES ('net/', 'block'), ('example.net/en/', 'allow'), ('example.com/de/', 'block'), ('org/fr/', 'allow')),
k AS (SELECT rule, verdict, split_part(rule, '/', 1) AS h, substr(rule, strpos(rule, '/')) AS p FROM r),
u AS (SELECT row_number() OVER () AS i, page_id, contains(html, '$$$') AS junk, coalesce(strpos(url, '://') > 0, FALSE) AS whole, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT i, page_id, junk, whole, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
f AS (SELECT s.i, k.rule, k.verdict, row_number() OVER (PARTITION BY s.i ORDER BY length(k.rule) DESC) AS n FROM s JOIN k ON (s.host = k.h OR ends_with(s.host, '.' || k.h)) AND starts_with(s.path, k.p)),
l AS (SELECT DISTINCT host, path FROM s WHERE junk AND whole)
SELECT s.page_id, s.host, s.path, f.rule, coalesce(f.verdict, CASE WHEN l.host IS NOT NULL AND s.whole THEN 'block' ELSE 'allow' END) AS verdict FROM s LEFT JOIN f ON s.i = f.i AND f.n = 1 LEFT JOIN l ON l.host = s.host AND l.path = s.path
"""
