"""URL filters: a blocked Bloom filter of listed keys, then an exact hash join.

Listed keys are host/path rules and canonical URLs.  Each distinct URL offers its candidate keys: every pair of
a host suffix and a path prefix of a length that some rule has, and its canonical form.  The filter, 256-bit
blocks of four 64-bit words with one bit in each word, passes possible hits; an exact join on the key removes the
filter's false positives.  DataFrame functions only.

Nulls, and URLs without ``://``, have empty host and path and match nothing; repeated pages each keep their row;
an empty list allows everything; other columns of the pages are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, small

#: Blocks of the filter for each listed key: 256 bits hold about 16 keys at under 1 % false positives.
KEYS_PER_BLOCK = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def canonical(host: Column, path: Column) -> Column:
    """Host without a leading ``www.`` or ``m.``, path without ``.html`` or a final slash."""
    return F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), F.regexp_replace(path, r"(\.html|/)$", ""))


def bloom(keys: DataFrame, blocks: int) -> DataFrame:
    """The filter's blocks: (block, w0, w1, w2, w3).  Its size is ``blocks`` times 40 bytes, whatever the keys are."""
    words = [F.bit_or(F.expr(f"shiftleft(1L, cast(shiftright(h, {6 * k}) & 63 as int))")).alias(f"w{k}") for k in range(4)]
    return (keys.select(F.xxhash64("key", F.lit(1)).alias("h"), _block("key", blocks).alias("block"))
            .groupBy("block").agg(*words))


def _block(key: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key), F.lit(2)), F.lit(blocks))


def listed_keys(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """(key, rule, verdict) of rules (rule, host, path, verdict) and of canonical URLs (canonical, verdict)."""
    return rules.select(F.concat(F.lit("r"), "host", F.lit("\0"), "path").alias("key"), "rule", "verdict").unionByName(
        urls.select(F.concat(F.lit("u"), "canonical").alias("key"), F.lit(None).cast("string").alias("rule"), "verdict"))


def match(parts: DataFrame, listed: DataFrame, lengths: list[int], broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Every listed key that a distinct (host, path) of ``parts`` meets: (host, path, rule, verdict).

    ``lengths``: the path lengths, in characters, that rules have.  The filter is broadcast only if its known size
    allows, and so is the list; else both joins shuffle, and Spark splits what is skewed.
    """
    keys = listed.dropDuplicates(["key"])
    count = keys.count()
    blocks = max(1, -(-count // KEYS_PER_BLOCK))
    fits = blocks <= broadcast_rows
    filter_ = bloom(keys, blocks)
    prefixes = F.array(*[F.when(F.char_length("path") >= n, F.substring("path", 1, n)) for n in lengths]) if lengths else F.array().cast("array<string>")
    labels = F.split("host", r"\.")
    hosts = F.expr("transform(sequence(1, size(labels)), i -> array_join(slice(labels, i, size(labels)), '.'))")
    pairs = F.expr("flatten(transform(hosts, h -> transform(array_compact(prefixes), p -> concat('r', h, '\\0', p))))")
    distinct = parts.where("host <> ''").select("host", "path").distinct()
    offered = (distinct.withColumn("labels", labels).withColumn("hosts", hosts).withColumn("prefixes", prefixes)
               .select("host", "path", F.explode(F.concat(pairs, F.array(F.concat(F.lit("u"), canonical(F.col("host"), F.col("path")))))).alias("key"))
               .withColumn("block", _block("key", blocks)).withColumn("h", F.xxhash64("key", F.lit(1))))
    hit = " AND ".join(f"(shiftright(w{k}, cast(shiftright(h, {6 * k}) & 63 as int)) & 1L) = 1L" for k in range(4))
    possible = offered.join(F.broadcast(filter_) if fits else filter_, "block").where(hit).select("host", "path", "key")
    return possible.join(small(keys, broadcast_rows), "key").select("host", "path", "rule", "verdict")


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], blocked: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """page_id, host, path, rule and verdict of every page.

    ``rules``: (host, path, verdict); a rule fits its host and subdomains where the path starts with the rule's; the
    longest fitting rule decides.  Where none fits, a canonical URL listed in ``blocked`` (canonical) is blocked and
    any other is allowed.
    """
    spark: SparkSession = pages.sparkSession
    listed = listed_keys(
        spark.createDataFrame([(h + p, h, p, v) for h, p, v in rules], "rule string, host string, path string, verdict string"),
        blocked.select("canonical", F.lit("block").alias("verdict")))
    parts = split_urls(pages)
    found = (match(parts, listed, sorted({len(p) for _, p, _ in rules}), broadcast_rows)
             .groupBy("host", "path").agg(F.max(F.struct(F.coalesce(F.char_length("rule"), F.lit(-1)).alias("n"), "rule", "verdict")).alias("best")))
    found = found.select(F.col("host").alias("_h"), F.col("path").alias("_p"), "best")
    return parts.join(found, (parts.host == found._h) & (parts.path == found._p), "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict"))


def split_urls(pages: DataFrame) -> DataFrame:
    """page_id, host, path: host between the first ``://`` and ``/``, ``?``, ``#`` or the end, path from there to ``?`` or ``#``."""
    after = F.expr("CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END")
    return (pages.select("page_id", after.alias("_a"))
            .select("page_id", F.translate(F.regexp_extract("_a", r"(?s)^([^/?#]*)", 1), UPPER, LOWER).alias("host"), F.regexp_extract("_a", r"(?s)^[^/?#]*([^?#]*)", 1).alias("path"))
            .select("page_id", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path")))


def spelled_twice(pages: DataFrame) -> DataFrame:
    """Canonical URLs that the pages reach by two or more different URLs: what a crawler trap's list holds."""
    url = pages.select("url").distinct()
    parts = split_urls(url.withColumnRenamed("url", "page_id").select("page_id", F.col("page_id").alias("url"))).where("host <> ''")
    return parts.groupBy(canonical(F.col("host"), F.col("path")).alias("canonical")).agg(F.count("*").alias("n")).where("n > 1").select("canonical")


#: Fixed values of the query: (host, path, verdict).
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages, RULES, spelled_twice(pages))


ORACLE = r"""
WITH a AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, url, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
q AS (SELECT page_id, url, coalesce(host, '') AS host, coalesce(path, '') AS path,
             regexp_replace(coalesce(host, ''), '^(www|m)\.', '') || regexp_replace(coalesce(path, ''), '(\.html|/)$', '') AS canonical FROM p),
t AS (SELECT canonical FROM q WHERE host <> '' GROUP BY canonical HAVING count(DISTINCT url) > 1),
r(host, path, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m AS (SELECT q.host, q.path, max_by(r.host || r.path, length(r.host || r.path)) AS rule, max_by(r.verdict, length(r.host || r.path)) AS verdict
      FROM (SELECT DISTINCT host, path FROM q) q JOIN r ON (q.host = r.host OR ends_with(q.host, '.' || r.host)) AND starts_with(q.path, r.path) GROUP BY q.host, q.path)
SELECT q.page_id, q.host, q.path, m.rule, coalesce(m.verdict, CASE WHEN q.host <> '' AND q.canonical IN (SELECT canonical FROM t) THEN 'block' ELSE 'allow' END) AS verdict
FROM q LEFT JOIN m ON q.host = m.host AND q.path = m.path
"""
