"""URL filters by a blocked Bloom filter and an exact hash join.

Every rule is a canonical (host, path) key: it fits its host and all subdomains when the
url's path starts with the rule's path. A url therefore has one candidate key for each
suffix of its host at a label border and each path length that occurs among the rules. A
blocked Bloom filter over the listed keys (one 512-bit block a key, one bit in each of eight
64-bit words) passes the possible hits; an exact hash join removes its false positives; the
longest fitting rule wins (equal lengths: the longer host). DataFrame functions only.

Defined results: null or ``://``-less urls have empty host and path, fit no rule and get the
default verdict; an empty path fits only rules with an empty path; repeated rows stay
repeated; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Shelf, hot_keys, spread_join, table

#: Odd multipliers, one for each word of a block (fixed values of this filter).
SALTS = (0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The filter is broadcast only up to this size; above it, it is joined by shuffle.
BROADCAST_BYTES = 32 << 20

#: The production rules (verdict, host, path).
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased;
    path: from there up to ``?``, ``#`` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def _words(h: Column) -> list[Column]:
    """The eight one-bit masks of a 64-bit hash."""
    low = h.bitwiseAND(F.lit(0x7FFFFFFF))  # 31 bits times 32 bits stay within a long
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(low * F.lit(s), 26).bitwiseAND(F.lit(63)).cast("int")) for s in SALTS]


def _key(host: Column, path: Column) -> Column:
    return F.concat(host, F.lit("\x00"), path)


def bloom(rules: DataFrame, blocks: int) -> DataFrame:
    """(block, w0..w7): the OR of the masks of the keys that fall in a block."""
    h = F.xxhash64(_key(F.col("r_host"), F.col("r_path")))
    masks = [m.alias(f"m{i}") for i, m in enumerate(_words(h))]
    keyed = rules.select(F.pmod(F.shiftrightunsigned(h, 32), F.lit(blocks)).alias("block"), *masks)
    return keyed.groupBy("block").agg(*[F.bit_or(f"m{i}").alias(f"w{i}") for i in range(8)])


def filter_urls(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow", keys_per_block: int = 32) -> DataFrame:
    """(id, host, path, rule, verdict) for every row of ``pages``.

    ``rules`` has verdict, host and path; repeated (host, path) keep the smallest verdict."""
    rules = rules.select(F.translate("host", UPPER, LOWER).alias("r_host"), F.col("path").alias("r_path"), "verdict").where("r_host IS NOT NULL AND r_path IS NOT NULL")
    rules = rules.groupBy("r_host", "r_path").agg(F.min("verdict").alias("r_verdict"))
    # The distinct path lengths are bounded by the longest path of a rule.
    stats = rules.agg(F.count("*").alias("n"), F.collect_set(F.length("r_path")).alias("lens")).first()
    lengths = sorted(stats["lens"])
    blocks = max(1, -(-stats["n"] // keys_per_block))

    host, path = host_and_path(F.col(url_col).cast("string"))
    shelf = Shelf(pages.sparkSession, "urls")
    rows = pages.select(F.col(id_col).alias("_id"), host.alias("host"), path.alias("path"))
    full = rows.where("host <> '' OR path <> ''")
    # A url is resolved once, however many rows have it: partial aggregation precedes the shuffle.
    keys = shelf.put(full.groupBy("host", "path").agg(F.count("*").alias("n")))
    hot = hot_keys(keys, ["host", "path"], keys.agg(F.sum("n")).first()[0] or 0)

    labels = F.split("host", r"\.", -1)
    suffix = keys.select("host", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("c_host"))
    lens = F.array(*[F.lit(n) for n in lengths]) if lengths else F.array().cast("array<int>")
    fits = suffix.select("host", "path", "c_host", F.explode(F.filter(lens, lambda n: n <= F.length("path"))).alias("_n")).select("host", "path", "c_host", F.expr("substring(path, 1, _n)").alias("c_path"))

    h = F.xxhash64(_key(F.col("c_host"), F.col("c_path")))
    filt = bloom(rules, blocks)
    if blocks * 72 <= BROADCAST_BYTES:
        filt = F.broadcast(filt)
    probe = fits.withColumn("_h", h).withColumn("block", F.pmod(F.shiftrightunsigned("_h", 32), F.lit(blocks)))
    passed = reduce(lambda a, b: a & b, [F.col(f"w{i}").bitwiseAND(m) == m for i, m in enumerate(_words(F.col("_h")))])
    possible = probe.join(filt, "block").where(passed).select("host", "path", "c_host", "c_path")

    small = stats["n"] * 4096 <= BROADCAST_BYTES
    hits = possible.join(F.broadcast(rules) if small else rules, (F.col("c_host") == F.col("r_host")) & (F.col("c_path") == F.col("r_path")))
    best = hits.groupBy("host", "path").agg(
        F.max(F.struct((F.length("r_host") + F.length("r_path")).alias("n"), F.length("r_host").alias("nh"), F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("v"))).alias("b")
    ).select("host", "path", F.col("b.rule").alias("rule"), F.col("b.v").alias("v"))
    # Rows without a url need no join, and rows of one common url are dealt to several tasks.
    salt = F.col("_id").cast("string")
    out = spread_join(full.withColumn("_by", F.xxhash64(salt)), best, ["host", "path"], "_by", hot, "left").select("_id", "host", "path", "rule", "v")
    bare = rows.where("host = '' AND path = ''").select("_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("v"))
    return out.union(bare).select(F.col("_id").alias(id_col), "host", "path", "rule", F.coalesce("v", F.lit(default)).alias("verdict"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    return filter_urls(table(spark, sf_dir, "pages"), rules)


OP5_SQL = r"""
WITH r(verdict, rhost, rpath) AS (VALUES ('allow','com','/'), ('block','example.com','/en/'), ('allow','www.example.com','/en/'), ('block','net','/es/'), ('block','net','/fr/')),
a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS n FROM a),
m AS (SELECT p.n, max_by(r.rhost || r.rpath, length(r.rhost || r.rpath) * 10000 + length(r.rhost)) AS rule,
  max_by(r.verdict, length(r.rhost || r.rpath) * 10000 + length(r.rhost)) AS verdict
  FROM p JOIN r ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath) GROUP BY p.n)
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM p LEFT JOIN m ON p.n = m.n
"""
