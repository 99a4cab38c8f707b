"""6. URL filters: host-suffix and path-prefix rules, by hash prefix and full digest.

Each URL is expanded into the expressions host suffix + path prefix that a rule could be: every suffix of the host at
a dot, times the path's prefixes of those lengths that rules have. Rules and expressions meet in an equi-join on the
first 32 bits of the expression's SHA-256; the whole digest then confirms, and the longest rule wins (of equal length
the longer host; of equal rules, block). Only expression functions of the JVM; the rule table is broadcast only while
Spark's own size threshold allows, else it is joined by shuffle. URLs are expanded once for each distinct
(host, path), so that a frequent page costs as much as a rare one, and rows learn the verdict by (host, path), those
of frequent pages by broadcast (util.looked_up).

A URL that is null or has no ``://`` has empty host and path and fits no rule. Null rule fields drop the rule. Rows
with a null id are kept, repeated rows are judged each. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .util import looked_up, stored, table

RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
DEFAULT = "allow"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def judge(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT) -> DataFrame:
    """id, host, path, rule, verdict of every row of ``urls``; ``rules`` has host, path, verdict."""
    own = rules.dropna(subset=["host", "path", "verdict"]).select(F.concat("host", "path").alias("rule"), F.length("host").alias("host_chars"), F.length("path").alias("path_chars"), "verdict")
    own = own.groupBy("rule", "host_chars", "path_chars").agg(F.max(F.col("verdict") == "block").alias("block"))
    own = own.withColumn("digest", F.sha2(F.concat_ws("\n", "host_chars", "rule"), 256)).withColumn("short", F.substring("digest", 1, 8))
    # distinct lengths of rule paths: bounded by the longest URL path, a few hundred in practice
    sizes = sorted(r[0] for r in own.select("path_chars").distinct().collect())
    rows = urls.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    dots = F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.length("host"), F.lit(1))), lambda i: F.substr("host", i, F.lit(1)) == "."), lambda i: F.substr(F.col("host"), i + 1))
    suffixes = F.array_distinct(F.concat(F.array("host"), dots))
    prefixes = F.filter(F.array(*[F.lit(n) for n in sizes]).cast("array<int>"), lambda n: n <= F.length("path"))
    named = (F.col("host") != "") | (F.col("path") != "")
    pages = stored(rows.where(named).groupBy("host", "path").agg(F.count("*").alias("n")), "pages")
    asked = pages.select("host", "path", F.explode(suffixes).alias("suffix")).select("host", "path", "suffix", F.explode(F.transform(prefixes, lambda n: F.substr(F.col("path"), F.lit(1), n))).alias("prefix"))
    asked = asked.withColumn("digest", F.sha2(F.concat_ws("\n", F.length("suffix"), F.concat("suffix", "prefix")), 256))
    hits = asked.withColumn("short", F.substring("digest", 1, 8)).alias("a").join(own.alias("r"), F.col("a.short") == F.col("r.short")).where(F.col("a.digest") == F.col("r.digest"))
    order = F.struct(F.length("rule").alias("n"), "host_chars", "block", "rule")
    best = hits.groupBy(F.col("host").alias("h"), F.col("path").alias("p")).agg(F.max(order).alias("best"))
    verdict = F.when(F.col("best").isNull(), default).when(F.col("best.block"), "block").otherwise("allow")
    judged = pages.join(best, (F.col("host") == F.col("h")) & (F.col("path") == F.col("p")), "left")
    judged = stored(judged.select("host", "path", "n", F.col("best.rule").alias("rule"), verdict.alias("verdict")), "verdicts")
    nowhere = rows.where(~named).select(id_col, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    return looked_up(rows.where(named), judged, ["host", "path"], "n").select(nowhere.columns).unionByName(nowhere)


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), rule_table(spark))


SQL = """
WITH u AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m AS (SELECT page_id, host, path, h || p AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC NULLS LAST, length(h) DESC) AS k
      FROM u LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE k = 1
"""
