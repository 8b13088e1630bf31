"""URL rules by a sort-merge range join.

A rule (host, path prefix) is an interval of canonical keys: the host's labels
from the right, a zero byte, the path. A url has such a key for every suffix of
its host that a rule could name. Keys and rules are dealt out to ranges of keys
and swept in order; the stack holds the rules that enclose the current key, one
inside the other, and its top is the longest.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import column_of, per_batch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for null or where no :// is."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(url)), r"\A[^?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def reversed_host(labels: Column) -> Column:
    return F.array_join(F.reverse(labels), ".")


def interval(host: Column, path: Column) -> Column:
    """Where a rule's keys begin: all of them have this prefix."""
    return F.concat(reversed_host(F.split(host, r"\.")), F.lit("\0"), path).cast("binary")


def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (range, key, is_url, host, path, rule) in order; gives the urls' keys with the innermost rule."""
    stack: list[tuple[bytes, tuple]] = []
    now = None
    for b in batches:
        hosts, paths, found = [], [], []
        for part, key, is_url, host, path, rule in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if part != now:
                now, stack = part, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if not is_url:
                stack.append((key, rule))
            elif stack:
                hosts.append(host)
                paths.append(path)
                found.append(stack[-1][1])
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(found, RULE_ARROW)], names=["host", "path", "rule"])


RULE = "struct<size:int,labels:int,host:string,path:string,verdict:string>"
RULE_ARROW = pa.struct([("size", pa.int32()), ("labels", pa.int32()), ("host", pa.string()), ("path", pa.string()), ("verdict", pa.string())])


def match_rules(spark: SparkSession, urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The longest rule that fits each (host, path) of urls: host, path, rule. Those that none fits are left out.

    Of rules that fit, the one with the longest text (host and path) wins; of
    equally long ones the longer host; of equal ones block. Equal urls are swept
    once, so one url may hold any share of the rows. A rule whose interval
    crosses the border of a range is put into each range that it crosses, so
    nothing is broadcast but the borders, one fewer than partitions. Rules with
    a null host or path are left out; empty urls or rules give no rows.
    """
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    host, path = F.col("host"), F.col("path")
    rules = rules.select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict").where(host.isNotNull() & path.isNotNull())
    rule = F.struct((F.length(host) + F.length(path)).cast("int").alias("size"), F.size(F.split(host, r"\.")).cast("int").alias("labels"), host, path, F.max("verdict").alias("verdict")).cast(RULE)
    rules = rules.groupBy("host", "path").agg(rule.alias("rule")).withColumn("key", interval(host, path))
    deepest = rules.agg(F.max("rule.labels")).first()[0] or 0  # no longer suffix of a host can match
    labels = F.split(host, r"\.")
    suffix = F.explode(F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(max(1, deepest)))), lambda k: F.slice(labels, -k, k)))
    keys = urls.select("host", "path").distinct().select("host", "path", suffix.alias("suffix")).select("host", "path", F.concat(reversed_host(F.col("suffix")), F.lit("\0"), path).cast("binary").alias("key"))
    sample = sorted(bytes(r[0]) for r in keys.select("key").orderBy(F.xxhash64("key")).limit(64 * n).collect())
    borders = sorted({sample[len(sample) * i // n] for i in range(1, n)}) if sample else []

    def deal_urls(b: pa.RecordBatch) -> pa.RecordBatch:
        part = [bisect_right(borders, k) for k in b.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *b.columns], names=["part", "host", "path", "key"])

    def deal_rules(b: pa.RecordBatch) -> pa.RecordBatch:
        # Keys are UTF-8 and never contain the byte 255, so key + 255 ends the interval.
        part = [[*range(bisect_right(borders, k), bisect_left(borders, k + b"\xff") + 1)] for k in b.column(0).to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array(part, pa.list_(pa.int32())), *b.columns], names=["parts", "key", "rule"])

    swept = ["part", "key", "is_url", "host", "path", "rule"]
    left = keys.mapInArrow(per_batch(deal_urls), "part int, host string, path string, key binary").select("part", "key", F.lit(True).alias("is_url"), "host", "path", F.lit(None).cast(RULE).alias("rule"))
    right = rules.select("key", "rule").mapInArrow(per_batch(deal_rules), f"parts array<int>, key binary, rule {RULE}").select(F.explode("parts").alias("part"), "key", F.lit(False).alias("is_url"), F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"), "rule")
    ordered = left.unionByName(right).select(swept).repartition(n, "part").sortWithinPartitions("part", "key", "is_url")
    return ordered.mapInArrow(sweep, f"host string, path string, rule {RULE}").groupBy("host", "path").agg(F.max("rule").alias("rule"))


def judge(spark: SparkSession, df: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """(doc, host, path, rule, verdict) for each row: doc is the row as a struct, so its names clash with none; rule a struct or null.

    A url that no rule fits gets the default. Null urls, and those without ://,
    have an empty host and path, which no rule fits. Urls are matched whole,
    however long; repeated rows repeat; an empty table gives none.
    """
    host, path = split_url(column_of(df, url_col))
    urls = df.select(F.struct("*").alias("doc"), host.alias("host"), path.alias("path"))
    best = match_rules(spark, urls.select("host", "path"), rules).select(F.col("host").alias("h"), F.col("path").alias("p"), "rule")
    out = urls.join(best, (F.col("host") == F.col("h")) & (F.col("path") == F.col("p")), "left")
    return out.select("doc", "host", "path", "rule", F.coalesce("rule.verdict", F.lit(default)).alias("verdict"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule and verdict."""
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    out = judge(spark, spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), rules)
    return out.select("doc.page_id", "host", "path", F.concat("rule.host", "rule.path").alias("rule"), "verdict")


OP6_SQL = """
WITH u AS (
  SELECT page_id, url, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*', 0)) + 1), '^[^?#]*', 0) AS path FROM u
), hp AS (SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path FROM h),
r(rh, rp, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m AS (
  SELECT host, path, rh || rp AS rule, v, row_number() OVER (PARTITION BY host, path ORDER BY length(rh || rp) DESC, length(rh) DESC) AS k
  FROM (SELECT DISTINCT host, path FROM hp) JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
)
SELECT page_id, hp.host, hp.path, m.rule, coalesce(m.v, 'allow') AS verdict
FROM hp LEFT JOIN m ON hp.host = m.host AND hp.path = m.path AND m.k = 1
"""
