"""Queries over files, references, token claims, messages and scores, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import tex, text
from quire.operators import metrics, requests
from quire.registry import query, read
from quire.sources import files, tables


def folder(spark: SparkSession, name: str) -> str:
    return f"{tables.shared_folder(spark)}/files/{name}-{uuid.uuid4().hex}"


# --- files -------------------------------------------------------------------------


@query(r"SELECT regexp_replace('item ' || item_id, '[^\w.-]', '_', 'g') AS key, text AS tex, octet_length(encode(text)) AS bytes FROM benchmark")
def tex_files(spark, sf):
    """Every benchmark text as a .tex file, listed and read again."""
    where = folder(spark, "tex")
    made = files.write_tex(read(spark, sf, "benchmark").select(F.concat(F.lit("item "), "item_id").alias("name"), F.col("text").alias("tex")), where)
    made.write.format("noop").mode("overwrite").save()
    sizes = files.inventory(spark, where).select(F.regexp_extract("path", r"([^/]+)\.tex\z", 1).alias("key"), F.col("length").alias("bytes"))
    return files.tex_corpus(spark, where).join(sizes, "key")


@query("SELECT 'f' || item_id AS file, 'c' || item_id % 3 AS cond, text AS gt FROM benchmark")
def manifest_rows(spark, sf):
    """A manifest is one JSON array in one file: here of the benchmark's rows."""
    where = folder(spark, "manifest")
    rows = read(spark, sf, "benchmark").select(F.concat(F.lit("f"), "item_id").alias("file"), F.concat(F.lit("c"), F.col("item_id") % 3).alias("cond"), F.col("text").alias("gt"))
    rows.agg(F.to_json(F.collect_list(F.struct("file", "cond", "gt"))).alias("value")).write.text(where)
    return files.manifest(spark, where, "file string, cond string, gt string")


PATTERNS = [r'href="([^"]+)"', r"src='([^']+)'", r'src="([^"]+)"']
REFERENCES = r"(SELECT DISTINCT file, path FROM (SELECT url AS file, unnest(list_concat(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1), regexp_extract_all(html, 'src=''([^'']+)''', 1), regexp_extract_all(html, 'src=\"([^\"]+)\"', 1))) AS path FROM pages) WHERE NOT regexp_matches(path, '^(?:https?:|#)|\.$'))"


def page_references(spark: SparkSession, sf: str) -> DataFrame:
    return files.references(read(spark, sf, "pages").select(F.col("url").alias("file"), F.col("html").alias("text")), PATTERNS, r"^(?:https?:|#)|\.$")


@query(f"SELECT file, path FROM {REFERENCES}")
def references(spark, sf):
    """Paths that pages name, each once a page; outside ones are left out."""
    return page_references(spark, sf)


@query(f"SELECT path, list_sort(list(DISTINCT file)) AS files FROM {REFERENCES} WHERE path NOT IN (SELECT '/' || string_split(text, ' ')[1] FROM documents WHERE text IS NOT NULL) GROUP BY path")
def missing_references(spark, sf):
    """Paths for which no document begins with that word, with the pages that name them."""
    there = read(spark, sf, "documents").where("text IS NOT NULL").select(F.concat(F.lit("/"), F.split("text", " ")[0]).alias("path"))
    return files.missing_references(page_references(spark, sf), there)


@query(r"SELECT page_id, CASE WHEN regexp_matches(url, '^http://m\.') THEN regexp_replace(url, '^http://m\.', 'mobile:') WHEN regexp_matches(url, '\.html(#.*)?$') THEN regexp_replace(url, '\.html(#.*)?$', '/') WHEN regexp_matches(url, '/en/') THEN regexp_replace(url, '/en/', '/', 'g') ELSE url END AS path FROM pages")
def rewritten_paths(spark, sf):
    """The first rule that matches rewrites."""
    return read(spark, sf, "pages").select("page_id", files.rewritten(F.col("url"), [(r"^http://m\.", "mobile:"), (r"\.html(#.*)?$", "/"), ("/en/", "/")]).alias("path"))


@query("SELECT doc, total, greatest(0, total - 10) AS dropped, unnest(range(1, CAST(greatest(least(total, 10), 1) AS BIGINT) + 1)) AS unit FROM (SELECT doc_id AS doc, coalesce(CASE WHEN doc_id % 9 > 0 THEN n_chars // 500 END, 1) AS total FROM documents)")
def page_units(spark, sf):
    """Pages of documents, ten at most; one where they couldn't be counted."""
    return files.units(read(spark, sf, "documents").select(F.col("doc_id").alias("doc"), F.when(F.col("doc_id") % 9 > 0, F.expr("n_chars div 500")).alias("total")))


# --- requests ------------------------------------------------------------------------


@query("""SELECT o_orderkey, o_orderstatus <> 'P' AND o_orderkey % 10 > 0 AND o_custkey % 9 > 0 AND o_orderpriority <> '5-LOW' AND o_orderdate > TIMESTAMP '1995-01-01' AND (o_custkey % 4 > 0 OR o_orderdate >= TIMESTAMP '1996-01-01') AND o_custkey % 13 > 0 AS valid FROM orders""")
def token_claims(spark, sf):
    """Headers and claims of tokens: each rule is broken by some orders."""
    now = F.unix_seconds(F.lit("1995-01-01").cast("timestamp"))
    at = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    claims = F.struct(
        F.when(F.col("o_orderstatus") == "P", "none").otherwise("RS256").alias("alg"), F.when(F.col("o_orderkey") % 10 == 0, "k9").otherwise("k1").alias("kid"), F.when(F.col("o_custkey") % 9 == 0, "x").otherwise("p").alias("aud"),
        F.lit("issuer/p").alias("iss"), F.when(F.col("o_orderpriority") == "5-LOW", "").otherwise("s").alias("sub"), at.alias("exp"), now.alias("iat"), at.alias("auth_time"),
        F.when(F.col("o_custkey") % 4 == 0, F.unix_seconds(F.lit("1996-01-01").cast("timestamp"))).alias("valid_since"), (F.col("o_custkey") % 13 == 0).alias("disabled"),
    )
    rows = read(spark, sf, "orders").withColumn("claims", claims)
    return rows.select("o_orderkey", requests.claims_valid(F.col("claims"), "p", "issuer/p", ["k1", "k2"], now).alias("valid"))


CODES = "list_extract(['USER_DISABLED', 'TOO_MANY_ATTEMPTS_TRY_LATER', 'CONFIGURATION_NOT_FOUND', 'EMAIL_NOT_FOUND', 'MISSING_EMAIL', 'OTHER'], CAST(event_id % 7 + 1 AS BIGINT))"


@query(f"""SELECT event_id, CASE c WHEN 'USER_DISABLED' THEN 'This account has been disabled.' WHEN 'TOO_MANY_ATTEMPTS_TRY_LATER' THEN 'Too many failed attempts. Please try again later.' WHEN 'CONFIGURATION_NOT_FOUND' THEN 'Authentication is not configured. Please contact the administrator.' ELSE 'Invalid email or password' END AS sign_in,
 CASE WHEN c IN ('EMAIL_NOT_FOUND', 'INVALID_EMAIL', 'MISSING_EMAIL') THEN NULL WHEN c = 'TOO_MANY_ATTEMPTS_TRY_LATER' THEN 'Too many requests. Please try again later.' ELSE 'The reset email could not be sent. Please try again.' END AS reset FROM (SELECT event_id, {CODES} AS c FROM events)""")
def account_messages(spark, sf):
    codes = F.array(*(F.lit(c) for c in ("USER_DISABLED", "TOO_MANY_ATTEMPTS_TRY_LATER", "CONFIGURATION_NOT_FOUND", "EMAIL_NOT_FOUND", "MISSING_EMAIL", "OTHER")))
    code = F.get(codes, (F.col("event_id") % 7).cast("int"))
    return read(spark, sf, "events").select("event_id", requests.message(code, requests.SIGN_IN_ERRORS, requests.SIGN_IN_DEFAULT).alias("sign_in"), requests.reset_message(code).alias("reset"))


# --- scores --------------------------------------------------------------------------


@query("SELECT item_id, t IS NOT NULL AS present, coalesce(t IS NOT DISTINCT FROM text AND n = length(text), false) AS same FROM benchmark LEFT JOIN (SELECT item_id AS k, CASE WHEN item_id % 4 = 0 THEN text || '!' ELSE text END AS t, length(text) AS n FROM benchmark WHERE item_id % 3 > 0) ON item_id = k")
def golden_comparison(spark, sf):
    """Items against golden rows; one that has none fails."""
    items = read(spark, sf, "benchmark").withColumn("n", F.length("text"))
    golden = items.where("item_id % 3 > 0").withColumn("text", F.when(F.col("item_id") % 4 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return metrics.against_golden(items, golden, "item_id", ["text", "n"])


SCORED = r"(SELECT item_id, 'c' || item_id % 3 AS cond, regexp_replace(regexp_replace(text, '[^A-Za-z0-9 ]', '', 'g'), '\s+', '', 'g') AS t, regexp_replace(regexp_replace(text, '[^A-Za-z0-9 ]', '', 'g'), '\s+', '', 'g') || CASE WHEN item_id % 2 = 0 THEN 'xyz' ELSE '' END AS g FROM benchmark)"


@query(f"SELECT item_id, cond, t, g FROM {SCORED} WHERE t <> g ORDER BY item_id LIMIT 6")
def first_mismatches(spark, sf):
    """The report's six first formulas that aren't exact."""
    plain = F.regexp_replace("text", "[^A-Za-z0-9 ]", "")
    rows = read(spark, sf, "benchmark").select("item_id", F.concat(F.lit("c"), F.col("item_id") % 3).alias("cond"), plain.alias("truth"), F.concat(plain, F.expr("CASE WHEN item_id % 2 = 0 THEN 'xyz' ELSE '' END")).alias("guess"))
    return metrics.mismatches(metrics.scored(rows))


@query(r"""WITH RECURSIVE t AS (SELECT item_id, regexp_extract_all(substr(s, 1, 60), '(?s)\\[A-Za-z]+|.') AS a, regexp_extract_all(substr(replace(s, 'a', '\al '), 3, 60), '(?s)\\[A-Za-z]+|.') AS b FROM (SELECT item_id, '\frac{x}' || text AS s FROM benchmark)),
r AS (SELECT item_id, a, b, 0 AS i, range(0, len(b) + 1) AS row FROM t UNION ALL
SELECT item_id, a, b, i + 1, list_reduce(list_prepend([CAST(i + 1 AS BIGINT)], list_transform(range(1, len(b) + 1), lambda j: [row[j] + CASE WHEN a[i + 1] <> b[j] THEN 1 ELSE 0 END, row[j + 1] + 1])), lambda acc, x: list_append(acc, least(x[1], x[2], acc[len(acc)] + 1))) FROM r WHERE i < len(a))
SELECT item_id, a AS tokens, CAST(row[len(b) + 1] AS INT) AS edits FROM r WHERE i = len(a)""")
def token_edits(spark, sf):
    """Levenshtein distance of token lists."""
    s = F.concat(F.lit("\\frac{x}"), "text")
    a, b = text.tokens(F.substring(s, 1, 60)), text.tokens(F.substring(F.replace(s, F.lit("a"), F.lit("\\al ")), 3, 60))
    return read(spark, sf, "benchmark").select("item_id", a.alias("tokens"), tex.token_edits(a, b).alias("edits"))
