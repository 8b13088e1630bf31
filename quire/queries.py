"""Queries over the driver's tables for the document-processing operators, with their SQL.

Tables without a counterpart stand in for the service's own: events are its
history and its request log, conversations its attempts, lineitem its boxes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import tex, text
from quire.operators import availability, history, layout, limiter, metrics, requests
from quire.plans import chain
from quire.registry import QUERIES, SQL, query, read
from quire.sources import tables
from quire.streaming.limiter import limited_stream

__all__ = ["QUERIES", "SQL"]


# --- history ---------------------------------------------------------------------


def store(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").select(F.col("event_id").alias("doc_id"), F.col("user_id").alias("uid"), F.col("ts").alias("timestamp"), F.col("event_type").alias("ocrType"), F.col("value"))


RANKED = "SELECT event_id AS doc_id, user_id AS uid, ts AS timestamp, event_type AS \"ocrType\", value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS rank FROM events WHERE ts IS NOT NULL"


@query(f"SELECT doc_id, uid, timestamp, \"ocrType\", value, CAST(rank AS INT) AS rank FROM ({RANKED}) WHERE rank <= 20")
def history_recent(spark, sf):
    return history.recent(store(spark, sf))


@query("SELECT event_id AS doc_id, user_id AS uid, ts AS timestamp FROM events WHERE user_id = 7 AND ts IS NOT NULL ORDER BY ts DESC, event_id LIMIT 20")
def history_user_top(spark, sf):
    return history.recent_of(store(spark, sf), 7).select("doc_id", "uid", "timestamp")


@query("SELECT event_id AS doc_id FROM events WHERE user_id = 7 AND ts IS NOT NULL ORDER BY ts DESC, event_id LIMIT 50 OFFSET 20")
def history_page(spark, sf):
    return history.recent_of(store(spark, sf), 7, 50, 20).select("doc_id")


@query(f"SELECT doc_id FROM ({RANKED}) WHERE rank BETWEEN 21 AND 70")
def history_surplus(spark, sf):
    return history.surplus(store(spark, sf))


@query(f"SELECT event_id AS doc_id, user_id AS uid FROM events WHERE event_id NOT IN (SELECT doc_id FROM ({RANKED}) WHERE rank BETWEEN 21 AND 70)")
def history_retained(spark, sf):
    return history.retained(store(spark, sf)).select("doc_id", "uid")


@query("SELECT event_id AS doc_id, user_id AS uid, value FROM events WHERE event_id = 17 AND user_id = (SELECT max(user_id) FROM events WHERE event_id = 17) UNION ALL SELECT event_id, user_id, value FROM events WHERE event_id = 18 AND user_id = (SELECT max(user_id) + 1 FROM events WHERE event_id = 18)")
def history_item_owner(spark, sf):
    """One id asked for by its owner, another by a stranger."""
    rows = store(spark, sf)
    owner, stranger = rows.where("doc_id = 17").agg(F.max("uid")), rows.where("doc_id = 18").agg(F.max("uid") + 1)
    return history.owned_item(rows, "17", owner).unionByName(history.owned_item(rows, "18", stranger)).select("doc_id", "uid", "value")


@query("SELECT doc_id, '' AS \"fileName\", CASE WHEN coalesce(lang, '') = '' THEN 'convert' ELSE lang END AS \"ocrType\", n_chars AS timestamp, length(coalesce(text, '')) > 2000 AS truncated FROM documents")
def history_list_defaults(spark, sf):
    docs = read(spark, sf, "documents")
    return history.listed(docs.select("doc_id", F.lit(None).cast("string").alias("fileName"), F.col("lang").alias("ocrType"), F.col("n_chars").alias("timestamp"), (F.length(F.coalesce("text", F.lit(""))) > 2000).alias("truncated")))


@query("""SELECT c_custkey AS uid, coalesce(l.email, c_name) AS email, coalesce(l.name, 'old') AS "displayName", coalesce(c_acctbal_at, l.first_at) AS "createdAt", l.last_at AS "lastLogin"
FROM (SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN TIMESTAMP '2020-01-01 00:00:00' END AS c_acctbal_at FROM customer) c
LEFT JOIN (SELECT user_id, arg_max(event_type, ts) AS email, coalesce(arg_max({'x': nullif(event_type, 'click')}, ts).x, '') AS name, min(ts) AS first_at, max(ts) AS last_at FROM (SELECT DISTINCT ON (user_id, ts) * FROM events ORDER BY user_id, ts, event_id) GROUP BY user_id) l ON c_custkey = user_id
UNION ALL SELECT user_id, arg_max(event_type, ts), coalesce(arg_max({'x': nullif(event_type, 'click')}, ts).x, ''), min(ts), max(ts) FROM (SELECT DISTINCT ON (user_id, ts) * FROM events ORDER BY user_id, ts, event_id) WHERE user_id NOT IN (SELECT c_custkey FROM customer) GROUP BY user_id""")
def profile_upsert(spark, sf):
    profiles = read(spark, sf, "customer").select(F.col("c_custkey").alias("uid"), F.col("c_name").alias("email"), F.lit("old").alias("displayName"), F.when(F.col("c_custkey") % 3 == 0, F.lit("2020-01-01").cast("timestamp_ntz")).alias("createdAt"), F.lit(None).cast("timestamp_ntz").alias("lastLogin"))
    first = Window.partitionBy("user_id", "ts").orderBy("event_id")
    logins = read(spark, sf, "events").withColumn("k", F.row_number().over(first)).where("k = 1").select(F.col("user_id").alias("uid"), F.col("event_type").alias("email"), F.nullif("event_type", F.lit("click")).alias("displayName"), F.col("ts").alias("at"))
    return history.upserted_profiles(profiles, logins)


@query("""SELECT coalesce(c_custkey, s_suppkey) AS key, coalesce(s_name, c_name) AS name, coalesce(s_acctbal, c_acctbal) AS acctbal, c_mktsegment AS segment
FROM customer FULL OUTER JOIN (SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal END AS s_acctbal FROM supplier) ON c_custkey = s_suppkey""")
def merge_fields(spark, sf):
    rows = read(spark, sf, "customer").selectExpr("c_custkey key", "c_name name", "c_acctbal acctbal", "c_mktsegment segment")
    patches = read(spark, sf, "supplier").selectExpr("s_suppkey key", "s_name name", "CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal END acctbal")
    return history.merged(rows, patches, "key")


@query("""SELECT coalesce(c_custkey, s_suppkey) AS key, CASE WHEN s_suppkey IS NULL THEN c_name ELSE s_name END AS name, CASE WHEN s_suppkey IS NULL THEN c_acctbal ELSE s_acctbal END AS acctbal, c_mktsegment AS segment
FROM customer FULL OUTER JOIN (SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal END AS s_acctbal FROM supplier) ON c_custkey = s_suppkey""")
def merge_listed_fields(spark, sf):
    """A listed field is written even where it is null."""
    rows = read(spark, sf, "customer").selectExpr("c_custkey key", "c_name name", "c_acctbal acctbal", "c_mktsegment segment")
    patches = read(spark, sf, "supplier").selectExpr("s_suppkey key", "s_name name", "CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal END acctbal")
    return history.merged(rows, patches, "key", ["name", "acctbal"])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def delete_anti(spark, sf):
    gone = read(spark, sf, "lineitem").where("l_returnflag = 'R'").selectExpr("l_orderkey o_orderkey")
    return history.deleted(read(spark, sf, "orders").select("o_orderkey", "o_custkey"), gone, "o_orderkey")


@query(f"SELECT uid, list({{'at': timestamp, 'doc_id': doc_id}} ORDER BY timestamp DESC, doc_id DESC)[1].doc_id AS newest, count(*) AS n FROM ({RANKED}) WHERE rank <= 20 GROUP BY uid")
def guest_lists(spark, sf):
    got = history.guest_entries(read(spark, sf, "events").selectExpr("event_id doc_id", "user_id uid", "ts at"))
    return got.select("uid", F.col("entries")[0]["doc_id"].alias("newest"), F.size("entries").cast("bigint").alias("n"))


GUESTS = f"(SELECT uid, list(doc_id ORDER BY timestamp DESC, doc_id DESC) AS ids FROM ({RANKED}) WHERE rank <= 20 GROUP BY uid)"


@query(f"SELECT coalesce(uid, k) AS uid, CASE WHEN coalesce(uid, k) % 5 = 0 THEN CAST([] AS BIGINT[]) ELSE list_filter(list_concat(CASE WHEN k IS NULL THEN [] ELSE [-k] END, coalesce(ids, []))[1:20], lambda x, i: i <> 2) END AS ids FROM {GUESTS} FULL OUTER JOIN (SELECT c_custkey AS k FROM customer WHERE c_custkey <= 20) ON uid = k")
def guest_list_edits(spark, sf):
    """An entry is added in front, the second removed, and every fifth guest's list cleared."""
    lists = history.guest_entries(read(spark, sf, "events").selectExpr("event_id doc_id", "user_id uid", "ts at"))
    new = read(spark, sf, "customer").where("c_custkey <= 20").selectExpr("c_custkey uid", "TIMESTAMP_NTZ'2030-01-01 00:00:00' at", "-c_custkey doc_id")
    edited = history.guest_removed(history.guest_added(lists, new), 1)
    return history.guest_cleared(edited, edited.where("uid % 5 = 0")).select("uid", F.transform("entries", lambda e: e["doc_id"]).alias("ids"))


@query("SELECT doc_id FROM (SELECT event_id AS doc_id, CASE WHEN event_id % 4 > 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S.%f') ELSE '' END AS t FROM events WHERE user_id = 7 ORDER BY event_id LIMIT 270) ORDER BY t DESC, doc_id LIMIT 50 OFFSET 20")
def history_unindexed(spark, sf):
    """Surplus without an index: text order of times, missing ones last."""
    rows = store(spark, sf).withColumn("timestamp", F.when(F.col("doc_id") % 4 > 0, F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS")))
    return history.unindexed_surplus(rows, 7)


@query("SELECT doc_id AS id, lang AS uid, CASE WHEN length(text) > 300 THEN substr(text, 1, 300) || chr(10) || '... [truncated]' ELSE text END AS result, length(text) > 300 AS truncated FROM documents WHERE coalesce(lang, '') <> '' AND trim(coalesce(text, '')) <> '' UNION ALL SELECT 0, 'x', 'kept', false")
def history_saved(spark, sf):
    """Results of signed-in owners are stored, cut to the length; guests' and empty ones aren't."""
    old = spark.createDataFrame([(0, "x", "kept", False)], "id bigint, uid string, result string, truncated boolean")
    return history.saved(old, read(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("uid"), F.col("text").alias("result")), 300)


@query("SELECT count(*) AS n, count(*) AS distinct_ids, true AS formed FROM customer")
def document_ids(spark, sf):
    """Random ids: as many different ones as rows, all of twenty letters and digits."""
    made = history.with_document_ids(read(spark, sf, "customer"))
    return made.agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("distinct_ids"), F.bool_and(F.col("doc_id").rlike(r"\A[A-Za-z0-9]{20}\z")).alias("formed"))


# --- text --------------------------------------------------------------------------


@query("SELECT doc_id, CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || chr(10) || '... [truncated]' ELSE text END AS result, length(text) > 500 AS truncated FROM documents")
def truncate_mark(spark, sf):
    cut = text.truncate_mark(F.col("text"), 500)
    return read(spark, sf, "documents").select("doc_id", cut.alias("result"), text.is_truncated(cut).alias("truncated"))


@query(r"""SELECT page_id, coalesce(nullif(regexp_replace(n, '\.[^.]*$', ''), ''), 'document') AS base, regexp_replace(substr(coalesce(nullif(regexp_replace(n, '\.[^.]*$', ''), ''), 'document'), 1, 200), '[^\w.-]', '_', 'g') AS safe, substr(n, 1, 200) AS capped
FROM (SELECT page_id, regexp_extract(url, '[^/]*$') AS n FROM pages)""")
def filename_base(spark, sf):
    name = F.regexp_extract("url", r"[^/]*\z", 0)
    return read(spark, sf, "pages").select("page_id", text.filename_base(name).alias("base"), text.filename_safe(name).alias("safe"), text.filename_cap(name).alias("capped"))


TYPES = ", ".join(f"'{t}'" for t in text.IMAGE_TYPES)
EXTENSIONS = ", ".join(f"'{t}'" for t in text.INPUT_EXTENSIONS)


@query(f"SELECT event_id, CASE WHEN m IN ({TYPES}) THEN m ELSE 'image/png' END AS mime FROM (SELECT event_id, lower(trim(split_part('IMAGE/' || CASE event_id % 4 WHEN 0 THEN 'jpeg; q=1' WHEN 1 THEN 'webp' WHEN 2 THEN 'svg' ELSE ' gif' END, ';', 1))) AS m FROM events)")
def mime_safe(spark, sf):
    kind = F.expr("concat('IMAGE/', CASE event_id % 4 WHEN 0 THEN 'jpeg; q=1' WHEN 1 THEN 'webp' WHEN 2 THEN 'svg' ELSE ' gif' END)")
    return read(spark, sf, "events").select("event_id", text.mime_safe(kind).alias("mime"))


@query(f"SELECT page_id, NOT contains(n, '.') OR lower(regexp_extract(n, '\\.([^.]*)$', 1)) IN ({EXTENSIONS}) AS allowed FROM (SELECT page_id, regexp_extract(url, '[^/]*$') AS n FROM pages)")
def input_allowed(spark, sf):
    return read(spark, sf, "pages").select("page_id", text.input_allowed(F.regexp_extract("url", r"[^/]*\z", 0)).alias("allowed"))


@query("SELECT event_id, CAST(CASE WHEN d IS NULL OR isnan(d) OR isinf(d) THEN 0 ELSE greatest(0, floor(d)) END AS BIGINT) AS attempt FROM (SELECT event_id, TRY_CAST(CASE event_id % 5 WHEN 0 THEN 'x' WHEN 1 THEN '-3' WHEN 2 THEN 'NaN' WHEN 3 THEN '' ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS d FROM events)")
def attempt_number(spark, sf):
    raw = F.expr("CASE event_id % 5 WHEN 0 THEN 'x' WHEN 1 THEN '-3' WHEN 2 THEN 'NaN' WHEN 3 THEN '' ELSE CAST(value AS STRING) END")
    return read(spark, sf, "events").select("event_id", text.attempt_number(raw).alias("attempt"))


@query("SELECT doc_id, sha256(text) AS sha FROM documents")
def sha256_source(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z]{3,}')) >= 3 AS prose, regexp_matches(text, '[=<>^_+]') AS equation FROM documents")
def prose_flag(spark, sf):
    return read(spark, sf, "documents").select("doc_id", text.is_prose(F.col("text")).alias("prose"), text.looks_like_equation(F.col("text")).alias("equation"))


@query("""SELECT conv_id, turn, round(len(list_distinct(w)) / nullif(len(w), 0), 6) AS ratio, len(w) >= 6 AND len(list_distinct(w)) <= 0.25 * len(w) AS loop
FROM (SELECT conv_id, turn, list_filter(string_split_regex(text, '[\\s\\x{00a0}]+'), lambda x: x <> '') AS w FROM conversations)""")
def word_distinct_ratio(spark, sf):
    t = F.col("text")
    return read(spark, sf, "conversations").select("conv_id", "turn", F.round(text.distinct_ratio(t), 6).alias("ratio"), text.looks_like_loop(t).alias("loop"))


# --- LaTeX ---------------------------------------------------------------------------


def sources(spark: SparkSession, sf: str) -> DataFrame:
    """LaTeX sources made from whole documents, with faults by doc_id."""
    body = F.expr("regexp_replace(text, '[^A-Za-z. ]', ' ')")
    fault = F.expr(r"""CASE doc_id % 8 WHEN 0 THEN '' WHEN 1 THEN '\\input{secret}' WHEN 2 THEN '\\inputs{x}' WHEN 3 THEN '% \\input{x}' WHEN 4 THEN '\\write18{ls}' WHEN 5 THEN '\\openin1=f.txt' WHEN 6 THEN '\\section{One} \\frac{a}{b}' ELSE '{ \\left( x $' END""")
    head = F.expr(r"CASE WHEN doc_id % 5 = 0 THEN '' ELSE '\\documentclass{article}\n\\usepackage{amsmath}\n' END")
    made = F.concat(head, F.lit("\\begin{document}\n"), fault, F.lit("\n"), body, F.expr(r"CASE WHEN doc_id % 7 = 0 THEN '' ELSE '\n\\end{document}\n' END"))
    return read(spark, sf, "documents").select("doc_id", "source", made.alias("tex"))


SOURCES = r"""(SELECT doc_id, source, CASE WHEN doc_id % 5 = 0 THEN '' ELSE '\documentclass{article}' || chr(10) || '\usepackage{amsmath}' || chr(10) END || '\begin{document}' || chr(10)
 || CASE doc_id % 8 WHEN 0 THEN '' WHEN 1 THEN '\input{secret}' WHEN 2 THEN '\inputs{x}' WHEN 3 THEN '% \input{x}' WHEN 4 THEN '\write18{ls}' WHEN 5 THEN '\openin1=f.txt' WHEN 6 THEN '\section{One} \frac{a}{b}' ELSE '{ \left( x $' END
 || chr(10) || regexp_replace(text, '[^A-Za-z. ]', ' ', 'g') || CASE WHEN doc_id % 7 = 0 THEN '' ELSE chr(10) || '\end{document}' || chr(10) END AS tex FROM documents)"""


@query(rf"""SELECT doc_id, list_filter([CASE WHEN regexp_matches(c, '\\write\s*18') THEN '\write18 (runs shell commands)' END, CASE WHEN regexp_matches(c, '\\openin([^a-zA-Z]|$)') THEN '\openin (reads files)' END, CASE WHEN regexp_matches(c, '\\input([^a-zA-Z]|$)') THEN '\input (reads another file)' END], lambda x: x IS NOT NULL) AS found
FROM (SELECT doc_id, regexp_replace(tex, '%[^\n]*', '', 'g') AS c FROM {SOURCES})""")
def unsafe_constructs(spark, sf):
    return sources(spark, sf).select("doc_id", tex.unsafe(F.col("tex")).alias("found"))


@query(rf"""SELECT doc_id, list_filter([CASE WHEN NOT contains(tex, '\documentclass') THEN 'Missing \documentclass - the file is not a complete document.' END, CASE WHEN NOT regexp_matches(tex, '\\begin\s*\{{document\}}') THEN 'Missing \begin{{document}}.' END, CASE WHEN NOT regexp_matches(tex, '\\end\s*\{{document\}}') THEN 'Missing \end{{document}}.' END,
 CASE WHEN doc_id % 8 = 7 THEN 'Unclosed opening brace ''{{'' from line ' || CASE WHEN doc_id % 5 = 0 THEN 2 ELSE 4 END || '.' END,
 CASE WHEN doc_id % 7 = 0 THEN '\begin{{document}} on line ' || CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 3 END || ' is never closed.' END,
 CASE WHEN doc_id % 8 = 7 THEN 'Odd number of ''$'' math delimiters - math opened near line ' || CASE WHEN doc_id % 5 = 0 THEN 2 ELSE 4 END || ' is never closed.' END,
 CASE WHEN doc_id % 8 = 7 THEN 'Unbalanced \left / \right: 1 \left vs 0 \right.' END], lambda x: x IS NOT NULL) AS issues FROM {SOURCES}""")
def static_validate(spark, sf):
    return sources(spark, sf).select("doc_id", tex.static_validate(F.col("tex")).alias("issues"))


LOG = "concat('(./x.tex\n! LaTeX Error: File `pkg', CAST(event_id % 7 AS STRING), '.sty'' not found.\nl.', CAST(event_id % 9 AS STRING), ' x\nmore  \nFile `', event_type, '.sty'' not found\n')"


LOG_SQL = "(SELECT event_id, '(./x.tex' || chr(10) || '! LaTeX Error: File `pkg' || event_id % 7 || '.sty'' not found.' || chr(10) || 'l.' || event_id % 9 || ' x' || chr(10) || 'more  ' || chr(10) || 'File `' || event_type || '.sty'' not found' || chr(10) AS log FROM events)"


@query(rf"SELECT event_id, list_sort(list_distinct(regexp_extract_all(log, 'File [`'']([^`'']+)\.sty'' not found', 1))) AS names FROM {LOG_SQL}")
def missing_packages(spark, sf):
    return read(spark, sf, "events").select("event_id", text.missing_packages(F.expr(LOG)).alias("names"))


@query(rf"""SELECT event_id, array_to_string([x.line for x in list_sort(list({{'k': k, 'line': line}}))], chr(10)) AS errors FROM (SELECT event_id, line, min(k) AS k FROM (
SELECT e.event_id, rtrim(l.line) AS line, l.k FROM (SELECT event_id, unnest(string_split(log, chr(10))) AS line, generate_subscripts(string_split(log, chr(10)), 1) AS k FROM {LOG_SQL}) e
JOIN (SELECT event_id, unnest(string_split(log, chr(10))) AS line, generate_subscripts(string_split(log, chr(10)), 1) AS k FROM {LOG_SQL}) l ON e.event_id = l.event_id AND l.k BETWEEN e.k AND e.k + 2
WHERE regexp_matches(trim(e.line), '^(?:!|l\.\d+|.*?LaTeX Error|.*?File .*? not found\b)') AND trim(l.line) <> '') GROUP BY event_id, line) GROUP BY event_id""")
def extract_errors(spark, sf):
    return read(spark, sf, "events").select("event_id", tex.extract_errors(F.expr(LOG)).alias("errors"))


PACKAGED = r"(SELECT doc_id, '  \usepackage[x]{' || array_to_string(string_split(text, ' ')[1:3], ', ') || '} % why' || chr(10) || text AS tex, string_split(text, ' ')[2:2] AS gone FROM (SELECT doc_id, regexp_replace(text, '[^A-Za-z ]', '', 'g') AS text FROM documents WHERE text IS NOT NULL))"


@query(rf"""SELECT doc_id, CASE WHEN len(rest) = len(asked) THEN tex WHEN len(rest) = 0 THEN substr(tex, position(chr(10) IN tex) + 1) ELSE '  \usepackage[x]{{' || array_to_string(rest, ',') || '}} % why' || substr(tex, position(chr(10) IN tex)) END AS tex
FROM (SELECT doc_id, tex, list_filter(asked, lambda x: NOT list_contains(gone, x)) AS rest, asked FROM (SELECT doc_id, tex, gone, list_filter(list_transform(string_split(regexp_extract(tex, '\{{([^}}]*)\}}', 1), ','), lambda x: trim(x)), lambda x: x <> '') AS asked FROM {PACKAGED}))""")
def drop_packages(spark, sf):
    """Each document asks for its first three words as packages; the second is missing, unless it is empty and so names none.

    Words and names are columns of their own: within the operator they would be made anew for every package of every line.
    """
    rows = read(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.regexp_replace("text", "[^A-Za-z ]", "").alias("words"))
    rows = rows.select("doc_id", "words", F.slice(F.split("words", " ", 4), 1, 3).alias("asked"))
    rows = rows.select("doc_id", "words", "asked", F.filter(F.slice("asked", 2, 1), lambda x: x != "").alias("gone"))
    made = F.concat(F.lit("  \\usepackage[x]{"), F.array_join("asked", ", "), F.lit("} % why\n"), F.col("words"))
    return rows.select("doc_id", tex.drop_packages(made, F.col("gone")).alias("tex"))


@query(rf"""SELECT doc_id, list_filter(keys, lambda x: regexp_matches(x, '^26/[A-Za-z0-9._-]+\.(?:cls|sty)$')) AS files FROM (SELECT doc_id, list_concat(CASE WHEN cls <> '' THEN ['26/' || trim(cls) || '.cls'] ELSE [] END, list_transform(flatten(list_transform(packages, lambda x: string_split(x, ','))), lambda x: '26/' || trim(x) || '.sty')) AS keys
FROM (SELECT doc_id, regexp_extract(c, '\\documentclass\s*(?:\[[^\]]*\])?\s*\{{([^}}]*)\}}', 1) AS cls, regexp_extract_all(c, '\\usepackage\s*(?:\[[^\]]*\])?\s*\{{([^}}]*)\}}', 1) AS packages FROM (SELECT doc_id, regexp_replace(tex, '(?m)(^|[^\\])%.*$', '\1', 'g') AS c FROM {SOURCES})))""")
def files_for(spark, sf):
    return sources(spark, sf).select("doc_id", text.files_for(F.col("tex")).alias("files"))


@query("""SELECT source, line, d AS doc_id, CAST(k - 1 AS INT) AS place FROM (SELECT source, line, d, k, row_number() OVER (PARTITION BY source, line ORDER BY d, k) AS n FROM (
SELECT source, doc_id AS d, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS k, array_to_string(list_filter(string_split_regex(raw, '\\s+'), lambda x: x <> ''), ' ') AS line FROM documents) WHERE line <> '') WHERE n = 1""")
def preamble_union(spark, sf):
    """Distinct lines of each source's documents, white space collapsed, a row for each with where it was first seen: their order. No source is gathered."""
    lines = read(spark, sf, "documents").select("source", F.col("doc_id").alias("d"), F.posexplode(F.split("text", "\n")).alias("k", "raw"))
    clean = lines.withColumn("line", F.array_join(F.filter(F.split("raw", r"\s+"), lambda x: x != ""), " ")).where("line <> ''")
    return clean.groupBy("source", "line").agg(F.min(F.struct("d", "k")).alias("at")).select("source", "line", F.col("at.d").alias("doc_id"), F.col("at.k").alias("place"))


@query(rf"""WITH p AS (SELECT doc_id // 4 AS doc, doc_id AS page, tex, trim(regexp_extract(tex, '(?m)^\s*\\documentclass\b.*$')) AS cls, contains(tex, '\end{{document}}') AS framed FROM {SOURCES}),
l AS (SELECT doc, page, unnest(string_split(head, chr(10))) AS line, generate_subscripts(string_split(head, chr(10)), 1) AS k FROM (SELECT doc, page, CASE WHEN framed THEN split_part(tex, '\begin{{document}}', 1) ELSE '' END AS head FROM p WHERE trim(tex) <> '')),
h AS (SELECT doc, string_agg(line, chr(10) ORDER BY page, k) || chr(10) AS preamble FROM (SELECT doc, page, k, regexp_replace(line, '\s+$', '') AS line, row_number() OVER (PARTITION BY doc, regexp_replace(trim(line), '\s+', ' ', 'g') ORDER BY page, k) AS n FROM l WHERE trim(line) <> '' AND NOT contains(line, '\documentclass')) WHERE n = 1 GROUP BY doc),
b AS (SELECT doc, page, tex, cls, regexp_replace(CASE WHEN framed THEN split_part(split_part(tex, '\begin{{document}}', 2), '\end{{document}}', 1) ELSE tex END, '^\s+|\s+$', '', 'g') AS body FROM p WHERE trim(tex) <> ''),
d AS (SELECT doc, count(*) AS n, min_by(tex, page) AS alone, coalesce(min_by(cls, page) FILTER (cls <> ''), '\documentclass{{article}}') AS cls, string_agg('\begingroup' || chr(10) || body || chr(10) || '\endgroup', chr(10) || chr(10) || '\clearpage' || chr(10) || chr(10) ORDER BY page) FILTER (body <> '') AS bodies FROM b GROUP BY doc)
SELECT doc, coalesce(CASE WHEN n = 1 THEN alone ELSE d.cls || chr(10) || coalesce(preamble, '') || chr(10) || '\begin{{document}}' || chr(10) || chr(10) || coalesce(bodies, '') || chr(10) || chr(10) || '\end{{document}}' || chr(10) END, '') AS tex
FROM (SELECT DISTINCT doc FROM p) LEFT JOIN d USING (doc) LEFT JOIN h USING (doc)""")
def merge_documents(spark, sf):
    pages = sources(spark, sf).select(F.expr("doc_id div 4").alias("doc"), F.col("doc_id").alias("page"), "tex")
    return tex.merge(pages, "doc", "page", "tex")


@query("SELECT conv_id, turn, CASE (conv_id + turn) % 3 WHEN 0 THEN trim(regexp_replace(text, '[^A-Za-z ]', '', 'g')) WHEN 1 THEN '\\documentclass{a} \\end{document}' END AS latex FROM conversations")
def fenced_latex(spark, sf):
    body = F.regexp_replace("text", "[^A-Za-z ]", "")
    reply = F.when((F.col("conv_id") + F.col("turn")) % 3 == 0, F.concat(F.lit("x ```tex\nfirst``` ```latex\n"), body, F.lit("\n```"))).when((F.col("conv_id") + F.col("turn")) % 3 == 1, F.lit("so: \\documentclass{a} \\end{document} bye")).otherwise(F.lit("nothing"))
    return read(spark, sf, "conversations").select("conv_id", "turn", text.fenced_latex(reply).alias("latex"))


@query("SELECT event_id, event_type || 'b' AS reply, CASE WHEN event_id % 2 = 0 THEN event_id % 50 ELSE 0 END AS retry FROM events")
def reply_json(spark, sf):
    reply = F.expr("""concat('{"candidates":[{"content":{"parts":[{"text":"', event_type, '"},{"text":"b"}]}}]}')""")
    error = F.expr("""CASE WHEN event_id % 2 = 0 THEN concat('{"error":{"details":[{"@type":"x.Help"},{"@type":"t/google.RetryInfo","retryDelay":"', CAST(event_id % 50 AS STRING), 's"}]}}') ELSE 'no json' END""")
    return read(spark, sf, "events").select("event_id", text.reply_text(reply).alias("reply"), text.retry_seconds(error).alias("retry"))


@query(rf"SELECT doc_id, greatest(1, doc_id % 6) AS pages, 0 AS uncertain, CAST(len(list_filter(string_split_regex(b, '\n\s*\n'), lambda x: trim(replace(x, chr(10), '')) <> '')) AS INT) AS blocks, CAST(len(regexp_extract_all(b, '\\\[|\\begin\{{equation\}}')) AS INT) AS equations FROM (SELECT doc_id, CASE WHEN contains(tex, '\end{{document}}') THEN split_part(split_part(tex, '\begin{{document}}', 2), '\end{{document}}', 1) ELSE tex END AS b FROM {SOURCES})")
def summarise_tex(spark, sf):
    pages = F.when(F.col("doc_id") % 6 > 0, F.col("doc_id") % 6)
    return sources(spark, sf).select("doc_id", text.summarised(F.col("tex"), pages).alias("s")).select("doc_id", "s.pages", F.col("s.textBlocks").alias("blocks"), "s.equations", F.col("s.uncertainLines").alias("uncertain"))


# --- limiter and availability ---------------------------------------------------------


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT user_id, event_id, k, [t] AS seen, false AS limited, CAST(0 AS BIGINT) AS retry_after FROM e WHERE k = 1
UNION ALL SELECT e.user_id, e.event_id, e.k, CASE WHEN len(s) >= 3 THEN s ELSE list_append(s, e.t) END, len(s) >= 3, CASE WHEN len(s) >= 3 THEN greatest(1, CAST(ceil((86400000000 - (e.t - s[1])) / 1000000) AS BIGINT)) ELSE 0 END
FROM (SELECT r.user_id, e.k, e.event_id, e.t, list_filter(r.seen, lambda x: e.t - x <= 86400000000) AS s FROM r JOIN e ON r.user_id = e.user_id AND e.k = r.k + 1) e)
SELECT user_id AS caller, event_id, limited, retry_after FROM r""")
def limiter_batch(spark, sf):
    log = read(spark, sf, "events").select(F.lit("convert").alias("group"), F.col("user_id").alias("caller"), F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"), "event_id")
    return limiter.limited(spark, log, {"convert": (3, 86_400)}).select("caller", "event_id", "limited", "retry_after")


@query(SQL["limiter_batch"])
def limiter_stream(spark, sf):
    """The same decisions from a stateful stream over the log's files."""
    log = tables.stream_table(spark, sf, "events").select(F.lit("convert").alias("group"), F.col("user_id").cast("string").alias("caller"), F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"), "event_id")
    got = tables.run_to_end(spark, limited_stream(log, {"convert": (3, 86_400)}).writeStream, "limiter")
    return got.select(F.col("caller").cast("bigint").alias("caller"), "event_id", "limited", "retry_after")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, event_type AS g, epoch_us(ts) AS t, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 0 END AS n, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT user_id, g, event_id, k, CASE WHEN n > 0 THEN [t] ELSE CAST([] AS BIGINT[]) END AS seen, false AS limited, CAST(0 AS BIGINT) AS retry_after FROM e WHERE k = 1
UNION ALL SELECT user_id, g, event_id, k, CASE WHEN n = 0 OR len(s) >= n THEN s ELSE list_append(s, t) END, n > 0 AND len(s) >= n, CASE WHEN n > 0 AND len(s) >= n THEN greatest(1, CAST(ceil((172800000000 - (t - s[1])) / 1000000) AS BIGINT)) ELSE 0 END
FROM (SELECT e.*, list_filter(r.seen, lambda x: e.t - x <= 172800000000) AS s FROM r JOIN e ON r.user_id = e.user_id AND r.g = e.g AND e.k = r.k + 1))
SELECT 'u' || user_id AS caller, g AS "group", event_id, limited, retry_after FROM r""")
def limiter_groups(spark, sf):
    """Each group of routes has its own allowance; unknown ones are never limited. The caller is the user, or else the address."""
    who = limiter.caller(F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("u"), "user_id")).otherwise(""), F.when(F.col("user_id") % 2 > 0, F.concat(F.lit("u"), "user_id")))
    log = read(spark, sf, "events").select(F.col("event_type").alias("group"), who.alias("caller"), F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"), "event_id")
    return limiter.limited(spark, log, {"click": (1, 172_800), "view": (2, 172_800)})


def outage_log(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").select(F.concat(F.lit("m"), F.col("user_id") % 5).alias("model"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), "event_id", (F.col("event_id") % 3 == 0).alias("ok"), F.lit(429).alias("status"), F.when(F.col("event_id") % 2 == 0, F.col("event_id") % 100).otherwise(0).alias("retry_after"), (F.col("event_id") % 7 == 1).alias("gone"))


LAST = "(SELECT 'm' || user_id % 5 AS model, arg_max({'id': event_id, 'at': CAST(floor(epoch(ts)) AS BIGINT)}, {'a': CAST(floor(epoch(ts)) AS BIGINT), 'b': event_id}) AS x FROM events GROUP BY 1)"
OUTAGES = f"(SELECT model, x.at + CASE WHEN x.id % 7 = 1 THEN 86400 WHEN x.id % 2 = 0 AND x.id % 100 > 0 THEN x.id % 100 ELSE 900 END AS until, 429 AS status FROM {LAST} WHERE x.id % 3 <> 0)"


@query(f"SELECT model, until, CAST(status AS INT) AS status FROM {OUTAGES}")
def outage_latest(spark, sf):
    return availability.latest_outages(outage_log(spark, sf))


def model_chain(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f"m{k}", k) for k in range(7)], "model string, ord int")


NOW = "(SELECT CAST(floor(epoch(max(ts))) AS BIGINT) - 100 FROM events)"


@query(f"SELECT 'm' || k AS model FROM range(7) t(k) WHERE 'm' || k NOT IN (SELECT model FROM {OUTAGES} WHERE until > {NOW})")
def models_available(spark, sf):
    log = outage_log(spark, sf)
    now = log.agg(F.max("at") - 100)
    return availability.available(model_chain(spark), availability.latest_outages(log), now).select("model")


@query(f"SELECT count(*) FILTER (u) > 0 AS available, min(m) FILTER (u) AS model, count(*) FILTER (u) AS remaining, CASE WHEN count(*) FILTER (u) = 0 THEN nullif(min(coalesce(until, 0)), 0) END AS retry_at FROM (SELECT 'm' || k AS m, until, until IS NULL OR until <= {NOW} AS u FROM range(7) t(k) LEFT JOIN {OUTAGES} ON 'm' || k = model)")
def ai_status(spark, sf):
    log = outage_log(spark, sf)
    now = log.agg(F.max("at") - 100)
    return availability.status(model_chain(spark), availability.latest_outages(log), now)


def attempts(spark: SparkSession, sf: str) -> DataFrame:
    code = F.expr("CASE (conv_id + turn) % 6 WHEN 0 THEN 200 WHEN 1 THEN 429 WHEN 2 THEN 503 WHEN 3 THEN 404 WHEN 4 THEN 400 ELSE 403 END")
    said = F.expr("CASE WHEN conv_id % 2 = 0 THEN 'Thinking is not supported' ELSE 'models/x-1 is not found' END")
    rows = read(spark, sf, "conversations").withColumns({"code": code, "said": said})
    outcome = availability.outcome(F.col("code"), F.col("said"), F.col("turn") % 2 == 0)
    return rows.select((F.col("conv_id") / 3).cast("bigint").alias("doc"), F.col("conv_id").alias("page"), (F.col("turn") + 1).alias("step"), "code", "said", outcome.alias("outcome"), F.concat(F.lit("m"), F.col("turn") % 3).alias("model"))


ATTEMPTS = r"""(SELECT doc, page, step, model, CASE WHEN code BETWEEN 200 AND 299 THEN 'ok' WHEN code = 429 OR code >= 500 THEN 'park' WHEN code = 404 OR (code IN (400, 403) AND regexp_matches(said, '(?i)models/[\w.-]+ is not found')) THEN 'retire' WHEN code = 400 AND regexp_matches(said, '(?i)thinking') AND thinks THEN 'retry_plain' ELSE 'fatal' END AS outcome
FROM (SELECT CAST(conv_id // 3 AS BIGINT) AS doc, conv_id AS page, turn + 1 AS step, 'm' || turn % 3 AS model, turn % 2 = 0 AS thinks, list_extract([200, 429, 503, 404, 400, 403], CAST((conv_id + turn) % 6 + 1 AS BIGINT)) AS code, CASE WHEN conv_id % 2 = 0 THEN 'Thinking is not supported' ELSE 'models/x-1 is not found' END AS said FROM conversations))"""


@query(f"SELECT doc, page, step, outcome FROM {ATTEMPTS}")
def chain_outcome(spark, sf):
    return attempts(spark, sf).select("doc", "page", "step", "outcome")


ENDS = f"(SELECT doc, page, coalesce(min(step) FILTER (outcome IN ('ok', 'fatal')), max(step)) AS steps, coalesce(arg_min(outcome, step) FILTER (outcome IN ('ok', 'fatal')), '') AS o, arg_min(model, step) FILTER (outcome IN ('ok', 'fatal')) AS m FROM {ATTEMPTS} WHERE step <= 10 GROUP BY doc, page)"


@query(f"SELECT doc, page, o = 'ok' AS ok, steps, steps - 1 AS retries, CASE WHEN o = 'ok' THEN m END AS model FROM {ENDS}")
def page_attempts(spark, sf):
    return chain.page_outcomes(attempts(spark, sf))


@query(f"SELECT doc, pages, a AS ai_pages, pages - a AS fallback_pages, CASE WHEN a = pages THEN 'ai' WHEN a = 0 THEN 'converters' ELSE 'mixed' END AS path FROM (SELECT doc, count(*) AS pages, count(*) FILTER (bad IS NULL OR page < bad) AS a FROM {ENDS} JOIN (SELECT doc, min(page) FILTER (o <> 'ok') AS bad FROM {ENDS} GROUP BY doc) USING (doc) GROUP BY doc)")
def convert_summary(spark, sf):
    return chain.conversion_path(chain.page_outcomes(attempts(spark, sf)))


GONE = r"(?i)models/[\w.-]+ (?:is not found|was not found|not found)|NOT_FOUND|has been (?:retired|deprecated|discontinued)"


@query(rf"""SELECT event_id, code = 404 OR (code IN (400, 403) AND regexp_matches(said, '{GONE}')) AS gone, code = 400 AND regexp_matches(said, '(?i)\b(temperature|top_?p|top_?k)\b') AS sampling
FROM (SELECT event_id, CASE event_id % 7 WHEN 2 THEN 400 WHEN 3 THEN 403 WHEN 4 THEN 404 WHEN 5 THEN 429 ELSE 200 END AS code, CASE event_id % 5 WHEN 0 THEN 'the model has been Retired' WHEN 1 THEN 'bad top_p value ' || event_type WHEN 2 THEN 'models/' || event_type || '-1 is not found' WHEN 3 THEN 'stop_kind ' || event_type ELSE 'Temperature: ' || value END AS said FROM events)""")
def error_classes(spark, sf):
    code = F.expr("CASE event_id % 7 WHEN 2 THEN 400 WHEN 3 THEN 403 WHEN 4 THEN 404 WHEN 5 THEN 429 ELSE 200 END")
    said = F.expr("CASE event_id % 5 WHEN 0 THEN 'the model has been Retired' WHEN 1 THEN concat('bad top_p value ', event_type) WHEN 2 THEN concat('models/', event_type, '-1 is not found') WHEN 3 THEN concat('stop_kind ', event_type) ELSE concat('Temperature: ', value) END")
    return read(spark, sf, "events").select("event_id", text.model_is_gone(code, said).alias("gone"), text.sampling_refused(code, said).alias("sampling"))


# --- scores ------------------------------------------------------------------------------



def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark texts against themselves, spaced and with a tail: truths and guesses of three conditions."""
    t = F.regexp_replace("text", "[^A-Za-z0-9 ]", "")
    return read(spark, sf, "benchmark").select("item_id", F.concat(F.lit("c"), F.col("item_id") % 3).alias("cond"), F.concat(F.lit("{ a }"), t).alias("truth"), F.concat(F.lit("a "), t, F.expr("CASE WHEN item_id % 2 = 0 THEN ' xyz' ELSE '' END")).alias("guess"))


PAIRS = r"(SELECT item_id, 'c' || item_id % 3 AS cond, 'a' || regexp_replace(regexp_replace(text, '[^A-Za-z0-9 ]', '', 'g'), '\s+', '', 'g') AS t, 'a' || regexp_replace(regexp_replace(text, '[^A-Za-z0-9 ]', '', 'g'), '\s+', '', 'g') || CASE WHEN item_id % 2 = 0 THEN 'xyz' ELSE '' END AS g FROM benchmark)"


@query(f"SELECT item_id, t, g, levenshtein(t, g) AS edits, length(t) AS chars FROM {PAIRS}")
def edit_distance(spark, sf):
    return metrics.scored(pairs(spark, sf)).select("item_id", "t", "g", F.col("edits").cast("bigint").alias("edits"), F.col("chars").cast("bigint").alias("chars"))


@query(f"SELECT cond, count(*) AS n, CAST(sum(CASE WHEN t = g THEN 1 ELSE 0 END) AS BIGINT) AS exact, round(greatest(0, 1 - sum(levenshtein(t, g)) / sum(length(t))), 6) AS accuracy, round(avg(CASE WHEN t = g THEN 1 ELSE 0 END), 6) AS exact_rate FROM {PAIRS} GROUP BY ROLLUP (cond)")
def score_rollup(spark, sf):
    return metrics.micro(metrics.scored(pairs(spark, sf)))


@query("SELECT round(coalesce(avg(quality) FILTER (toxic IS NOT NULL AND n_chars IS NOT NULL), 0), 6) AS macro, count(*) AS n FROM labels JOIN documents USING (doc_id)")
def score_macro_nulls(spark, sf):
    rows = read(spark, sf, "labels").join(read(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    return rows.agg(F.round(metrics.macro(F.when(F.col("toxic").isNotNull(), F.col("quality").cast("double")), F.col("n_chars")), 6).alias("macro"), F.count("*").alias("n"))


@query(rf"SELECT doc_id, CASE WHEN doc_id % 8 = 6 THEN 2 ELSE 0 END AS elements, CASE WHEN doc_id % 8 = 6 THEN CAST(1 AS DOUBLE) END AS self FROM {SOURCES}")
def structure_score(spark, sf):
    t = F.col("tex")
    body = text.body_of(t)
    total = sum((text.count_matches(body, p) for p in text.STRUCTURE.values()), F.lit(0))
    return sources(spark, sf).select("doc_id", total.alias("elements"), text.structure_score(t, t).alias("self"))


@query("SELECT event_type, min(value) AS least, list_sort(list(value))[len(list(value)) // 2 + 1] AS median, max(value) AS most FROM events GROUP BY event_type")
def upper_median(spark, sf):
    return metrics.spread(read(spark, sf, "events"), "event_type", "value")


# --- layout -------------------------------------------------------------------------------


def boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Text lines from lineitem: a page is an order, a line an item."""
    t = F.expr("CAST(l_partkey % 200 * 3 AS INT)")
    return read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("page"), (F.col("l_orderkey") * 100 + F.col("l_linenumber") * 10).cast("bigint").alias("id"), F.expr("CAST(l_suppkey % 50 AS INT)").alias("l"), t.alias("t"), F.expr("CAST(l_suppkey % 50 + 100 AS INT)").alias("r"), (t + F.expr("CAST(10 + l_quantity AS INT)")).alias("b"), F.col("l_returnflag").alias("text"), F.expr("CAST(l_discount * 1000 AS INT)").alias("min_conf"), F.col("l_linenumber").alias("n"))


BOXES = "(SELECT l_orderkey AS page, CAST(l_orderkey * 100 + l_linenumber * 10 AS BIGINT) AS id, CAST(l_suppkey % 50 AS INT) AS l, CAST(l_partkey % 200 * 3 AS INT) AS t, CAST(l_suppkey % 50 + 100 AS INT) AS r, CAST(l_partkey % 200 * 3 AS INT) + CAST(10 + l_quantity AS INT) AS b, l_returnflag AS text, CAST(l_discount * 1000 AS INT) AS min_conf, l_linenumber AS n FROM lineitem)"
OVERLAPS = "x.page = y.page AND least(x.b, y.b) > greatest(x.t, y.t) AND (least(x.b, y.b) - greatest(x.t, y.t)) / least(x.b - x.t, y.b - y.t) >= 0.5"


@query(f"SELECT DISTINCT x.page, x.id AS line_id, y.id AS box_id FROM {BOXES} x JOIN {BOXES} y ON {OVERLAPS} AND x.n > 2 AND y.n <= 2")
def box_overlap_join(spark, sf):
    rows = boxes(spark, sf)
    return layout.overlapping(rows.where("n > 2"), rows.where("n <= 2")).distinct()


@query(f"WITH o AS (SELECT x.page, x.id, 'text' AS kind, x.l, x.t FROM {BOXES} x WHERE n > 2 AND NOT EXISTS (SELECT 1 FROM {BOXES} y WHERE y.n <= 2 AND {OVERLAPS}) UNION ALL SELECT page, id, 'equation', l, t FROM {BOXES} WHERE n <= 2) SELECT page, kind, t, l, CAST(row_number() OVER (PARTITION BY page ORDER BY t, l, kind, id) AS INT) AS ord FROM o")
def assemble_order(spark, sf):
    rows = boxes(spark, sf)
    return layout.assembled(rows.where("n > 2"), rows.where("n <= 2")).select("page", "kind", "t", "l", "ord")


ITEMS = "(SELECT DISTINCT ON (l_orderkey, l_linenumber) l_orderkey AS page, l_linenumber AS ord, CASE WHEN l_linestatus = 'O' THEN 'text' ELSE 'equation' END AS kind, l_suppkey % 2 AS block, l_partkey % 2 AS par FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linestatus)"


@query(f"SELECT page, ord, CAST(sum(new) OVER (PARTITION BY page ORDER BY ord) AS BIGINT) AS paragraph FROM (SELECT page, ord, CASE WHEN lag(kind) OVER w IS NULL OR lag(kind) OVER w <> 'text' OR kind <> 'text' OR lag(block) OVER w <> block OR lag(par) OVER w <> par THEN 1 ELSE 0 END AS new FROM {ITEMS} WINDOW w AS (PARTITION BY page ORDER BY ord))")
def paragraph_runs(spark, sf):
    first = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_linestatus")
    items = read(spark, sf, "lineitem").withColumn("k", F.row_number().over(first)).where("k = 1").selectExpr("l_orderkey page", "l_linenumber ord", "CASE WHEN l_linestatus = 'O' THEN 'text' ELSE 'equation' END kind", "l_suppkey % 2 block", "l_partkey % 2 par")
    return layout.paragraphs(items).select("page", "ord", "paragraph")


@query("SELECT doc, page, height, CAST(coalesce(sum(height) OVER (PARTITION BY doc ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM (SELECT o_custkey AS doc, o_orderkey AS page, CAST(floor(o_totalprice) AS BIGINT) AS height FROM orders)")
def page_offset(spark, sf):
    return layout.page_offsets(read(spark, sf, "orders").selectExpr("o_custkey doc", "o_orderkey page", "CAST(FLOOR(o_totalprice) AS BIGINT) height"))


@query("WITH y AS (SELECT DISTINCT l_suppkey AS page, CAST(l_partkey % 500 AS BIGINT) AS y FROM lineitem), i AS (SELECT page, min(y) AS top, max(y) + 1 AS bottom FROM (SELECT page, y, y - row_number() OVER (PARTITION BY page ORDER BY y) AS g FROM y) GROUP BY page, g), m AS (SELECT *, sum(new) OVER (PARTITION BY page ORDER BY top) AS n FROM (SELECT *, CASE WHEN top - lag(bottom) OVER (PARTITION BY page ORDER BY top) < 4 THEN 0 ELSE 1 END AS new FROM i)) SELECT page, min(top) AS top, max(bottom) AS bottom FROM m GROUP BY page, n")
def band_islands(spark, sf):
    rows = read(spark, sf, "lineitem").selectExpr("l_suppkey page", "CAST(l_partkey % 500 AS BIGINT) y").distinct()
    return layout.bands(rows, 4)


@query("""WITH s AS (SELECT DISTINCT l_orderkey AS page, l_partkey % 60 AS t, l_partkey % 60 + 5 + l_suppkey % 9 AS b FROM lineitem),
p AS (SELECT page, 0 AS q FROM s UNION SELECT page, b FROM s WHERE b < 100),
g AS (SELECT page, q AS t, (SELECT coalesce(min(s.t), 100) FROM s WHERE s.page = p.page AND s.t >= p.q) AS b FROM p WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.page = p.page AND s.t <= p.q AND s.b > p.q))
SELECT page, CAST(t AS BIGINT) AS t, CAST(b AS BIGINT) AS b FROM g WHERE b - t >= 14""")
def carve_spans(spark, sf):
    spans = read(spark, sf, "lineitem").selectExpr("l_orderkey page", "CAST(l_partkey % 60 AS BIGINT) t", "CAST(l_partkey % 60 + 5 + l_suppkey % 9 AS BIGINT) b").distinct()
    return spans.groupBy("page").agg(F.collect_list(F.struct("t", "b")).alias("s")).select("page", F.inline(layout.carved(F.lit(0), F.lit(100), F.col("s"))))


@query("SELECT vec_id, CAST(round(t, 6) AS DOUBLE) AS threshold, CAST(len(list_filter(p, lambda x: x < t)) AS BIGINT) AS ink FROM (SELECT vec_id, p, greatest(least(list_avg(p) - list_stddev_pop(p), 200), 60) AS t FROM (SELECT vec_id, list_transform(embedding, lambda x: round(128 + 100 * CAST(x AS DOUBLE), 3)) AS p FROM embeddings))")
def grey_threshold(spark, sf):
    """Threshold and ink of pixel vectors: mean less deviation, between 60 and 200."""
    p = F.transform("embedding", lambda x: F.round(F.lit(128.0) + F.lit(100.0) * x.cast("double"), 3))
    rows = read(spark, sf, "embeddings").select("vec_id", p.alias("p"))
    mean = F.aggregate("p", F.lit(0.0), lambda a, x: a + x) / F.size("p")
    rows = rows.withColumn("m", mean).withColumn("sd", F.sqrt(F.aggregate("p", F.lit(0.0), lambda a, x: a + (x - F.col("m")) * (x - F.col("m"))) / F.size("p")))
    t = F.greatest(F.least(F.col("m") - F.col("sd"), F.lit(200.0)), F.lit(60.0))
    return rows.withColumn("t", t).select("vec_id", F.round("t", 6).alias("threshold"), F.size(F.filter("p", lambda x: x < F.col("t"))).cast("bigint").alias("ink"))


@query("SELECT page, t, b, CAST(row_number() OVER (PARTITION BY page ORDER BY t, b, id) AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY b - t DESC, t, id) AS k FROM " + BOXES + ") WHERE k <= 3")
def tallest_regions(spark, sf):
    """The three tallest boxes of each page in reading order."""
    tall, order = Window.partitionBy("page").orderBy((F.col("b") - F.col("t")).desc(), "t", "id"), Window.partitionBy("page").orderBy("t", "b", "id")
    return boxes(spark, sf).withColumn("k", F.row_number().over(tall)).where("k <= 3").select("page", "t", "b", F.row_number().over(order).alias("place"))




# --- requests --------------------------------------------------------------------------------


@query("""SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'All fields are required' WHEN event_id % 7 = 0 THEN 'Passwords do not match' WHEN length(event_type) < 8 THEN 'Password must be at least 8 characters' WHEN event_id % 5 = 0 THEN 'You must agree to the terms and conditions' END AS error FROM events""")
def form_errors(spark, sf):
    again = F.when(F.col("event_id") % 7 == 0, F.concat("event_type", F.lit("!"))).otherwise(F.col("event_type"))
    error = requests.form_error(F.lit("n"), F.when(F.col("event_id") % 11 == 0, "").otherwise("e"), F.col("event_type"), again, F.col("event_id") % 5 != 0)
    return read(spark, sf, "events").select("event_id", error.alias("error"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'Email already exists' WHEN 1 THEN 'Malformed email address' ELSE 'Failed to create account' END AS message, strftime(o_orderdate, '%d %b %Y, %H:%M') AS shown,
 o_orderdate >= TIMESTAMP '1998-01-01' - INTERVAL 30 DAY AS session, o_totalprice * 10 > 1048576 AS too_large, o_orderpriority <> '1-URGENT' AS outdated FROM orders""")
def request_rules(spark, sf):
    code = F.expr("CASE o_orderkey % 4 WHEN 0 THEN 'EMAIL_EXISTS' WHEN 1 THEN 'INVALID_EMAIL' WHEN 2 THEN 'OPERATION_NOT_ALLOWED' END")
    now, issued = F.unix_seconds(F.lit("1998-01-01").cast("timestamp")), F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    return read(spark, sf, "orders").select(
        "o_orderkey", requests.message(code, requests.SIGN_UP_ERRORS, requests.SIGN_UP_DEFAULT).alias("message"), requests.shown_time(F.col("o_orderdate")).alias("shown"),
        requests.session_valid(F.lit(True), issued, now).alias("session"), requests.too_large(F.ceil(F.col("o_totalprice") * 10)).alias("too_large"), requests.terms_outdated(F.col("o_orderpriority"), "1-URGENT").alias("outdated"),
    )


@query("SELECT l_shipmode_ AS path, count(*) AS requests, round(sum(l_extendedprice), 2) AS bytes FROM (SELECT l_returnflag || l_linestatus AS l_shipmode_, l_extendedprice FROM lineitem WHERE l_linenumber <> 3) GROUP BY 1")
def bytes_served(spark, sf):
    log = read(spark, sf, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("path"), F.when(F.col("l_linenumber") == 3, 404).otherwise(200).alias("status"), F.col("l_extendedprice").alias("bytes"))
    return requests.bytes_served(log).withColumn("bytes", F.round("bytes", 2))


@query("SELECT DISTINCT 'f' || p_partkey // 2 || '.tfm' AS name, 'f' || p_partkey // 2 AS alias FROM part WHERE p_partkey % 3 > 0 AND p_partkey // 2 NOT IN (SELECT p_partkey // 2 FROM part WHERE p_partkey % 3 = 0)")
def bare_aliases(spark, sf):
    names = F.expr("concat('f', p_partkey div 2, CASE WHEN p_partkey % 3 > 0 THEN '.tfm' ELSE '' END)")
    return requests.bare_aliases(read(spark, sf, "part").select(names.alias("name"))).select("name", "alias")


@query("SELECT page_id, CASE WHEN contains(url, '/en/') THEN 'english' WHEN contains(url, '/de/') THEN 'german' ELSE 'in git' END AS producer, ['b', 'b', 'c'] AS kept FROM pages")
def producers(spark, sf):
    letters = F.array(*(F.lit(x) for x in "abbac"))
    return read(spark, sf, "pages").select("page_id", requests.producer(F.col("url"), [("/en/", "english"), ("/de/", "german")]).alias("producer"), requests.without(letters, F.array(F.lit("a"))).alias("kept"))


from quire import file_queries, page_queries, tex_queries  # noqa: E402, F401 - they register theirs
