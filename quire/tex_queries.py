"""Queries over LaTeX sources made of whole texts, with SQL that checks and repairs them by relational steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import tex, text
from quire.registry import query, read

FAULTS = [
    "", r"{ \begin{a} $", "} {", "\\begin{a}\n\\begin{b} \\end{a}", r"\end{x} % {", r"\{ \left( $$ x", r"\leftarrow \right)", r"\\{ \[ x", r"\section{One} \frac{a}{b}", "% { $ \\begin{x}",
]


def spoilt(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, tex): every document's whole text as a LaTeX source, with faults and parts that lack by doc_id."""
    fault = F.get(F.array(*(F.lit(x) for x in FAULTS)), (F.col("doc_id") % len(FAULTS)).cast("int"))
    head = F.when(F.col("doc_id") % 9 == 0, "").otherwise("\\documentclass{article}\n\\usepackage{amsmath}\n")
    end = F.when(F.col("doc_id") % 7 == 0, "").otherwise("\n\\end{document}\n")
    return read(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.concat(head, F.lit("\\begin{document}\n"), fault, F.lit("\n"), "text", end).alias("tex"))


def literal(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


SPOILT = (
    "(SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN '' ELSE '\\documentclass{article}' || chr(10) || '\\usepackage{amsmath}' || chr(10) END || '\\begin{document}' || chr(10) || list_extract(["
    + ", ".join(map(literal, FAULTS))
    + f"], CAST(doc_id % {len(FAULTS)} + 1 AS BIGINT)) || chr(10) || text || CASE WHEN doc_id % 7 = 0 THEN '' ELSE chr(10) || '\\end{{document}}' || chr(10) END AS tex FROM documents WHERE text IS NOT NULL)"
)


def issues_sql(source: str) -> str:
    """(doc_id, issues) of source (doc_id, tex): braces and environments are matched by running depths, which start anew where something is closed that isn't open."""
    return rf"""(WITH c AS (SELECT doc_id, tex, regexp_replace(tex, '(\\[A-Za-z])|\\[^\n]|%[^\n]*', '\1', 'g') AS code FROM {source}),
b AS (SELECT doc_id, k, tok, 1 + count(*) FILTER (tok = chr(10)) OVER w AS line, sum(CASE tok WHEN '{{' THEN 1 WHEN '}}' THEN -1 ELSE 0 END) OVER w AS s FROM (SELECT doc_id, unnest(l) AS tok, generate_subscripts(l, 1) AS k FROM (SELECT doc_id, regexp_extract_all(code, '[{{}}\n]') AS l FROM c)) WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
b2 AS (SELECT *, least(0, min(s) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS low, s - least(0, min(s) OVER (PARTITION BY doc_id ORDER BY k)) AS d FROM b),
b3 AS (SELECT *, coalesce(min(d) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), d) AS after FROM b2),
e AS (SELECT doc_id, k, tok, line, trim(regexp_extract(tok, '\{{([^}}]*)\}}', 1)) AS name, sum(CASE WHEN tok[1:6] = '\begin' THEN 1 ELSE -1 END) OVER (PARTITION BY doc_id ORDER BY k) AS s FROM (SELECT *, 1 + sum(CASE WHEN tok = chr(10) THEN 1 ELSE len(tok) - len(replace(tok, chr(10), '')) END) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS line0, coalesce(line0, 1) AS line FROM (SELECT doc_id, unnest(l) AS tok, generate_subscripts(l, 1) AS k FROM (SELECT doc_id, regexp_extract_all(code, '\n|\\(?:begin|end)\s*\{{[^}}]*\}}') AS l FROM c))) WHERE tok <> chr(10)),
e2 AS (SELECT *, least(0, min(s) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS low, s - least(0, min(s) OVER (PARTITION BY doc_id ORDER BY k)) AS d FROM e),
e3 AS (SELECT *, coalesce(min(d) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), d) AS after FROM e2),
x AS (SELECT y.doc_id, y.k, y.name, y.line, max_by(z.name, z.k) AS other, max_by(z.line, z.k) AS since FROM e3 y JOIN e3 z ON y.doc_id = z.doc_id AND z.k < y.k AND z.tok[1:6] = '\begin' AND z.d = y.d + 1 WHERE y.tok[1:4] = '\end' AND NOT (y.s < coalesce(y.low, 0)) GROUP BY ALL),
m AS (SELECT doc_id, regexp_extract_all(code, '\n|\$\$?') AS l, len(regexp_extract_all(code, '\\left(?:[^a-zA-Z]|$)')) AS le, len(regexp_extract_all(code, '\\right(?:[^a-zA-Z]|$)')) AS ri FROM c),
m2 AS (SELECT doc_id, le, ri, len(list_filter(l, lambda t: t <> chr(10))) AS n, len(list_filter(l[1 : len(l) - list_position(list_transform(list_reverse(l), lambda t: t <> chr(10)), true) + 1], lambda t: t = chr(10))) + 1 AS line FROM m),
a AS (
SELECT doc_id, 1 AS p, 0 AS k, 'Missing \documentclass - the file is not a complete document.' AS what FROM c WHERE NOT contains(code, '\documentclass') UNION ALL SELECT doc_id, 2, 0, 'Missing \begin{{document}}.' FROM c WHERE NOT regexp_matches(code, '\\begin\s*\{{document\}}') UNION ALL SELECT doc_id, 3, 0, 'Missing \end{{document}}.' FROM c WHERE NOT regexp_matches(code, '\\end\s*\{{document\}}')
UNION ALL SELECT doc_id, 4, k, 'Unmatched closing brace ''}}'' on line ' || line || '.' FROM b3 WHERE tok = '}}' AND s < coalesce(low, 0) UNION ALL SELECT doc_id, 5, k, 'Unclosed opening brace ''{{'' from line ' || line || '.' FROM b3 WHERE tok = '{{' AND after >= d
UNION ALL SELECT doc_id, 6, k, '\end{{' || name || '}} on line ' || line || ' has no matching \begin.' FROM e3 WHERE tok[1:4] = '\end' AND s < coalesce(low, 0) UNION ALL SELECT doc_id, 6, k, '\begin{{' || other || '}} (line ' || since || ') is closed by \end{{' || name || '}} (line ' || line || ').' FROM x WHERE other <> name
UNION ALL SELECT doc_id, 7, k, '\begin{{' || name || '}} on line ' || line || ' is never closed.' FROM e3 WHERE tok[1:6] = '\begin' AND after >= d
UNION ALL SELECT doc_id, 8, 0, 'Odd number of ''$'' math delimiters - math opened near line ' || line || ' is never closed.' FROM m2 WHERE n % 2 = 1 UNION ALL SELECT doc_id, 9, 0, 'Unbalanced \left / \right: ' || le || ' \left vs ' || ri || ' \right.' FROM m2 WHERE le <> ri)
SELECT c.doc_id, CASE WHEN regexp_replace(tex, '\s', '', 'g') = '' THEN ['The generated LaTeX is empty.'] ELSE coalesce(i.issues, []) END AS issues FROM c LEFT JOIN (SELECT doc_id, list(what ORDER BY p, k) AS issues FROM a GROUP BY doc_id) i USING (doc_id))"""


def closed_sql(source: str) -> str:
    """(doc_id, strays, more, body, stack, ends) of source (doc_id, body): without } that close nothing, how many, with `more` \\left. in front, what is open at the end, and what closes it."""
    return rf"""(WITH RECURSIVE t AS (SELECT doc_id, unnest(l) AS tok, generate_subscripts(l, 1) AS k FROM (SELECT doc_id, regexp_extract_all(body, '(?s)\\.|[{{}}]|[^\\{{}}]+|\\$') AS l FROM {source})),
d AS (SELECT *, sum(CASE tok WHEN '{{' THEN 1 WHEN '}}' THEN -1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS depth FROM t),
m AS (SELECT *, coalesce(min(depth) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS low FROM d),
e AS (SELECT doc_id, count(*) FILTER (tok = '}}' AND depth < least(low, 0)) AS strays, coalesce(string_agg(tok, '' ORDER BY k) FILTER (tok <> '}}' OR depth >= least(low, 0)), '') AS body FROM m GROUP BY doc_id),
f AS (SELECT doc_id, strays, more, repeat('\left.', more) || body AS body FROM (SELECT *, greatest(0, len(regexp_extract_all(body, '\\right(?:[^a-zA-Z]|$)')) - len(regexp_extract_all(body, '\\left(?:[^a-zA-Z]|$)'))) AS more FROM e)),
g AS (SELECT doc_id, regexp_extract_all(body, '(?s)\\begin\s*\{{[^}}]*\}}|\\end\s*\{{[^}}]*\}}|\\[a-zA-Z]+|\\.|[{{}}]') AS l FROM f),
q AS (SELECT doc_id, list_filter(list_transform(l, lambda x: CASE WHEN x = '{{' OR regexp_matches(x, '^\\left$') THEN x WHEN x = '}}' OR regexp_matches(x, '^\\right$') THEN x WHEN regexp_matches(x, '^\\(begin|end)\s*\{{') THEN x END), lambda x: x IS NOT NULL) AS l FROM g),
r AS (SELECT doc_id, l, 0 AS k, CAST([] AS VARCHAR[]) AS stack FROM q UNION ALL
SELECT doc_id, l, k + 1, CASE WHEN o IS NOT NULL THEN list_append(stack, o) WHEN list_contains(stack, x) THEN list_concat(stack[1 : len(stack) - list_position(list_reverse(stack), x)], stack[len(stack) - list_position(list_reverse(stack), x) + 2 :]) ELSE stack END FROM (
SELECT doc_id, l, k, stack, CASE WHEN l[k + 1] = '{{' THEN '{{' WHEN l[k + 1] = '\left' THEN 'left' WHEN l[k + 1][1:6] = '\begin' THEN trim(regexp_extract(l[k + 1], '\{{([^}}]*)\}}', 1)) END AS o, CASE WHEN l[k + 1] = '}}' THEN '{{' WHEN l[k + 1] = '\right' THEN 'left' WHEN l[k + 1][1:4] = '\end' THEN trim(regexp_extract(l[k + 1], '\{{([^}}]*)\}}', 1)) END AS x FROM r WHERE k < len(l)))
SELECT doc_id, strays, more, body, stack, array_to_string(list_transform(list_reverse(stack), lambda x: CASE x WHEN '{{' THEN '}}' WHEN 'left' THEN '\right.' ELSE '\end{{' || x || '}}' END), '') AS ends FROM r JOIN f USING (doc_id) WHERE k = len(l))"""


@query(f"SELECT doc_id, issues FROM {issues_sql(SPOILT)}")
def validate_whole_texts(spark, sf):
    return spoilt(spark, sf).select("doc_id", tex.static_validate(F.col("tex")).alias("issues"))


PARTS = rf"(SELECT doc_id, tex, split_part(tex, '\begin{{document}}', 1) || '\begin{{document}}' AS head, split_part(split_part(tex, '\begin{{document}}', 2), '\end{{document}}', 1) AS body, '\end{{document}}' || chr(10) AS tail FROM {SPOILT} WHERE contains(tex, '\end{{document}}'))"
REPAIRED = rf"""(SELECT doc_id, tex, head, tail, body || ends || repeat(chr(10) || '\]', shown) || CASE WHEN odd THEN '$' ELSE '' END AS body, list_filter([
 CASE WHEN strays > 0 THEN 'Removed ' || strays || ' unmatched closing brace(s).' END, CASE WHEN more > 0 THEN 'Balanced ' || more || ' \right without \left.' END, CASE WHEN len(named) > 0 THEN 'Closed ' || len(named) || ' unclosed environment(s): ' || array_to_string(named, ', ') || '.' END,
 CASE WHEN braces > 0 THEN 'Closed ' || braces || ' unclosed brace(s).' END, CASE WHEN sides > 0 THEN 'Balanced ' || sides || ' \left without \right.' END, CASE WHEN shown > 0 THEN 'Closed ' || shown || ' unterminated display equation(s).' END, CASE WHEN odd THEN 'Closed an unterminated inline equation.' END], lambda x: x IS NOT NULL) AS fixes
FROM (SELECT *, list_filter(stack, lambda x: x NOT IN ('{{', 'left')) AS named, len(list_filter(stack, lambda x: x = '{{')) AS braces, len(list_filter(stack, lambda x: x = 'left')) AS sides, greatest(0, (length(body) - length(replace(body, '\[', ''))) // 2 - (length(body) - length(replace(body, '\]', ''))) // 2) AS shown,
 (length(replace(body, '\$', '')) - length(replace(replace(body, '\$', ''), '$', ''))) % 2 = 1 AS odd FROM (SELECT p.doc_id, p.tex, p.head, p.tail, c.strays, c.more, c.body, c.stack, c.ends FROM {PARTS} p JOIN {closed_sql(f"(SELECT doc_id, body FROM {PARTS})")} c USING (doc_id))))"""


@query(rf"""SELECT s.doc_id, CASE WHEN better THEN r.head || r.body || r.tail ELSE s.tex END AS tex, CASE WHEN better THEN r.fixes ELSE [] END AS fixes, CASE WHEN better THEN a.issues ELSE b.issues END AS issues
FROM {SPOILT} s JOIN {issues_sql(SPOILT)} b USING (doc_id) LEFT JOIN {REPAIRED} r USING (doc_id) LEFT JOIN {issues_sql(f"(SELECT doc_id, head || body || tail AS tex FROM {REPAIRED})")} a USING (doc_id), LATERAL (SELECT coalesce(len(b.issues) > 0 AND len(a.issues) < len(b.issues), false) AS better)""")
def repair_documents(spark, sf):
    """Whole texts as sources, closed up where that leaves fewer issues."""
    return spoilt(spark, sf).select("doc_id", tex.repair(F.col("tex")).alias("r")).select("doc_id", "r.tex", "r.fixes", "r.issues")


EXPRESSIONS = [r"\frac{a}{", r"a \\ b", r"x \right) \tag{1}", r"\input{x}", r"x } } \{ \tag{1}", r"\left[ \begin{array}{c} {x ", r"\begin{array}{c} a & b \end{array} \left( { \right)", "50% $"]
MATHS = f"(SELECT doc_id, list_extract([{', '.join(map(literal, EXPRESSIONS))}], CAST(doc_id % {len(EXPRESSIONS)} + 1 AS BIGINT)) || text AS latex FROM documents WHERE text IS NOT NULL)"


@query(rf"""WITH s AS (SELECT doc_id, regexp_replace(latex, '^\s+|\s+$', '', 'g') AS latex FROM {MATHS}),
b AS (SELECT doc_id, latex, regexp_replace(regexp_replace(latex, '(\\[A-Za-z])|\\[^\n]|%[^\n]*', '\1' || chr(1), 'g'), '(\\[A-Za-z])' || chr(1), '\1', 'g') AS code FROM s),
u AS (SELECT doc_id, latex, list_filter([CASE WHEN regexp_matches(code, '\\write\s*18\b') THEN '\write18 (runs shell commands)' END, CASE WHEN regexp_matches(code, '\\openin([^a-zA-Z]|$)') THEN '\openin (reads files)' END, CASE WHEN regexp_matches(code, '\\input([^a-zA-Z]|$)') THEN '\input (reads another file)' END, CASE WHEN regexp_matches(code, '\\include([^a-zA-Z]|$)') THEN '\include (reads another file)' END], lambda x: x IS NOT NULL) AS unsafe FROM b),
w AS (SELECT doc_id, regexp_replace(body || ends, '\\(?:tag|label)\s*\*?\s*\{{[^}}]*\}}|\\(?:notag|nonumber)\b', ' ', 'g') AS body FROM {closed_sql("(SELECT doc_id, replace(replace(latex, '$', ''), '%', '\\%') AS body FROM u WHERE len(unsafe) = 0 AND latex <> '')")}),
a AS (SELECT doc_id, unnest(l) AS tok, generate_subscripts(l, 1) AS k FROM (SELECT doc_id, regexp_extract_all(body, '\\begin\s*\{{[^}}]*\}}|\\end\s*\{{[^}}]*\}}|\\\\|&') AS l FROM w)),
p AS (SELECT doc_id, tok, sum(CASE WHEN tok[1:6] = '\begin' THEN 1 WHEN tok[1:4] = '\end' THEN -1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS depth, k FROM a),
n AS (SELECT doc_id, bool_or(tok IN ('\\', '&') AND depth <= least(0, low)) AS top FROM (SELECT *, min(depth) OVER (PARTITION BY doc_id ORDER BY k) AS low FROM p) GROUP BY doc_id),
z AS (SELECT doc_id, regexp_replace(CASE WHEN top THEN '\begin{{aligned}}' || body || '\end{{aligned}}' ELSE body END, '^\s+|\s+$', '', 'g') AS body FROM w LEFT JOIN n USING (doc_id))
SELECT doc_id, coalesce(z.body, '') AS latex, coalesce(z.body, '') <> '' AS ok, CASE WHEN u.latex = '' THEN 'empty' WHEN len(unsafe) > 0 THEN 'unsafe construct: ' || array_to_string(unsafe, ', ') WHEN coalesce(z.body, '') = '' THEN 'nothing left' ELSE '' END AS reason FROM u LEFT JOIN z USING (doc_id)""")
def sanitise_math(spark, sf):
    """Expressions that end in whole texts, made safe or dropped."""
    first = F.get(F.array(*(F.lit(x) for x in EXPRESSIONS)), (F.col("doc_id") % len(EXPRESSIONS)).cast("int"))
    return read(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", tex.sanitise(F.concat(first, "text")).alias("r")).select("doc_id", "r.latex", "r.ok", "r.reason")


PLAIN = r"""trim(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(tex, '\\begin\{[\s\S]*?\}|\\end\{[\s\S]*?\}', ' ', 'g'), '\$\$([\s\S]+?)\$\$', ' ', 'g'), '\$([\s\S]+?)\$', ' ', 'g'), '\\\[([\s\S]+?)\\\]', ' ', 'g'), '\\[a-zA-Z@]+\*?', ' ', 'g'), '[{}$&\\~^_#]', ' ', 'g')), '\s+', ' ', 'g'))"""
SHOWN = r"(SELECT item_id, replace('$x_{1}+' || chr(CAST(97 + item_id % 26 AS INT)) || '$ \[ \frac{a}{b} \] ' || text, '%', '') AS tex, 'x_1+' || chr(CAST(97 + item_id % 26 AS INT)) AS first FROM benchmark)"


@query(rf"""SELECT item_id, plain, greatest(0, 1 - levenshtein(plain, plain || ' tail') / CAST(length(plain) AS DOUBLE)) AS text, 1 - (levenshtein(first, 'x_1+z') + length('\fracab')) / CAST(length(first) + length('\fracab') AS DOUBLE) AS math FROM (SELECT item_id, first, {PLAIN} AS plain FROM {SHOWN})""")
def text_and_math_score(spark, sf):
    """Prose against itself with one more word, and formulas against one that is close to the first."""
    shown = F.replace(F.concat(F.lit("$x_{1}+"), F.char(97 + F.col("item_id") % 26), F.lit("$ \\[ \\frac{a}{b} \\] "), "text"), F.lit("%"), F.lit(""))
    t = F.col("tex")
    rows = read(spark, sf, "benchmark").select("item_id", shown.alias("tex"))
    return rows.select("item_id", text.plain_text(t).alias("plain"), text.text_score(t, F.concat(t, F.lit(" tail"))).alias("text"), tex.math_score(text.math_expressions(t), text.math_expressions(F.lit("$x_1+z$"))).alias("math"))
