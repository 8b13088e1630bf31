"""Queries over pixels, regions of pages and what is left of documents, with their SQL.

Embeddings stand in for pictures of eight by eight pixels, orders for units of documents.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import images, tex
from quire.operators import layout
from quire.plans import chain
from quire.registry import query, read

# --- pixels ------------------------------------------------------------------------


def pixel_rows(spark: SparkSession, sf: str, at: str = "p", most: int = 255) -> DataFrame:
    """(vec_id, px): at is SQL that makes an image of p, the vector's 64 pixels."""
    p = F.transform("embedding", lambda x: F.greatest(F.lit(0), F.least(F.lit(most), F.floor(F.lit(128.0) + F.lit(900.0) * x.cast("double")))).cast("double"))
    return read(spark, sf, "embeddings").select("vec_id", p.alias("p")).select("vec_id", F.expr(at).alias("px"))


def pixels(at: str = "p", most: int = 255) -> str:
    p = f"list_transform(embedding, lambda x: CAST(greatest(0, least({most}, floor(128 + 900 * CAST(x AS DOUBLE)))) AS BIGINT))"
    return f"(SELECT vec_id, {at} AS px FROM (SELECT vec_id, {p} AS p FROM embeddings))"


RGB = "transform(sequence(0, 191), i -> p[((i div 3) + (i % 3)) % 64])"
RGB_SQL = "list_transform(range(192), lambda i: p[(i // 3 + i % 3) % 64 + 1])"
WIDE = "transform(sequence(0, 1599), i -> p[(i div 200) * 8 + (i % 40) div 5])"  # 40 by 40
WIDE_SQL = "list_transform(range(1600), lambda i: p[(i // 200) * 8 + (i % 40) // 5 + 1])"
TALL = "transform(sequence(0, 1535), i -> p[(i div 8) div 3] + 10 * (i % 8))"  # 192 rows of 8
TALL_SQL = "list_transform(range(1536), lambda i: p[(i // 8) // 3 + 1] + 10 * (i % 8))"
THRESHOLD = "greatest(least(list_avg(px) - list_stddev_pop(px), 200), 60)"


@query(f"SELECT vec_id, list_transform(range(64), lambda i: CAST((299 * px[3 * i + 1] + 587 * px[3 * i + 2] + 114 * px[3 * i + 3]) // 1000 AS INT)) AS grey FROM {pixels(RGB_SQL)}")
def image_grey(spark, sf):
    return images.mapped(pixel_rows(spark, sf, RGB), "vec_id", "px", (8, 8, 3), lambda x: {"grey": images.grey(x).ravel().tolist()}, "grey array<int>")


@query(f"SELECT vec_id, CAST(len(list_filter(px, lambda x: x < t)) AS BIGINT) AS ink, list_transform(range(8), lambda y: CAST(len(list_filter(px[8 * y + 1 : 8 * y + 8], lambda x: x < t)) AS INT)) AS by_row FROM (SELECT vec_id, px, {THRESHOLD} AS t FROM {pixels()})")
def image_ink(spark, sf):
    """Ink of each picture and of its rows."""

    def kernel(x: np.ndarray) -> dict[str, object]:
        mask = images.ink_mask(x)
        return {"ink": int(mask.sum()), "by_row": mask.sum(1).tolist()}

    return images.mapped(pixel_rows(spark, sf), "vec_id", "px", (8, 8), kernel, "ink bigint, by_row array<int>")


@query(f"""SELECT vec_id, CASE WHEN count(*) FILTER (d) > 0 THEN [min(x) FILTER (d), min(y) FILTER (d), max(x) FILTER (d) + 1, max(y) FILTER (d) + 1] END AS box
FROM (SELECT vec_id, CAST(i % 8 AS INT) AS x, CAST(i // 8 AS INT) AS y, i % 8 BETWEEN 2 AND 6 AND i // 8 BETWEEN 1 AND 5 AND NOT (px[3 * i + 1] > 235 AND px[3 * i + 2] > 235 AND px[3 * i + 3] > 235) AS d FROM (SELECT vec_id, px, unnest(range(64)) AS i FROM {pixels(RGB_SQL)})) GROUP BY vec_id""")
def image_measured(spark, sf):
    """The box of what isn't white inside padded bounds."""

    def kernel(x: np.ndarray) -> dict[str, object]:
        box = images.measure_ink(x, (3, 2, 6, 5), 1)
        return {"box": list(box) if box else None}

    return images.mapped(pixel_rows(spark, sf, RGB), "vec_id", "px", (8, 8, 3), kernel, "box array<int>")


@query(f"""WITH m AS (SELECT vec_id, i % 40 AS x, i // 40 AS y FROM (SELECT vec_id, unnest(px) AS v, unnest(range(1600)) AS i, t FROM (SELECT vec_id, px, {THRESHOLD} AS t FROM {pixels(WIDE_SQL)})) WHERE v < t AND i % 40 BETWEEN 3 AND 36 AND i // 40 BETWEEN 12 AND 36)
SELECT vec_id, CASE WHEN x0 IS NULL THEN [3, 12, 37, 37] ELSE [greatest(3, x0 - 8), greatest(12, y0 - 8), least(37, x1 + 9), least(37, y1 + 9)] END AS box
FROM (SELECT vec_id FROM embeddings) LEFT JOIN (SELECT vec_id, CAST(min(x) AS INT) AS x0, CAST(min(y) AS INT) AS y0, CAST(max(x) AS INT) AS x1, CAST(max(y) AS INT) AS y1 FROM m GROUP BY vec_id) USING (vec_id)""")
def image_tightened(spark, sf):
    """A box drawn in to the ink inside it, padded."""
    return images.mapped(pixel_rows(spark, sf, WIDE), "vec_id", "px", (40, 40), lambda x: {"box": list(images.tighten(images.ink_mask(x), (3, 12, 37, 37)))}, "box array<int>")


@query(f"""WITH p AS (SELECT vec_id, px, {THRESHOLD} AS t FROM {pixels(TALL_SQL, 180)}),
y AS (SELECT vec_id, y, len(list_filter(px[8 * y + 1 : 8 * y + 8], lambda x: x < t)) AS ink FROM (SELECT vec_id, px, t, unnest(range(192)) AS y FROM p)),
l AS (SELECT vec_id, min(y) AS a, max(y) + 1 AS b FROM (SELECT vec_id, y, y - row_number() OVER (PARTITION BY vec_id ORDER BY y) AS g FROM y WHERE ink > 0) GROUP BY vec_id, g),
g AS (SELECT vec_id, greatest(CAST(floor(list_sort(list(b - a))[count(*) // 2 + 1] * 0.35) AS BIGINT), 5) AS gap FROM l GROUP BY vec_id),
n AS (SELECT vec_id, a, b, sum(CASE WHEN a - before < gap THEN 0 ELSE 1 END) OVER (PARTITION BY vec_id ORDER BY a) AS k FROM (SELECT l.*, gap, lag(b) OVER (PARTITION BY vec_id ORDER BY a) AS before FROM l JOIN g USING (vec_id))),
d AS (SELECT vec_id, min(a) AS a, max(b) AS b FROM n GROUP BY vec_id, k),
f AS (SELECT d.vec_id, d.a, d.b FROM d JOIN y ON d.vec_id = y.vec_id AND y.y >= d.a AND y.y < d.b GROUP BY ALL HAVING d.b - d.a >= 12 AND sum(ink) / (8 * (d.b - d.a)) BETWEEN 0.002 AND 0.9),
r AS (SELECT vec_id, list([0, greatest(0, a - 8), 8, least(192, b + 8)] ORDER BY a) AS boxes FROM f GROUP BY vec_id HAVING count(*) > 1)
SELECT vec_id, CASE WHEN boxes IS NULL THEN [[0, 0, 8, 192]] ELSE boxes END AS boxes FROM (SELECT vec_id FROM embeddings) LEFT JOIN r USING (vec_id)""")
def image_bands(spark, sf):
    """Bands of ink of tall pages, as boxes."""
    return images.mapped(pixel_rows(spark, sf, TALL, 180), "vec_id", "px", (192, 8), lambda x: {"boxes": [list(b) for b in images.segment_boxes(images.ink_mask(x))]}, "boxes array<array<bigint>>")


def weights_sql(to: int, kind: str) -> str:
    """(o, i, w): how an output pixel mixes eight input pixels."""
    support = 2 if kind == "cubic" else 3
    value = "CASE WHEN t < 1 THEN (1.5 * t - 2.5) * t * t + 1 WHEN t < 2 THEN -0.5 * (((t - 5) * t + 8) * t - 4) ELSE 0 END" if kind == "cubic" else "CASE WHEN t = 0 THEN 1 WHEN t < 3 THEN sin(pi() * t) / (pi() * t) * sin(pi() * t / 3) / (pi() * t / 3) ELSE 0 END"
    raw = f"(SELECT o, i, abs(i - c + 0.5) / wide AS t, i >= greatest(floor(c - {support} * wide + 0.5), 0) AND i < least(ceil(c + {support} * wide + 0.5), 8) AS inside FROM (SELECT o, i, (o + CAST(0.5 AS DOUBLE)) * 8 / {to} AS c, greatest(CAST(1 AS DOUBLE), CAST(8 AS DOUBLE) / {to}) AS wide FROM range({to}) a(o), range(8) b(i)))"
    return f"(SELECT o, i, v / sum(v) OVER (PARTITION BY o) AS w FROM (SELECT o, i, CASE WHEN inside THEN {value} ELSE 0 END AS v FROM {raw}))"


def resized_sql(width: int, height: int, kind: str, source: str) -> str:
    """(vec_id, c, y, x, v) of source (vec_id, c, y, x, v)."""
    return f"(SELECT vec_id, c, a.o AS y, b.o AS x, sum(a.w * b.w * s.v) AS v FROM {source} s JOIN {weights_sql(height, kind)} a ON a.i = s.y JOIN {weights_sql(width, kind)} b ON b.i = s.x GROUP BY ALL)"


GREY_CELLS = f"(SELECT vec_id, 0 AS c, i // 8 AS y, i % 8 AS x, px[i + 1] AS v FROM (SELECT vec_id, px, unnest(range(64)) AS i FROM {pixels()}))"
RGB_CELLS = f"(SELECT vec_id, i % 3 AS c, i // 24 AS y, i // 3 % 8 AS x, px[i + 1] AS v FROM (SELECT vec_id, px, unnest(range(192)) AS i FROM {pixels(RGB_SQL)}))"


@query(f"SELECT vec_id, list(round(v, 4) + 0.0 ORDER BY y, x) AS pixels FROM {resized_sql(5, 3, 'cubic', GREY_CELLS)} GROUP BY vec_id")
def image_resized(spark, sf):
    return images.mapped(pixel_rows(spark, sf), "vec_id", "px", (8, 8), lambda x: {"pixels": (np.round(images.resized(x, 5, 3), 4) + 0.0).ravel().tolist()}, "pixels array<double>")


@query(f"SELECT vec_id, CAST(2 AS DOUBLE) AS factor, list(CAST(greatest(0, least(255, round_even(v, 0))) AS INT) ORDER BY y, x) AS pixels FROM {resized_sql(16, 16, 'lanczos', GREY_CELLS)} GROUP BY vec_id")
def image_upscaled(spark, sf):
    def kernel(x: np.ndarray) -> dict[str, object]:
        big, factor = images.upscaled(x)
        return {"factor": factor, "pixels": big.ravel().tolist()}

    return images.mapped(pixel_rows(spark, sf), "vec_id", "px", (8, 8), kernel, "factor double, pixels array<int>")


@query(f"SELECT vec_id, list(round((greatest(0, least(255, round_even(v, 0))) / 255 - 0.5) / 0.5, 4) + 0.0 ORDER BY c, y, x) AS planes FROM {resized_sql(5, 5, 'cubic', RGB_CELLS)} GROUP BY vec_id")
def image_tensor(spark, sf):
    """Planes from -1 to 1."""
    return images.mapped(pixel_rows(spark, sf, RGB), "vec_id", "px", (8, 8, 3), lambda x: {"planes": [round(float(v), 4) + 0.0 for v in images.tensor(x, 5).astype(float).ravel()]}, "planes array<double>")


@query(f"""WITH s AS (SELECT vec_id, px, i, cos(radians(7)) * dx - sin(radians(7)) * dy + 3.5 AS sx, sin(radians(7)) * dx + cos(radians(7)) * dy + 3.5 AS sy FROM (SELECT vec_id, px, unnest(range(64)) AS i, i % 8 - CAST(3.5 AS DOUBLE) AS dx, i // 8 - CAST(3.5 AS DOUBLE) AS dy FROM {pixels()})),
c AS (SELECT *, CAST(floor(sx) AS BIGINT) AS x, CAST(floor(sy) AS BIGINT) AS y, sx - floor(sx) AS fx, sy - floor(sy) AS fy FROM s)
SELECT vec_id, list(CASE WHEN x >= 0 AND y >= 0 AND x < 7 AND y < 7 THEN CAST(floor((px[8 * y + x + 1] * (1 - fx) + px[8 * y + x + 2] * fx) * (1 - fy) + (px[8 * y + x + 9] * (1 - fx) + px[8 * y + x + 10] * fx) * fy) AS INT) ELSE 0 END ORDER BY i) AS pixels FROM c GROUP BY vec_id""")
def image_rotated(spark, sf):
    return images.mapped(pixel_rows(spark, sf), "vec_id", "px", (8, 8), lambda x: {"pixels": images.rotated(x, 7.0).ravel().tolist()}, "pixels array<int>")


RGBA = "transform(sequence(0, 255), i -> p[((i div 4) + 5 * (i % 4)) % 64])"
RGBA_SQL = "list_transform(range(256), lambda i: p[(i // 4 + 5 * (i % 4)) % 64 + 1])"


@query(f"SELECT vec_id, len(list_filter(range(64), lambda i: px[4 * i + 4] < 255)) > 0 AS transparent, list_transform(range(192), lambda i: CAST((px[4 * (i // 3) + i % 3 + 1] * px[4 * (i // 3) + 4] + 255 * (255 - px[4 * (i // 3) + 4]) + 127) // 255 AS INT)) AS pixels FROM {pixels(RGBA_SQL)}")
def image_flattened(spark, sf):
    def kernel(x: np.ndarray) -> dict[str, object]:
        flat, transparent = images.flattened(x)
        return {"transparent": transparent, "pixels": flat.ravel().tolist()}

    return images.mapped(pixel_rows(spark, sf, RGBA), "vec_id", "px", (8, 8, 4), kernel, "transparent boolean, pixels array<int>")


PLACES = "CASE code WHEN 1 THEN 8 * y + x WHEN 2 THEN 8 * y + 7 - x WHEN 3 THEN 8 * (7 - y) + 7 - x WHEN 4 THEN 8 * (7 - y) + x WHEN 5 THEN 8 * x + y WHEN 6 THEN 8 * (7 - x) + y WHEN 7 THEN 8 * (7 - x) + 7 - y WHEN 8 THEN 8 * x + 7 - y END"


@query(f"SELECT vec_id, code, list(CAST(px[{PLACES} + 1] AS INT) ORDER BY y, x) AS pixels FROM (SELECT vec_id, px, code, i // 8 AS y, i % 8 AS x FROM (SELECT vec_id, px, unnest(range(64)) AS i FROM {pixels()}), (SELECT CAST(unnest(range(1, 9)) AS INT) AS code)) GROUP BY vec_id, code")
def image_oriented(spark, sf):
    """Each picture set upright for every orientation code."""
    made = images.mapped(pixel_rows(spark, sf), "vec_id", "px", (8, 8), lambda x: {"all": [{"code": c, "pixels": images.oriented(x, c).ravel().tolist()} for c in range(1, 9)]}, "all array<struct<code:int,pixels:array<int>>>")
    return made.select("vec_id", F.inline("all"))


@query(f"SELECT vec_id, CAST(list_sum(list_transform(range(1, 8), lambda y: (r[y + 1] - r[y]) * (r[y + 1] - r[y]))) AS DOUBLE) AS change FROM (SELECT vec_id, list_transform(range(8), lambda y: len(list_filter(px[8 * y + 1 : 8 * y + 8], lambda x: x < 128))) AS r FROM {pixels()})")
def image_row_changes(spark, sf):
    """What a page is straightened by: the change of ink from row to row."""
    return images.mapped(pixel_rows(spark, sf), "vec_id", "px", (8, 8), lambda x: {"change": images.row_change(x < 128)}, "change double")


@query(f"SELECT vec_id, CAST(list_position(px, list_max(px)) - 1 AS INT) AS best FROM {pixels()}")
def image_first_max(spark, sf):
    return images.mapped(pixel_rows(spark, sf), "vec_id", "px", (64,), lambda x: {"best": images.first_max(x)}, "best int")


# --- regions -------------------------------------------------------------------------


def lines_and_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Text lines and boxes from lineitem: a page is an order, a line an item."""
    first = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_returnflag")
    t = F.expr("CAST(l_partkey % 200 * 3 AS INT)")
    return read(spark, sf, "lineitem").withColumn("_k", F.row_number().over(first)).where("_k = 1").select(
        F.col("l_orderkey").alias("page"), (F.col("l_orderkey") * 100 + F.col("l_linenumber") * 10).cast("bigint").alias("id"), F.expr("CAST(l_suppkey % 50 AS INT)").alias("l"), t.alias("t"), F.expr("CAST(l_suppkey % 50 + 100 AS INT)").alias("r"),
        (t + F.expr("CAST(10 + l_quantity AS INT)")).alias("b"), F.expr("CAST(l_discount * 1000 AS INT)").alias("min_conf"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("k"), F.col("l_returnflag").alias("text"),
    )


LINES = """(SELECT DISTINCT ON (l_orderkey, l_linenumber) l_orderkey AS page, CAST(l_orderkey * 100 + l_linenumber * 10 AS BIGINT) AS id, CAST(l_suppkey % 50 AS INT) AS l, CAST(l_partkey % 200 * 3 AS INT) AS t, CAST(l_suppkey % 50 + 100 AS INT) AS r, CAST(l_partkey % 200 * 3 AS INT) + CAST(10 + l_quantity AS INT) AS b,
 CAST(l_discount * 1000 AS INT) AS min_conf, l_linenumber AS n, l_partkey AS k, l_returnflag AS text FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_returnflag)"""
OVERLAPS = "x.page = y.page AND least(x.b, y.b) > greatest(x.t, y.t) AND (least(x.b, y.b) - greatest(x.t, y.t)) / least(x.b - x.t, y.b - y.t) >= 0.5"


@query(f"SELECT page, id FROM {LINES} y WHERE n <= 2 AND EXISTS (SELECT 1 FROM {LINES} x WHERE x.n > 2 AND {OVERLAPS})")
def covered_regions(spark, sf):
    rows = lines_and_boxes(spark, sf)
    return layout.covered(rows.where("n <= 2"), rows.where("n > 2")).select("page", "id")


@query(f"""WITH ln AS (SELECT * FROM {LINES} WHERE n > 2), bx AS (SELECT * FROM {LINES} WHERE n <= 2), tall AS (SELECT * FROM bx WHERE b - t >= 14),
sp AS (SELECT y.page, y.id, x.t AS st, x.b AS sb FROM tall y JOIN ln x ON {OVERLAPS} AND x.n % 3 = 0),
st AS (SELECT page, id, t AS q, b FROM tall UNION SELECT page, id, sb, b FROM sp JOIN tall USING (page, id) WHERE sb < b),
pc AS (SELECT page, id, q AS t, least(b, coalesce((SELECT min(sp.st) FROM sp WHERE sp.page = st.page AND sp.id = st.id AND sp.st >= st.q), b)) AS b FROM st WHERE NOT EXISTS (SELECT 1 FROM sp WHERE sp.page = st.page AND sp.id = st.id AND sp.st <= st.q AND sp.sb > st.q)),
ok AS (SELECT * FROM pc WHERE b - t >= 14),
jd AS (SELECT y.page, y.id, y.t, y.b, count(x.id) AS n, min(x.min_conf) AS weakest, min(x.l) AS l, max(x.r) AS r FROM ok y LEFT JOIN ln x ON {OVERLAPS} GROUP BY ALL),
tk AS (SELECT *, n = 0 OR weakest < 50 OR (l >= 200 * 0.12 AND abs(l - (200 - r)) < 200 * 0.18) AS take FROM jd)
SELECT page, id AS box_id, CAST(t AS BIGINT) AS t, CAST(b AS BIGINT) AS b, false AS nominated, 'too short to be a displayed formula' AS reason FROM bx WHERE b - t < 14
UNION ALL SELECT page, id, t, b, false, 'the region is prose, not displayed maths' FROM tall WHERE NOT EXISTS (SELECT 1 FROM ok WHERE ok.page = tall.page AND ok.id = tall.id)
UNION ALL SELECT page, id, t, b, take, CASE WHEN NOT take THEN 'read as text (min conf ' || weakest || ')' END FROM tk""")
def nominate_regions(spark, sf):
    """Pieces of boxes that may be formulas, and why others aren't; every third line is prose."""
    rows = lines_and_boxes(spark, sf).withColumn("text", F.when(F.col("n") % 3 == 0, "some longer words here").otherwise("x 1"))
    return layout.nominated(rows.where("n > 2"), rows.where("n <= 2").withColumn("width", F.lit(200)))


@query(f"""WITH i AS (SELECT page // 8 AS doc, page, row_number() OVER (PARTITION BY page ORDER BY t, l, id) AS ord, n = 1 AS eq, text, b - t AS h, n % 2 AS block FROM {LINES}),
m AS (SELECT doc, list_sort(list(h))[count(*) // 2 + 1] AS body FROM i WHERE NOT eq GROUP BY doc),
s AS (SELECT i.*, CASE WHEN eq THEN 'equation' WHEN h > coalesce(body, 0) * 1.15 THEN 'heading' ELSE 'text' END AS shown FROM i LEFT JOIN m USING (doc)),
n AS (SELECT *, lag(page) OVER w AS p0, lag(shown) OVER w IS NULL OR lag(shown) OVER w <> 'text' OR shown <> 'text' OR lag(page) OVER w <> page OR lag(block) OVER w <> block AS new FROM s WINDOW w AS (PARTITION BY doc ORDER BY page, ord)),
g AS (SELECT *, sum(CAST(new AS INT)) OVER (PARTITION BY doc ORDER BY page, ord) AS piece FROM n),
p AS (SELECT doc, piece, bool_or(coalesce(p0 <> page, false)) AS seam, bool_or(eq) AS math, string_agg(CASE shown WHEN 'equation' THEN '\\[' || chr(10) || text || chr(10) || '\\]' WHEN 'heading' THEN '\\section{{' || text || '}}' ELSE text END, ' ' ORDER BY page, ord) AS part FROM g GROUP BY doc, piece)
SELECT doc, '\\documentclass{{article}}' || chr(10) || '\\usepackage[utf8]{{inputenc}}' || chr(10) || '\\usepackage[T1]{{fontenc}}' || CASE WHEN bool_or(math) THEN chr(10) || '\\usepackage{{amsmath}}' ELSE '' END || chr(10) || '\\begin{{document}}' || chr(10) || chr(10)
 || string_agg(CASE WHEN seam THEN '\\clearpage' || chr(10) || chr(10) ELSE '' END || part, chr(10) || chr(10) ORDER BY piece) || chr(10) || chr(10) || '\\end{{document}}' || chr(10) AS tex FROM p GROUP BY doc""")
def emit_tex(spark, sf):
    """Whole documents from items in reading order: a document is eight pages."""
    first = Window.partitionBy("page").orderBy("t", "l", "id")
    items = lines_and_boxes(spark, sf).withColumns({"ord": F.row_number().over(first), "kind": F.when(F.col("n") == 1, "equation").otherwise("text"), "doc": F.expr("page div 8"), "block": F.col("n") % 2, "par": F.lit(1)})
    return layout.emitted(items, tex.escape)


READ = "CASE k % 7 WHEN 0 THEN 'x^{2} + 1' WHEN 1 THEN 'some plain words' WHEN 2 THEN '\\input{a} = b' WHEN 3 THEN '' WHEN 4 THEN 'on on on on on on on' WHEN 5 THEN '\\mathrm{M o r e ~ w o r d s}' ELSE 'a = \\frac{b}{c}' END"


@query(f"""WITH y AS (SELECT *, {READ} AS latex, k % 11 > 0 AS complete FROM {LINES} WHERE n <= 2),
c AS (SELECT y.*, EXISTS (SELECT 1 FROM {LINES} x WHERE x.n > 2 AND {OVERLAPS}) AS seen, regexp_matches(latex, '[=<>^_+]|\\\\frac') AS math, contains(latex, '\\input') AS unsafe FROM y),
w AS (SELECT page, id, latex, seen, complete, math, unsafe, CASE WHEN contains(latex, 'mathrm') THEN 'More words' ELSE latex END AS words FROM c),
f AS (SELECT *, CASE WHEN NOT complete THEN 'dropped' WHEN latex = '' THEN 'none' WHEN math THEN CASE WHEN unsafe THEN 'dropped' ELSE 'found' END WHEN seen THEN 'covered' WHEN len(string_split(words, ' ')) >= 6 AND len(list_distinct(string_split(words, ' '))) <= 0.25 * len(string_split(words, ' ')) THEN 'none' ELSE 'salvaged' END AS fate FROM w)
SELECT page, id, fate, CASE fate WHEN 'found' THEN latex WHEN 'salvaged' THEN words END AS "read" FROM f""")
def region_readings(spark, sf):
    """What becomes of the readings of regions: found, dropped, covered by text, salvaged as words, or nothing."""
    rows = lines_and_boxes(spark, sf)
    read_ = F.expr(READ.replace("\\", "\\\\"))
    boxes = rows.where("n <= 2").select("page", "id", "l", "t", "r", "b", read_.alias("latex"), (F.col("k") % 11 > 0).alias("complete"))
    return layout.regions_read(boxes, rows.where("n > 2")).select("page", "id", "fate", "read")


WORDS = "(SELECT l_orderkey AS page, l_suppkey % 2 AS block, l_partkey % 2 AS par, l_linenumber % 2 AS line, l_linenumber AS ord, CASE WHEN l_partkey % 9 = 0 THEN ' ' ELSE l_returnflag || l_partkey END AS text, CASE WHEN l_partkey % 10 = 0 THEN -1 WHEN l_partkey % 13 = 0 THEN CAST('NaN' AS DOUBLE) ELSE l_tax * 1000 + 0.5 END AS conf, l_suppkey % 50 AS l, l_partkey % 70 AS t FROM lineitem)"


@query(f"SELECT page, block, par, line, string_agg(text, ' ' ORDER BY ord, text) AS text, CAST(min(floor(conf)) AS BIGINT) AS min_conf, round(avg(conf), 4) AS mean_conf, min(l) AS l, min(t) AS t, max(l + 20) AS r, max(t + 9) AS b FROM {WORDS} WHERE trim(text) <> '' AND conf >= 0 AND NOT isnan(conf) GROUP BY ALL")
def words_of_lines(spark, sf):
    """Lines from words: unread and blank ones are left out."""
    words = read(spark, sf, "lineitem").selectExpr(
        "l_orderkey page", "l_suppkey % 2 block", "l_partkey % 2 par", "l_linenumber % 2 line", "l_linenumber ord", "CASE WHEN l_partkey % 9 = 0 THEN ' ' ELSE concat(l_returnflag, l_partkey) END text",
        "CASE WHEN l_partkey % 10 = 0 THEN -1D WHEN l_partkey % 13 = 0 THEN double('NaN') ELSE l_tax * 1000 + 0.5D END conf", "l_suppkey % 50 l", "l_partkey % 70 t", "l_suppkey % 50 + 20 r", "l_partkey % 70 + 9 b",
    )
    return layout.line_words(words).withColumn("mean_conf", F.round("mean_conf", 4))


@query("SELECT event_id, w > 0 AND a >= w * 0.12 AND abs(a - (w - z)) < w * 0.18 AS centred FROM (SELECT event_id, 200 AS w, event_id % 90 AS a, 100 + event_id % 97 AS z FROM events)")
def centred_regions(spark, sf):
    left, right = (F.col("event_id") % 90).cast("int"), (100 + F.col("event_id") % 97).cast("int")
    return read(spark, sf, "events").select("event_id", layout.is_centred(left, right, F.lit(200)).alias("centred"))


HEADS = r"CASE event_id % 6 WHEN 0 THEN '1.2 Results of it' WHEN 1 THEN '3 Method' WHEN 2 THEN 'A plain line that has many more words than eight in all' WHEN 3 THEN 'Ends with a stop.' WHEN 4 THEN '' ELSE 'Some title' END"


@query(rf"SELECT event_id, s <> '' AND len(string_split_regex(s, '\s+')) <= 8 AND NOT regexp_matches(s, '[.,;:]$') AND (h > 20 * 1.15 OR regexp_matches(s, '^\d+(\.\d+)*\s')) AS heading, CASE WHEN contains(regexp_extract(s, '^\d+(\.\d+)*\s'), '.') THEN 'subsection' ELSE 'section' END AS level FROM (SELECT event_id, {HEADS} AS s, 15 + event_id % 17 AS h FROM events)")
def headings(spark, sf):
    s, height = F.expr(HEADS), (15 + F.col("event_id") % 17).cast("int")
    return read(spark, sf, "events").select("event_id", layout.is_heading(s, height, F.lit(20)).alias("heading"), layout.heading_level(s).alias("level"))


# --- documents -------------------------------------------------------------------------


def failing_pages(spark: SparkSession, sf: str) -> DataFrame:
    page = F.when(F.col("o_orderstatus") != "P", F.lit(1))
    notes = F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit("too dark"), F.lit("skewed"))).when(F.col("o_orderkey") % 3 == 1, F.array().cast("array<string>"))
    return read(spark, sf, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("unit"), page.alias("page"), (F.col("o_orderkey") % 5 > 0).alias("read"), (F.col("o_orderkey") % 50 + 100).alias("height"), notes.alias("notes"))


@query("""SELECT doc, unit, page, CAST(number AS INT) AS number, CAST(coalesce(sum(CASE WHEN ok THEN unit % 50 + 100 ELSE 0 END) OVER (PARTITION BY doc ORDER BY unit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
 CASE WHEN NOT ok THEN ['Page ' || number || ' could not be read and was skipped.'] WHEN unit % 3 = 0 THEN ['Page ' || number || ': too dark', 'Page ' || number || ': skewed'] ELSE CAST([] AS VARCHAR[]) END AS notes
FROM (SELECT o_custkey AS doc, o_orderkey AS unit, CASE WHEN o_orderstatus <> 'P' THEN 1 END AS page, o_orderstatus <> 'P' AND o_orderkey % 5 > 0 AS ok, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) + 3 AS number FROM orders)""")
def local_pages(spark, sf):
    """Pages that local readers were given from the fourth on: those that fail leave a note, and the rest goes on."""
    return chain.local_pages(failing_pages(spark, sf), 4)


@query('SELECT doc, number, place, CAST(row_number() OVER (PARTITION BY doc ORDER BY number, place) + 5 AS INT) AS "index" FROM (SELECT DISTINCT l_suppkey AS doc, l_orderkey AS number, l_linenumber AS place FROM lineitem)')
def equation_indices(spark, sf):
    return chain.equation_indices(read(spark, sf, "lineitem").selectExpr("l_suppkey doc", "l_orderkey number", "l_linenumber place").distinct(), 5)


ITEMS = "(SELECT l_orderkey AS doc, CASE WHEN l_linestatus = 'O' THEN 'text' ELSE 'equation' END AS kind, CASE WHEN l_linenumber = 2 THEN ' ' ELSE 'x' END AS text, CASE WHEN l_linenumber <> 3 THEN l_returnflag = 'N' END AS unsure FROM lineitem)"
OUTCOMES = "(SELECT o_orderkey AS doc, unnest(range(1, 4)) AS page FROM orders)"


@query(f"""SELECT doc, CAST(3 AS BIGINT) AS pages, a AS ai_pages, 3 - a AS fallback_pages, CASE WHEN a = 3 THEN 'ai' WHEN a = 0 THEN 'converters' ELSE 'mixed' END AS path, coalesce(tb, 0) AS "textBlocks", coalesce(eq, 0) AS equations, coalesce(un, 0) AS "uncertainLines"
FROM (SELECT doc, count(*) FILTER (bad IS NULL OR page < bad) AS a FROM (SELECT doc, page, min(CASE WHEN (doc + page) % 5 = 0 THEN page END) OVER (PARTITION BY doc) AS bad FROM {OUTCOMES}) GROUP BY doc)
LEFT JOIN (SELECT doc, count(*) FILTER (kind = 'text') AS tb, count(*) FILTER (kind = 'equation') AS eq, count(*) FILTER (kind = 'text' AND coalesce(unsure, false) AND trim(text) <> '') AS un FROM {ITEMS} GROUP BY doc) USING (doc)""")
def document_summary(spark, sf):
    """Pages by path, and what the result holds."""
    pages = read(spark, sf, "orders").select(F.col("o_orderkey").alias("doc"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("page")).withColumn("ok", (F.col("doc") + F.col("page")) % 5 != 0)
    items = read(spark, sf, "lineitem").selectExpr("l_orderkey doc", "CASE WHEN l_linestatus = 'O' THEN 'text' ELSE 'equation' END kind", "CASE WHEN l_linenumber = 2 THEN ' ' ELSE 'x' END text", "CASE WHEN l_linenumber <> 3 THEN l_returnflag = 'N' END uncertain")
    return chain.described(pages, items)


def answer_log(spark: SparkSession, sf: str) -> DataFrame:
    """Answers from lineitem: a document is eight orders, a page an order, a step an item."""
    k: Column = F.col("l_partkey")
    rows = read(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"))
    return rows.select(
        F.expr("l_orderkey div 8").alias("doc"), F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("step"), (F.col("l_linenumber") == 1).alias("speculative"), (k % 5 < 2).alias("ok"), (k % 23 > 0).alias("retryable"),
        F.when(k % 19 > 0, (k % 4).cast("int")).alias("next_attempt"), (k % 7 == 0).alias("same_model"), (k % 7 == 1).alias("without_thinking"), F.when(k % 2 == 0, "busy").otherwise("").alias("error"),
    )


@query("""WITH RECURSIVE a AS (SELECT l_orderkey // 8 AS doc, l_orderkey AS page, l_linenumber AS step, k, row_number() OVER (PARTITION BY l_orderkey // 8 ORDER BY l_orderkey, l_linenumber) AS n, lead(l_orderkey) OVER (PARTITION BY l_orderkey // 8 ORDER BY l_orderkey, l_linenumber) IS DISTINCT FROM l_orderkey AS ends FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS k FROM lineitem GROUP BY ALL)),
e AS (SELECT *, step = 1 AS spec, k % 5 < 2 AS good, k % 23 > 0 AS again, k % 19 = 0 AS none, CAST(k % 4 AS INT) AS nxt, k % 7 = 0 AS same, k % 7 = 1 AS plain, CASE WHEN k % 2 = 0 THEN 'busy' ELSE '' END AS err FROM a),
r AS (SELECT doc, CAST(0 AS BIGINT) AS n, CAST(-1 AS BIGINT) AS page, false AS ends, CAST(0 AS INT) AS attempt, false AS exhausted, '' AS fatal, false AS failed, false AS ok, false AS over, true AS thinking, false AS resent, CAST(0 AS INT) AS steps, '' AS said FROM (SELECT DISTINCT doc FROM a)
UNION ALL
SELECT doc, n, page, ends, CASE WHEN act = 'move' THEN greatest(attempt, nxt) ELSE attempt END, exhausted OR act = 'none', CASE WHEN act = 'none' THEN said2 ELSE fatal END, failed,
 ok OR act = 'ok' OR (act = 'spec' AND good), over OR act IN ('ok', 'fatal', 'none', 'gone', 'out') OR (act = 'spec' AND good) OR cap, CASE WHEN act = 'plain' THEN false WHEN act = 'move' THEN true ELSE thinking END, resent OR act = 'again',
 steps2, CASE WHEN act IN ('fatal', 'none', 'gone', 'out') THEN said2 WHEN cap THEN 'The AI conversion service is temporarily unavailable.' ELSE said END
FROM (SELECT *, act NOT IN ('skip', 'spec', 'out', 'ok', 'fatal', 'none', 'gone') AND steps2 = 10 AS cap FROM (
SELECT *, CASE WHEN act IN ('skip', 'spec', 'out') THEN steps ELSE steps + 1 END AS steps2,
 CASE act WHEN 'out' THEN fatal WHEN 'fatal' THEN err WHEN 'none' THEN CASE WHEN err = '' THEN 'Every AI model has reached its quota.' ELSE err END WHEN 'gone' THEN CASE WHEN err = '' THEN 'The page could not be sent to the AI conversion service.' ELSE err END END AS said2
FROM (SELECT *, CASE WHEN over OR failed THEN 'skip' WHEN spec THEN 'spec' WHEN exhausted THEN 'out' WHEN good THEN 'ok' WHEN NOT again THEN 'fatal' WHEN none THEN 'none' WHEN same THEN CASE WHEN resent THEN 'gone' ELSE 'again' END WHEN plain THEN 'plain' ELSE 'move' END AS act
FROM (SELECT e.doc, e.n, e.page, e.ends, r.attempt, r.exhausted, r.fatal, r.failed OR (r.page >= 0 AND r.page <> e.page AND NOT r.ok) AS failed, CASE WHEN r.page = e.page THEN r.ok ELSE false END AS ok, CASE WHEN r.page = e.page THEN r.over ELSE false END AS over, CASE WHEN r.page = e.page THEN r.thinking ELSE true END AS thinking, CASE WHEN r.page = e.page THEN r.resent ELSE false END AS resent, CASE WHEN r.page = e.page THEN r.steps ELSE 0 END AS steps, CASE WHEN r.page = e.page THEN r.said ELSE '' END AS said, e.spec, e.good, e.again, e.none, e.nxt, e.same, e.plain, e.err
FROM r JOIN e ON r.doc = e.doc AND e.n = r.n + 1)))))
SELECT doc, page, ok, steps, attempt, thinking, resent, exhausted, CASE WHEN over THEN said WHEN exhausted THEN fatal ELSE 'The AI conversion service is temporarily unavailable.' END AS error FROM r WHERE ends AND NOT failed""")
def conversion_rounds(spark, sf):
    """Retries of pages through the round of models that their document shares."""
    return chain.rounds(answer_log(spark, sf))


@query(r"SELECT doc_id, array_to_string(list_transform(string_split(text, ''), lambda c: CASE " + " ".join(f"WHEN c = '{c.replace(chr(39), chr(39) * 2)}' THEN '{t.replace(chr(39), chr(39) * 2)}'" for c, t in ((chr(k), v) for k, v in tex.character_map().items())) + " WHEN unicode(c) <= 255 THEN c ELSE '?' END), '') AS tex FROM documents")
def escape_text(spark, sf):
    return read(spark, sf, "documents").select("doc_id", tex.escape(F.col("text")).alias("tex"))


UNWRAPPED = r"""(SELECT doc_id, string_split_regex(trim(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(text, '\\(?:mathrm|mathbf|text)\s*', ' ', 'g'), '\\quad|\\[,;:]', ' ', 'g'), '~', ' <gap> '), '[{}$]', ' ', 'g'), '\\([A-Za-z]+)', '\1', 'g'), '\\', ' ', 'g')), '\s+') AS w FROM (SELECT doc_id, '\mathrm{a b~c d} ' || regexp_replace(text, '[^A-Za-z0-9 ]', ' ', 'g') AS text FROM documents))"""


@query(f"""SELECT doc_id, coalesce(string_agg(word, ' ' ORDER BY k), '') AS words FROM (SELECT doc_id, min(k) AS k, string_agg(t, '' ORDER BY k) AS word FROM (
SELECT doc_id, k, t, one, CASE WHEN one THEN -sum(CASE WHEN one THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY k) ELSE k END AS g FROM (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS k, length(t) = 1 AS one FROM {UNWRAPPED})) GROUP BY doc_id, one, g) WHERE word NOT IN ('', '<gap>') GROUP BY doc_id""")
def unwrapped_text(spark, sf):
    """Words of formulas that are writing; the texts' own characters are letters, digits and spaces here."""
    latex = F.concat(F.lit("\\mathrm{a b~c d} "), F.regexp_replace("text", "[^A-Za-z0-9 ]", " "))
    return read(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", tex.unwrap(latex).alias("words"))

