"""Page layout from boxes: overlap joins, carving, nomination, reading order, paragraphs and emission.

Boxes are columns l, t, r, b in one coordinate space. Every join has the page
as an equality, so it is dealt by page; pages are small and many.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import tex
from quire.functions.text import heading_level, is_prose, looks_like_equation, looks_like_loop
from quire.operators.metrics import upper_medians

# Thresholds of the page model.
OVERLAP = 0.5
MIN_EQUATION_HEIGHT = 14
CONFIDENCE_FLOOR = 50
HEADING_WORDS = 8
TOO_SHORT, IS_PROSE, READ_AS_TEXT = "too short to be a displayed formula", "the region is prose, not displayed maths", "read as text (min conf "  # fixed values: reasons


def overlap(t1: Column, b1: Column, t2: Column, b2: Column) -> Column:
    """Shared height as a part of the lower of two boxes; 0 where they don't meet or have no height."""
    shared, lower = F.least(b1, b2) - F.greatest(t1, t2), F.least(b1 - t1, b2 - t2)
    return F.when((shared > 0) & (lower > 0), shared / lower).otherwise(0.0)


def covers(left: str, right: str) -> Column:
    """The join condition of two aliased box tables: same page, enough overlap."""
    c = lambda side, name: F.col(f"{side}.{name}")
    return (c(left, "page") == c(right, "page")) & (overlap(c(left, "t"), c(left, "b"), c(right, "t"), c(right, "b")) >= OVERLAP)


def overlapping(lines: DataFrame, boxes: DataFrame) -> DataFrame:
    """(page, line_id, box_id) of lines and boxes that overlap."""
    return lines.alias("x").join(boxes.alias("y"), covers("x", "y")).select(F.col("x.page").alias("page"), F.col("x.id").alias("line_id"), F.col("y.id").alias("box_id"))


def assembled(lines: DataFrame, equations: DataFrame) -> DataFrame:
    """Lines that no equation overlaps, and the equations, with their place in reading order."""
    kept = lines.alias("x").join(equations.alias("y"), covers("x", "y"), "left_anti").select("page", "id", F.lit("text").alias("kind"), "l", "t", "r", "b", "text", (F.col("min_conf") < CONFIDENCE_FLOOR).alias("uncertain"))
    shown = equations.select("page", "id", F.lit("equation").alias("kind"), "l", "t", "r", "b", "text", F.lit(False).alias("uncertain"))
    order = Window.partitionBy("page").orderBy("t", "l", "kind", "id")
    return kept.unionByName(shown).withColumn("ord", F.row_number().over(order))


def paragraphs(items: DataFrame) -> DataFrame:
    """items (page, ord, kind, block, par) with the running number of their paragraph: a new one where block or par of the text before differs, or no text stands before."""
    order = Window.partitionBy("page").orderBy("ord")
    before = F.lag(F.struct("kind", "block", "par")).over(order)
    new = before.isNull() | (before["kind"] != "text") | (F.col("kind") != "text") | (before["block"] != F.col("block")) | (before["par"] != F.col("par"))
    return items.withColumn("_new", new.cast("int")).withColumn("paragraph", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def page_offsets(pages: DataFrame) -> DataFrame:
    """pages (doc, page, height) with the heights of the pages before, summed."""
    before = Window.partitionBy("doc").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    return pages.withColumn("offset", F.coalesce(F.sum("height").over(before), F.lit(0)))


def bands(rows: DataFrame, gap: Column | int) -> DataFrame:
    """Runs of inked rows (page, y) as (page, top, bottom), runs closer than the gap taken together; bottom is exclusive."""
    order = Window.partitionBy("page").orderBy("y")
    islands = rows.withColumn("_g", F.col("y") - F.row_number().over(order)).groupBy("page", "_g").agg(F.min("y").alias("top"), (F.max("y") + 1).alias("bottom"))
    by_top = Window.partitionBy("page").orderBy("top")
    far = F.col("top") - F.lag("bottom").over(by_top) < gap
    joined = islands.withColumn("_new", F.when(far, 0).otherwise(1)).withColumn("_n", F.sum("_new").over(by_top.rowsBetween(Window.unboundedPreceding, 0)))
    return joined.groupBy("page", "_n").agg(F.min("top").alias("top"), F.max("bottom").alias("bottom")).select("page", "top", "bottom")


def carved(top: Column, bottom: Column, spans: Column) -> Column:
    """What is left of [top, bottom) without spans (array of structs t, b), as pieces of the least height; spans may overlap."""
    ordered = F.array_sort(spans)
    start = F.struct(top.cast("bigint").alias("at"), F.array().cast("array<struct<t:bigint,b:bigint>>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        piece = F.struct(acc["at"].alias("t"), F.least(s["t"], bottom).cast("bigint").alias("b"))
        return F.struct(F.greatest(acc["at"], s["b"]).cast("bigint").alias("at"), F.when(s["t"] > acc["at"], F.concat(acc["out"], F.array(piece))).otherwise(acc["out"]).alias("out"))

    def end(acc: Column) -> Column:
        last = F.struct(acc["at"].alias("t"), bottom.cast("bigint").alias("b"))
        return F.filter(F.concat(acc["out"], F.array(last)), lambda p: p["b"] - p["t"] >= MIN_EQUATION_HEIGHT)

    return F.aggregate(ordered, start, step, end)


def is_centred(left: Column, right: Column, width: Column) -> Column:
    """Away from the left margin, with gaps that are nearly equal."""
    return F.coalesce((width > 0) & (left >= width * 0.12) & (F.abs(left - (width - right)) < width * 0.18), F.lit(False))


def nominated(lines: DataFrame, boxes: DataFrame, floor: int = CONFIDENCE_FLOOR) -> DataFrame:
    """(page, box_id, t, b, nominated, reason) of the pieces of every box (page, id, l, t, r, b, width).

    Prose lines are carved out first. What is left is nominated if no text was
    read in it, if some was read badly, or if the text there is centred.
    """
    short = boxes.where(F.col("b") - F.col("t") < MIN_EQUATION_HEIGHT).select("page", F.col("id").alias("box_id"), "t", "b", F.lit(False).alias("nominated"), F.lit(TOO_SHORT).alias("reason"))
    tall = boxes.where(F.col("b") - F.col("t") >= MIN_EQUATION_HEIGHT)
    prose = lines.where(is_prose(F.col("text")))
    spans = F.collect_list(F.when(F.col("x.t").isNotNull(), F.struct(F.col("x.t").cast("bigint").alias("t"), F.col("x.b").cast("bigint").alias("b"))))
    whole = tall.alias("y").join(prose.alias("x"), covers("x", "y"), "left").groupBy("y.page", "y.id", "y.l", "y.t", "y.r", "y.b", "y.width").agg(spans.alias("spans"))
    pieces = whole.withColumn("pieces", F.when(F.size("spans") == 0, F.array(F.struct(F.col("t").cast("bigint").alias("t"), F.col("b").cast("bigint").alias("b")))).otherwise(carved(F.col("t"), F.col("b"), F.col("spans"))))
    gone = pieces.where(F.size("pieces") == 0).select("page", F.col("id").alias("box_id"), "t", "b", F.lit(False).alias("nominated"), F.lit(IS_PROSE).alias("reason"))
    each = pieces.select("page", "id", "width", F.posexplode("pieces").alias("n", "piece")).select("page", "id", "n", "width", "piece.t", "piece.b")
    inside = each.alias("y").join(lines.alias("x"), covers("x", "y"), "left").groupBy("y.page", "y.id", "y.n", "y.t", "y.b", "y.width").agg(F.min("x.min_conf").alias("weakest"), F.min("x.l").alias("left"), F.max("x.r").alias("right"), F.count("x.id").alias("lines"))
    take = (F.col("lines") == 0) | (F.col("weakest") < floor) | is_centred(F.col("left"), F.col("right"), F.col("width"))
    judged = inside.select("page", F.col("id").alias("box_id"), "t", "b", take.alias("nominated"), F.when(~take, F.concat(F.lit(READ_AS_TEXT), F.col("weakest").cast("string"), F.lit(")"))).alias("reason"))
    return functools.reduce(DataFrame.unionByName, [short, gone, judged])


def is_heading(text: Column, height: Column, body_height: Column) -> Column:
    """Few words without closing punctuation, and larger than the body text or numbered."""
    text = F.trim(text)
    few = F.size(F.split(text, r"(?U)\s+")) <= HEADING_WORDS
    return (text != "") & few & ~text.rlike(r"[.,;:]\z") & ((height > body_height * 1.15) | text.rlike(r"(?U)\A\d+(\.\d+)*\s"))


def line_words(words: DataFrame) -> DataFrame:
    """Text lines from words (page, block, par, line, ord, text, conf, l, t, r, b); blank, unread and non-finite words are left out."""
    ok = words.where((F.trim("text") != "") & (F.col("conf") >= 0) & ~F.isnan("conf") & (F.col("conf") < float("inf")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda w: w["text"]), " ")
    return ok.groupBy("page", "block", "par", "line").agg(
        joined.alias("text"), F.min(F.floor("conf")).alias("min_conf"), F.avg("conf").alias("mean_conf"), F.min("l").alias("l"), F.min("t").alias("t"), F.max("r").alias("r"), F.max("b").alias("b")
    )


def covered(boxes: DataFrame, lines: DataFrame) -> DataFrame:
    """The boxes that a line of their page covers to a half at least."""
    return boxes.alias("y").join(lines.alias("x"), covers("x", "y"), "left_semi")


def regions_read(readings: DataFrame, lines: DataFrame) -> DataFrame:
    """readings (page, id, l, t, r, b, latex, complete) of nominated regions with fate and text.

    A formula is `found`, its LaTeX made safe; one without an end or that can't be
    made safe is `dropped`; other writing is `covered` where a line was read there,
    else `salvaged` as words unless these repeat; `none` where nothing was read.
    """
    there = covered(readings.select("page", "id", "t", "b"), lines).select("page", "id").withColumn("_line", F.lit(True))
    rows = readings.join(there, ["page", "id"], "left").withColumns({"_safe": tex.sanitise(F.col("latex")), "_words": tex.unwrap(F.col("latex"))})
    blank = F.coalesce(F.col("latex"), F.lit("")) == ""
    fate = (
        F.when(F.col("complete") == F.lit(False), "dropped").when(blank, "none").when(looks_like_equation(F.col("latex")), F.when(F.col("_safe.ok"), "found").otherwise("dropped"))
        .when(F.col("_line"), "covered").when((F.col("_words") != "") & ~looks_like_loop(F.col("_words")), "salvaged").otherwise("none")
    )
    out = rows.withColumn("fate", fate)
    text = F.when(F.col("fate") == "found", F.col("_safe.latex")).when(F.col("fate") == "salvaged", F.col("_words"))
    return out.select(*readings.columns, "fate", text.alias("read"))


def emitted(items: DataFrame, escape) -> DataFrame:  # noqa: ANN001
    """(doc, tex): whole documents from items (doc, page, ord, kind, text, t, b, block, par) in order; escape is a column function."""
    heights = upper_medians(items.where(F.col("kind") == "text").select("doc", (F.col("b") - F.col("t")).alias("height")), "doc", "height").withColumnRenamed("median", "body_height")
    order = Window.partitionBy("doc").orderBy("page", "ord")
    up_to = order.rowsBetween(Window.unboundedPreceding, 0)
    all_ = items.join(heights, "doc", "left").withColumn("head", (F.col("kind") == "text") & is_heading(F.col("text"), F.col("b") - F.col("t"), F.coalesce("body_height", F.lit(0))))
    kind = F.when(F.col("kind") == "equation", "equation").when(F.col("head"), "heading").otherwise("text")
    before = F.lag(F.struct("kind", "block", "par", "page", "shown")).over(order)
    # A paragraph goes on only straight after running text; a heading ends it, though headings count as text for what follows.
    new = before.isNull() | (before["shown"] != "text") | (F.col("shown") != "text") | (before["page"] != F.col("page")) | (before["block"] != F.col("block")) | (before["par"] != F.col("par"))
    rows = all_.withColumn("shown", kind).withColumns({"_new": new.cast("int"), "seam": F.coalesce(before["page"] != F.col("page"), F.lit(False))}).withColumn("piece", F.sum("_new").over(up_to))
    bare = F.trim(F.regexp_replace(F.trim("text"), r"(?U)\A\d+(\.\d+)*\s", ""))
    part = (
        F.when(F.col("shown") == "equation", F.concat(F.lit("\\[\n"), "text", F.lit("\n\\]")))
        .when(F.col("shown") == "heading", F.concat(F.lit("\\"), heading_level(F.col("text")), F.lit("{"), escape(F.when(bare == "", F.trim("text")).otherwise(bare)), F.lit("}")))
        .otherwise(escape(F.col("text")))
    )
    pieces = rows.withColumn("part", part).groupBy("doc", "piece").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "ord", "part"))), lambda x: x["part"]), " ").alias("part"), F.max("seam").alias("seam"), F.max(F.col("kind") == "equation").alias("math"))
    text = F.concat(F.when(F.col("seam"), "\\clearpage\n\n").otherwise(""), "part")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", text.alias("x")))), lambda x: x["x"]), "\n\n")
    packages = F.concat(F.lit("\\usepackage[utf8]{inputenc}\n\\usepackage[T1]{fontenc}"), F.when(F.max("math"), "\n\\usepackage{amsmath}").otherwise(""))
    return pieces.groupBy("doc").agg(F.concat(F.lit("\\documentclass{article}\n"), packages, F.lit("\n\\begin{document}\n\n"), F.trim(body), F.lit("\n\n\\end{document}\n")).alias("tex"))
