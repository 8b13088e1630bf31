"""The conversion chain: attempts in order, retries, the first failing page, what local readers leave, and the summary of a document."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_STEPS = 10  # fixed value: attempts at one page


def page_outcomes(attempts: DataFrame) -> DataFrame:
    """(doc, page, ok, steps, retries, model) of each page from attempts (doc, page, step, outcome, model).

    A page's attempts end with the first ok or fatal one, or after MOST_STEPS.
    """
    first = attempts.where(F.col("step") <= MOST_STEPS).groupBy("doc", "page").agg(
        F.min_by(F.struct("step", "outcome", "model"), F.when(F.col("outcome").isin("ok", "fatal"), F.col("step"))).alias("end"), F.max("step").alias("last")
    )
    steps = F.coalesce("end.step", "last")
    return first.select("doc", "page", F.coalesce(F.col("end.outcome") == "ok", F.lit(False)).alias("ok"), steps.cast("bigint").alias("steps"), (steps - 1).cast("bigint").alias("retries"), F.when(F.col("end.outcome") == "ok", F.col("end.model")).alias("model"))


def conversion_path(pages: DataFrame) -> DataFrame:
    """(doc, pages, ai_pages, fallback_pages, path): pages up to the first failing one are the service's, the rest the local readers'."""
    bad = F.min(F.when(~F.col("ok"), F.col("page")))
    by = pages.groupBy("doc").agg(F.count("*").alias("pages"), bad.alias("bad"))
    both = pages.join(by, "doc").groupBy("doc").agg(F.first("pages").alias("pages"), F.count(F.when(F.col("bad").isNull() | (F.col("page") < F.col("bad")), 1)).alias("ai_pages"))
    rest = F.col("pages") - F.col("ai_pages")
    return both.select("doc", "pages", "ai_pages", rest.alias("fallback_pages"), F.when(rest == 0, "ai").when(F.col("ai_pages") == 0, "converters").otherwise("mixed").alias("path"))


# What is said where no answer says it.
NO_QUOTA = "Every AI model has reached its quota."
NOT_SENT = "The page could not be sent to the AI conversion service."
UNAVAILABLE = "The AI conversion service is temporarily unavailable."
UNREADABLE = "Page {} could not be read and was skipped."
SALVAGED, REJECTED = "{} line(s) could not be read by the text engine and were recovered approximately.", "{} recognised expression(s) were rejected as unusable and left out."


@dataclass
class Round:
    """The models' round of one document. It only moves on."""

    attempt: int = 0
    exhausted: bool = False
    said: str = ""
    failed: bool = False


@dataclass
class Page:
    number: int
    ok: bool = False
    over: bool = False  # nothing more is asked
    thinking: bool = True
    resent: bool = False
    steps: int = 0
    said: str = ""


def answer(turn: Round, page: Page, a: dict) -> None:
    """What one answer in the log does to its page and to the document's round."""
    if page.over or turn.failed:
        return
    if a["speculative"]:  # asked for on the side: only success counts
        page.ok = page.over = a["ok"]
        return
    if turn.exhausted:
        page.over, page.said = True, turn.said
        return
    page.steps += 1
    if a["ok"] or not a["retryable"]:
        page.ok, page.over, page.said = a["ok"], True, "" if a["ok"] else a["error"]
    elif a["next_attempt"] is None:
        turn.exhausted, turn.said = True, a["error"] or NO_QUOTA
        page.over, page.said = True, turn.said
    elif a["same_model"]:
        page.over, page.said = page.resent, (a["error"] or NOT_SENT) if page.resent else ""
        page.resent = True
    elif a["without_thinking"]:
        page.thinking = False
    else:
        page.thinking = True
        turn.attempt = max(turn.attempt, a["next_attempt"])
    if page.steps == MOST_STEPS and not page.over:
        page.over, page.said = True, UNAVAILABLE


ROUNDS = "doc bigint, page bigint, ok boolean, steps int, attempt int, thinking boolean, resent boolean, exhausted boolean, error string"


def rounds(answers: DataFrame) -> DataFrame:
    """ROUNDS of each page that is tried, from answers (doc, page, step, speculative, ok, retryable, next_attempt, same_model, without_thinking, error).

    A document's pages share a round: an answer that names a next attempt moves it
    on, one that names none ends it, and the first page that fails ends the
    document. Answers are folded in order of page and step as they stream by.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, turn, page, out = None, Round(), None, []

        def close() -> None:
            if page is None or turn.failed:
                return
            if not page.over:
                page.over, page.said = True, turn.said if turn.exhausted else UNAVAILABLE
            out.append((doc, page.number, page.ok, page.steps, turn.attempt, page.thinking, page.resent, turn.exhausted, page.said))
            turn.failed = not page.ok

        def batch() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.bool_(), pa.string()]
            got = pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)], names=[x.split()[0] for x in ROUNDS.split(", ")])
            out.clear()
            return got

        for b in batches:
            for a in b.to_pylist():
                if page is None or (a["doc"], a["page"]) != (doc, page.number):
                    close()
                    turn = turn if a["doc"] == doc else Round()
                    doc, page = a["doc"], Page(a["page"])
                answer(turn, page, a)
            yield batch()
        close()
        yield batch()

    return answers.repartition("doc").sortWithinPartitions("doc", "page", "step").mapInArrow(fold, ROUNDS)


def local_pages(pages: DataFrame, first: int = 1) -> DataFrame:
    """(doc, unit, page, number, offset, notes) of pages (doc, unit, page, read, height, notes) that local readers were given.

    A unit that can't be opened is one row with a null page. Every row has a number
    of its own; one that wasn't read leaves a note and no height, and the rest of
    the document goes on.
    """
    order = Window.partitionBy("doc").orderBy("unit", F.col("page").asc_nulls_first())
    read = F.coalesce(F.col("read"), F.lit(False)) & F.col("page").isNotNull()
    number = F.row_number().over(order) + (first - 1)
    before = F.sum(F.when(read, F.col("height")).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, -1))
    said = F.when(read, F.transform(F.coalesce("notes", F.array().cast("array<string>")), lambda n: F.concat(F.lit("Page "), F.col("number").cast("string"), F.lit(": "), n)))
    skipped = F.array(F.concat(*(F.lit(x) for x in UNREADABLE.split("{}")[:1]), F.col("number").cast("string"), F.lit(UNREADABLE.split("{}")[1])))
    return pages.withColumns({"number": number, "offset": F.coalesce(before, F.lit(0)).cast("bigint")}).select("doc", "unit", "page", "number", "offset", F.coalesce(said, skipped).alias("notes"))


def equation_indices(equations: DataFrame, offset: Column | int = 0) -> DataFrame:
    """equations (doc, number, place) with index, which counts on over a document's pages from an offset."""
    order = Window.partitionBy("doc").orderBy("number", "place")
    return equations.withColumn("index", F.row_number().over(order) + (F.lit(offset) if isinstance(offset, int) else offset))


def described(pages: DataFrame, items: DataFrame) -> DataFrame:
    """conversion_path() of pages with textBlocks, equations and uncertainLines of each document's items (doc, kind, text, uncertain)."""
    text = F.col("kind") == "text"
    unsure = text & F.coalesce(F.col("uncertain"), F.lit(False)) & (F.trim(F.coalesce("text", F.lit(""))) != "")
    counts = items.groupBy("doc").agg(F.count_if(text).alias("textBlocks"), F.count_if(F.col("kind") == "equation").alias("equations"), F.count_if(unsure).alias("uncertainLines"))
    out = conversion_path(pages).join(counts, "doc", "left")
    return out.select("doc", "pages", "ai_pages", "fallback_pages", "path", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("textBlocks", "equations", "uncertainLines")))
