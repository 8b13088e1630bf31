"""Averages of a recognition benchmark."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import normalised


def scored(pairs: DataFrame) -> DataFrame:
    """pairs (cond, truth, guess) with normalised texts, edits and characters."""
    t, g = normalised(F.col("truth")), normalised(F.col("guess"))
    return pairs.withColumns({"t": t, "g": g}).withColumns({"edits": F.levenshtein("t", "g"), "chars": F.length("t"), "exact": (F.col("t") == F.col("g")).cast("int")})


def micro(rows: DataFrame) -> DataFrame:
    """Of each condition, and of all (cond null): accuracy over all characters, and the share of exact matches."""
    accuracy = F.greatest(F.lit(0.0), 1 - F.sum("edits") / F.nullif(F.sum("chars"), F.lit(0)))
    return rows.rollup("cond").agg(F.count("*").alias("n"), F.sum("exact").alias("exact"), F.round(accuracy, 6).alias("accuracy"), F.round(F.avg("exact"), 6).alias("exact_rate"))


def macro(ours: Column, theirs: Column) -> Column:
    """Mean over rows where both sides have a score; 0 without any."""
    return F.coalesce(F.avg(F.when(ours.isNotNull() & theirs.isNotNull(), ours)), F.lit(0.0))


def spread(rows: DataFrame, group: str, value: str, accuracy: int = 10_000) -> DataFrame:
    """Least, upper median and greatest value of each group, exactly.

    A quantile sketch of this accuracy first says between which two values the
    median lies: they are 4 / accuracy of a group's rows apart in rank. Only the
    values between them are counted one by one and ordered.
    """
    edge = 2 / accuracy
    known = rows.where(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).alias("v"))
    bounds = known.groupBy("g").agg(F.min("v").alias("least"), F.max("v").alias("most"), F.count("*").alias("n"), F.approx_percentile("v", [0.5 - edge, 0.5 + edge], accuracy).alias("q"))
    near = known.alias("x").join(bounds.alias("y"), F.col("x.g").eqNullSafe(F.col("y.g")) & (F.col("v") <= F.col("q")[1])).select("y.g", "n", F.when(F.col("v") >= F.col("q")[0], F.col("v")).alias("v"))
    counts = near.groupBy("g", "v").agg(F.count("*").alias("c"), F.first("n").alias("n"))  # all that is below is one row
    upto = F.sum("c").over(Window.partitionBy("g").orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    middle = counts.withColumn("upto", upto).where(F.col("upto") > F.floor(F.col("n") / 2)).groupBy("g").agg(F.min("v").alias("median"))
    out = bounds.alias("a").join(middle.alias("b"), F.col("a.g").eqNullSafe(F.col("b.g")))
    return out.select(F.col("a.g").alias(group), "least", "median", "most")


def upper_medians(rows: DataFrame, group: str, value: str) -> DataFrame:
    return spread(rows, group, value).select(group, "median")


def against_golden(docs: DataFrame, golden: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, present, same) of each document: whether it has a golden row, and whether all fields agree with it; a missing one is a failure."""
    have = golden.select(F.col(key).alias("_key"), *(F.col(f).alias(f"_{f}") for f in fields))
    agree = functools.reduce(Column.__and__, [F.col(f).eqNullSafe(F.col(f"_{f}")) for f in fields])
    there = F.col("_key").isNotNull()
    return docs.join(have, F.col(key) == F.col("_key"), "left").select(key, there.alias("present"), (there & agree).alias("same"))


def mismatches(rows: DataFrame, most: int = 6) -> DataFrame:
    """The first rows of scored() that aren't exact, for the report."""
    return rows.where("exact = 0").orderBy("item_id").limit(most).select("item_id", "cond", "t", "g")
