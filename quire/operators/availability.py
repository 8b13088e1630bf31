"""Which models can be used: outage records with an end, and what a provider's answer does to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import model_is_gone

# Seconds that a model is set aside.
ASSUMED_OUTAGE, RETIRED = 900, 86_400


def latest_outages(log: DataFrame) -> DataFrame:
    """(model, until, status) after a log of (model, at, event_id, ok, status, retry_after, gone): the last entry wins, success clears.

    A model that is gone is set aside for a day, another one as long as the
    provider asks, or 900 seconds. Without a column gone none is.
    """
    log = log if "gone" in log.columns else log.withColumn("gone", F.lit(False))
    last = log.groupBy("model").agg(F.max_by(F.struct("ok", "at", "status", "retry_after", "gone"), F.struct("at", "event_id")).alias("last"))
    wait = F.when(F.col("last.gone"), RETIRED).when(F.col("last.retry_after") > 0, F.col("last.retry_after")).otherwise(ASSUMED_OUTAGE)
    return last.where(~F.col("last.ok")).select("model", (F.col("last.at") + wait).alias("until"), F.col("last.status").alias("status"))


def at_time(rows: DataFrame, now: int | DataFrame) -> DataFrame:
    """rows with _now, a number or the value of a table of one row and one column; the table is joined, not read while the plan is made."""
    if isinstance(now, DataFrame):
        return rows.join(F.broadcast(now.toDF("_now")), F.lit(True))  # one row
    return rows.withColumn("_now", F.lit(now))


def available(chain: DataFrame, outages: DataFrame, now: int | DataFrame) -> DataFrame:
    """Models of chain (model, ord) that have no record, or one that has ended (the end itself included)."""
    return chain.join(at_time(outages, now).where(F.col("until") > F.col("_now")).select("model"), "model", "left_anti")


def status(chain: DataFrame, outages: DataFrame, now: int | DataFrame) -> DataFrame:
    """One row: whether any model is usable, the first, how many, and else the soonest end (null if unknown)."""
    rows = at_time(chain.join(outages, "model", "left"), now).withColumn("usable", F.col("until").isNull() | (F.col("until") <= F.col("_now")))
    usable = F.count(F.when(F.col("usable"), 1))
    return rows.agg(
        (usable > 0).alias("available"), F.min_by("model", F.when(F.col("usable"), F.col("ord"))).alias("model"), usable.alias("remaining"),
        F.when(usable == 0, F.nullif(F.min(F.coalesce("until", F.lit(0))), F.lit(0))).alias("retry_at"),
    )


def outcome(code: Column, text: Column, thinking: Column) -> Column:
    """What an answer leads to, in this order: ok, park, retire, retry_plain, fatal."""
    return (
        F.when(code.between(200, 299), "ok").when((code == 429) | (code >= 500), "park").when(model_is_gone(code, text), "retire")
        .when((code == 400) & F.coalesce(text.rlike("(?i)thinking"), F.lit(False)) & thinking, "retry_plain").otherwise("fatal")
    )
