"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import drop_tables, table


def small_star(edges: DataFrame) -> DataFrame:
    """Every vertex and its smaller neighbours are tied to the smallest of them. edges: a > b."""
    low = edges.groupBy("a").agg(F.min("b").alias("m"))
    rest = edges.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.unionByName(low.select("a", F.col("m").alias("b"))).distinct()


def large_star(edges: DataFrame) -> DataFrame:
    """Every vertex's larger neighbours are tied to the smallest of it and its neighbours. Edges may come out several times."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def components(spark: SparkSession, edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(id, component) of every vertex that isn't the smallest of its component; component is that smallest id.

    edges has two bigint columns a and b; loops and repeats do no harm. Hubs are
    never gathered: the smallest neighbour is a partial aggregate, and the join
    behind it is one that can split a hub's edges. A count and a checksum of the
    edges are observed as they are written; nothing else reaches the driver.

    With `rounds`, no more than so many are made, and a vertex gets the smallest
    of its neighbours by then: vertices of one component may still differ,
    those of two components always do.
    """
    a, b = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")

    def written(df: DataFrame) -> tuple[DataFrame, tuple]:
        seen = Observation()
        out = table(spark, df.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("sum")), "edges")
        return out, (seen.get["n"], seen.get["sum"])

    now, mark = written(edges.where("a <> b").select(a, b).distinct())
    made = 0
    while mark[0] and made != rounds:
        new, after = written(small_star(large_star(now)))
        drop_tables(spark, now)
        now, made, same, mark = new, made + 1, after == mark, after
        if same:
            break
    if rounds is not None:
        return now.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "id")
    return now.select(F.col("a").alias("id"), F.col("b").alias("component"))
