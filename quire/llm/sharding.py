"""Sharding by jump consistent hashing.

A row's shard depends on its key and on the number of shards alone: no ring
table, and one more shard takes rows only into itself, 1/n of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import numbered, schema_with, table

STEP = np.uint64(2862933555777941757)  # fixed value: multiplier of the published generator


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shards of 64-bit keys. Each round moves the keys whose next jump lands inside; about ln(shards) rounds."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    state, at = keys.astype(np.uint64), np.zeros(len(keys), np.int64)
    live = np.arange(len(keys))
    while len(live):
        s = state[live] * STEP + np.uint64(1)
        state[live] = s
        to = ((at[live] + 1) * (float(1 << 31) / ((s >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
        inside = to < shards
        live = live[inside]
        at[live] = to[inside]
    return at.astype(np.int32)


def shard_key(col: Column) -> Column:
    """A stable key of any column: the first 60 bits of the MD5 of its text, which any system can compute; null is a key like any other."""
    digits = F.substring(F.md5(F.coalesce(col.cast("string"), F.lit("\0null")).cast("binary")), 1, 15)
    return F.conv(digits, 16, 10).cast("bigint")


def assign_shards(spark: SparkSession, df: DataFrame, key: Column, shards: int, grown: int | None = None) -> DataFrame:
    """(doc, shard, slot, grown_shard) for each row: doc is the row as a struct, so its names clash with none; slot is gapless
    from 0 within a shard; grown_shard is the shard of `grown`, by default one more.

    Slots are counted where the rows lie: each input partition numbers its own
    rows of a shard, and only the counts of partitions and shards are summed
    across the cluster. No row is sorted and none but the result is shuffled,
    so a key that holds a third of all rows costs no more than any other.
    Null keys share one shard; repeated rows get slots of their own; long values
    are carried as they are; an empty table gives an empty result.
    """
    grown = grown or shards + 1
    keyed = df.select(F.struct("*").alias("doc"), shard_key(key).alias("key"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(shards, np.int64)
        for pid, _, b in numbered(batches):
            keys = b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            shard = jump_hash(keys, shards)
            order = np.argsort(shard, kind="stable")
            n = np.bincount(shard, minlength=shards)
            local = np.empty(len(shard), np.int64)
            local[order] = np.arange(len(shard)) - np.repeat(np.cumsum(n) - n, n)
            local += count[shard]
            count += n
            cols = [b.column(0), pa.array(shard), pa.array(jump_hash(keys, grown)), pa.array(np.full(len(shard), pid, np.int32)), pa.array(local)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc", "shard", "grown_shard", "part", "local"])

    placed = table(spark, keyed.mapInArrow(place, schema_with(keyed.select("doc"), "shard int, grown_shard int, part int, local bigint")), "shards")
    # A row for each input partition and shard; the running sum is over partitions, not rows.
    n = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = n.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return placed.join(base, ["shard", "part"]).select("doc", "shard", (F.col("base") + F.col("local")).alias("slot"), "grown_shard")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of 24 by doc_id, and of 25."""
    text = F.col("text")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"), F.lit("key").alias("law")
    )
    return assign_shards(spark, docs, F.col("doc_id"), 24).select("doc.*", "shard", "slot", "grown_shard")


# A CRC-32 of bytes as a fold over a table of 256 values; jump hashing as a recursion over exact 128-bit products.
OP8_SQL = """
WITH RECURSIVE tab AS (SELECT list(v ORDER BY n) AS tab FROM (SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) t(n))),
d AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0) + 8 AS size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS bytes FROM documents),
c AS (SELECT doc_id, size, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) AS crc FROM d, tab),
j AS (
  SELECT doc_id, n, CAST(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS HUGEINT) AS state, CAST(-1 AS BIGINT) AS here, CAST(0 AS BIGINT) AS nxt FROM documents, (VALUES (24), (25)) t(n)
  UNION ALL
  SELECT doc_id, n, s, nxt, CAST(floor((nxt + 1) * (CAST(2147483648 AS DOUBLE) / (CAST(s // 8589934592 AS DOUBLE) + 1))) AS BIGINT) FROM (SELECT *, (state * 2862933555777941757 + 1) % CAST(18446744073709551616 AS HUGEINT) AS s FROM j WHERE nxt < n)
), p AS (SELECT doc_id, CAST(max(here) FILTER (n = 24) AS INT) AS shard, CAST(max(here) FILTER (n = 25) AS INT) AS grown_shard FROM j GROUP BY doc_id)
SELECT doc_id, size, crc AS text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, grown_shard FROM c JOIN p USING (doc_id)
"""
