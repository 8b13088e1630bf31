"""Shared pieces: byte-level tokenising of Arrow text columns, tables in the shared folder, dense numbering."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CHUNK_BYTES = 1 << 18  # of text that is worked on at a time; a longer text is a chunk of its own
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


# --- the shared folder -------------------------------------------------------


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share. Only a local session without one, as in tests, gets a temporary folder; on a cluster its lack is an error."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir isn't set: it must name a folder that driver and executors share")
    own = tempfile.mkdtemp(prefix="quire-")
    atexit.register(shutil.rmtree, own, True)
    sc.setCheckpointDir(f"file://{own}")
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def table(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: cuts the lineage, and lost executors lose nothing of it."""
    path = f"{shared_dir(spark)}/quire/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def bucketed(spark: SparkSession, df: DataFrame, name: str, key: str, n: int) -> Iterator[DataFrame]:
    """df, which is dealt by key to n partitions, as a table on which joins by key don't shuffle it again; it lasts as long as the block."""
    made = f"quire_{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/quire/{made}"
    df.write.option("compression", "zstd").option("path", path).bucketBy(n, key).sortBy(key).saveAsTable(made)
    try:
        yield spark.table(made)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {made}")
        delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop_tables(spark: SparkSession, *tables: DataFrame) -> None:
    """Removes the files of tables that nothing will read again; what was made of them has been written itself."""
    for path in {x.rpartition("/")[0] for df in tables for x in df.inputFiles()}:
        delete(spark, path)


# --- rows --------------------------------------------------------------------


def boxed(df: DataFrame) -> DataFrame:
    """df as one column `doc`, a struct of all its columns: whatever they are called, they clash with no column that an operator adds."""
    return df.select(F.struct("*").alias("doc"))


def unboxed(df: DataFrame) -> DataFrame:
    """The columns of boxed() again, as they were."""
    return df.select("doc.*")


def column_of(df: DataFrame, name: str) -> Column:
    return F.col(f"`{name.replace('`', '``')}`")


def part(b: pa.RecordBatch, place: int) -> pa.Array:
    """A column of the struct that leads a batch of boxed rows."""
    return b.column(0).field(place)


def schema_with(df: DataFrame, more: str) -> StructType:
    """The columns of df and those of a DDL string. A schema, not a DDL string: names need no quotes there."""
    return StructType([*df.schema.fields, *StructType.fromDDL(more).fields])


def crc_mod(col: Column, n: int) -> Column:
    """crc32 of the value as text, modulo n. null counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit(""))), F.lit(n))


def per_batch(f: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield f(b)

    return run


def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """(partition, rows of it before this batch, batch)."""
    from pyspark import TaskContext

    pid, seen = TaskContext.get().partitionId(), 0
    for b in batches:
        yield pid, seen, b
        seen += b.num_rows


# --- text --------------------------------------------------------------------


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts one after another, and the n + 1 offsets. null has no bytes."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.fill_null("") if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else col.fill_null(b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def chunks(off: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes, or of one row."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, j
        i = j


def byte_class(in_word: Callable[[int], bool]) -> np.ndarray:
    return np.array([in_word(b) for b in range(256)], bool)


def word_spans(buf: np.ndarray, off: np.ndarray, in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of word bytes, none across texts, and how many each text has (as n + 1 offsets)."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    m = in_word[buf]
    first, last = m.copy(), m.copy()
    first[1:] &= ~m[:-1]
    last[:-1] &= ~m[1:]
    full = off[1:] > off[:-1]
    a, b = off[:-1][full], off[1:][full] - 1
    first[a], last[b] = m[a], m[b]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, off)


def lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


class SpanHasher:
    """64-bit hashes of byte spans from one running sum: a random value for each byte times powers of an odd base."""

    def __init__(self, seed: int = 7, lower: bool = True) -> None:
        rng = np.random.default_rng(seed)
        t = rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.value = t[lower_table()] if lower else t
        self.base = np.uint64(int(rng.integers(1, 2**61)) * 4 + 1 | 0x10)
        self.base = np.uint64(int(self.base) | 1)
        self.inverse = np.uint64(pow(int(self.base), -1, 2**64))
        self.up = self.down = np.ones(1, np.uint64)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) > n:
            return self.up, self.down
        up, down = np.full(n + 1, self.base), np.full(n + 1, self.inverse)
        up[0] = down[0] = 1
        up, down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        if n <= 4 * CHUNK_BYTES:  # what one very long text needs isn't kept
            self.up, self.down = up, down
        return up, down

    def __call__(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        up, down = self.powers(len(buf))
        run = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(self.value[buf] * up[: len(buf)], out=run[1:])
        return mixed((run[end] - run[start]) * down[start])


def prepare(spark: SparkSession) -> None:
    """Arrow batches of a few MB, however long the texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def unit_interval(col: Column, seed: int) -> Column:
    """A uniform number inside (0, 1), by the first 52 bits of the MD5 of seed and value, which any system can compute; null is a value like any other."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(col.cast("string"), F.lit("\0null")))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def dense_index(spark: SparkSession, df: DataFrame, name: str, index: str = "_index") -> DataFrame:
    """df, written to the shared folder, with a gapless number from 0 in the order of its partitions and their rows.

    Each partition numbers its own rows; only the partitions' counts are summed.
    """
    names = df.columns

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pid, seen, b in numbered(batches):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, pid, np.int32)), pa.array(np.arange(seen, seen + b.num_rows, dtype=np.int64))], names=[*names, "_part", "_local"])

    return add_bases(table(spark, df.mapInArrow(number, schema_with(df, "_part int, _local bigint")), name), index)


def add_bases(placed: DataFrame, index: str) -> DataFrame:
    """Turns _part and _local of a table() into one gapless number.

    What is broadcast is a row of 16 bytes for each task that wrote the table; Spark's driver held each of those tasks, at many times that size.
    """
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = placed.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return placed.join(F.broadcast(base), "_part").withColumn(index, F.col("_base") + F.col("_local")).drop("_part", "_local", "_base")
