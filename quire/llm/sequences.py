"""Token sequences in training order.

Texts become token ids, an end mark after each, and each input partition packs
its texts into sequences of one fixed length. A keyed Feistel permutation of
the sequence numbers gives every sequence a slot; values outside the range walk
their cycle back into it. Shard k holds the slots from k * per_shard on, in
order, at a fixed stride: any slot is one seek away, and a reader resumes from
a slot number alone.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import add_bases, chunks, mixed, prepare, schema_with, table, text_bytes

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed value: the vocabulary's
END = 50256
LENGTH = 1024
PER_SHARD = 4096
KEY = 20240229
ROUNDS = 6


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """The slots of sequence numbers below n: a bijection of 0 .. n - 1 that depends on key and n."""
    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    rounds = mixed(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key))

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for r in rounds:
            left, right = right, left ^ (mixed(right ^ r) & mask)
        return left << np.uint64(half) | right

    out = once(index.astype(np.uint64))
    while len(walk := np.flatnonzero(out >= n)):  # under 4 * n values, so a few steps on average
        out[walk] = once(out[walk])
    return out.astype(np.int64)


def encoder(ranks: list[tuple[bytes, int]], pattern: str) -> Callable[[list[str]], list[list[int]]]:
    import tiktoken

    e = tiktoken.Encoding("quire", pat_str=pattern, mergeable_ranks=dict(ranks), special_tokens={})
    return lambda texts: [e.encode_ordinary(t) for t in texts]


def read_ranks(spark: SparkSession, path: str) -> list[tuple[bytes, int]]:
    """The vocabulary, read by the driver and shipped to the workers: its size is fixed."""
    with open(path, "rb") as f:
        return [(base64.b64decode(a), int(b)) for a, b in map(bytes.split, f)]


SEQUENCE = "_part int, _local bigint, n_tokens int, docs array<struct<doc_id:bigint,doc_token:bigint,at:int,n:int>>, tokens binary"


def pack(spark: SparkSession, docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN, end: int = END, length: int = LENGTH) -> DataFrame:
    """Writes (number, n_tokens, docs, tokens) for every sequence: tokens are little-endian 16-bit ids, end marks as padding.

    docs says which tokens of which documents a sequence holds, and where.
    Null and empty texts are an end mark alone. Only the last sequence of an
    input partition is padded.
    """
    prepare(spark)
    ranks = spark.sparkContext.broadcast(read_ranks(spark, vocabulary))
    kinds = pa.list_(pa.struct([("doc_id", pa.int64()), ("doc_token", pa.int64()), ("at", pa.int32()), ("n", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid, made, encode = TaskContext.get().partitionId(), 0, encoder(ranks.value, pattern)
        held, spans, have = [], [], 0  # of the sequence that isn't full yet

        def batch(rows: list) -> pa.RecordBatch:
            nonlocal made
            cols = [pa.array([pid] * len(rows), pa.int32()), pa.array(range(made, made + len(rows)), pa.int64()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], kinds), pa.array([r[2] for r in rows], pa.binary())]
            made += len(rows)
            return pa.RecordBatch.from_arrays(cols, names=["_part", "_local", "n_tokens", "docs", "tokens"])

        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1)
            _, off = text_bytes(texts)
            for i, j in chunks(off):
                rows = []
                for doc, ts in zip(ids[i:j], encode([t or "" for t in texts.slice(i, j - i).to_pylist()]), strict=True):
                    t = np.array([*ts, end], np.uint16)
                    at = 0
                    while at < len(t):
                        n = min(length - have, len(t) - at)
                        held.append(t[at : at + n])
                        spans.append((doc, at, have, n))
                        have, at = have + n, at + n
                        if have == length:
                            rows.append((have, spans, np.concatenate(held).astype("<u2").tobytes()))
                            held, spans, have = [], [], 0
                if rows:
                    yield batch(rows)
        if have:
            yield batch([(have, spans, np.concatenate([*held, np.full(length - have, end, np.uint16)]).astype("<u2").tobytes())])

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SEQUENCE)
    return table(spark, rows, "sequences")


def training_order(spark: SparkSession, packed: DataFrame, key: int = KEY, per_shard: int = PER_SHARD, length: int = LENGTH, tasks: int | None = None) -> DataFrame:
    """Rows of pack() in slots: partitions are ranges of shards in order of slot; offset is the byte at which a slot begins in its shard.

    A partition has one or more whole shards; `tasks`, by default the session's
    shuffle partitions, bounds how many partitions there are, however many shards.
    """
    total = packed.count()
    shards = max(1, -(-total // per_shard))
    tasks = min(shards, tasks or int(spark.conf.get("spark.sql.shuffle.partitions")))
    numbered_ = add_bases(packed, "number").select("number", "n_tokens", "docs", "tokens")
    names = [*numbered_.columns, "slot"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(permuted(b.column(0).to_numpy(), total, key))], names=names)

    slotted = numbered_.mapInArrow(place, schema_with(numbered_, "slot bigint"))
    shard = F.floor(F.col("slot") / per_shard)
    # Slots are a permutation of 0 .. total - 1, so every shard but the last has per_shard rows, and the tasks' shares differ by one shard at most.
    dealt = slotted.withColumn("shard", shard).repartitionById(tasks, F.floor(F.col("shard") * tasks / shards).cast("int")).sortWithinPartitions("slot")
    return dealt.select("slot", "shard", ((F.col("slot") - F.col("shard") * F.lit(per_shard)) * (2 * length)).alias("offset"), "number", "n_tokens", "docs", F.crc32("tokens").alias("tokens_crc32"), "tokens")


def write_shards(spark: SparkSession, ordered: DataFrame, folder: str) -> DataFrame:
    """Writes shard-00000.bin, ... to a folder (a URI that pyarrow can open) and gives (shard, first_slot, sequences, bytes).

    A shard is written under a name of its own attempt and then moved, so a task that is run again, or twice, leaves one whole file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        attempt, out, now, done = TaskContext.get().taskAttemptId(), None, None, []

        def close() -> None:
            out.close()
            store.move(f"{root}/.shard-{now[0]:05d}.{attempt}", f"{root}/shard-{now[0]:05d}.bin")
            done.append(tuple(now))

        for b in batches:
            for slot, shard, tokens in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if now is None or now[0] != shard:
                    if now:
                        close()
                    now, out = [shard, slot, 0, 0], store.open_output_stream(f"{root}/.shard-{shard:05d}.{attempt}")
                out.write(tokens)
                now[2], now[3] = now[2] + 1, now[3] + len(tokens)
        if now:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], pa.int64()) for k in range(4)], names=["shard", "first_slot", "sequences", "bytes"])

    return table(spark, ordered.select("slot", "shard", "tokens").mapInArrow(run, "shard bigint, first_slot bigint, sequences bigint, bytes bigint"), "shards")


def read_slots(folder: str, slot: int, n: int, per_shard: int = PER_SHARD, length: int = LENGTH) -> Iterator[np.ndarray]:
    """The sequences of n slots from one on: a reader that stopped goes on with the slot it had reached."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    while n > 0:
        path = f"{root}/shard-{slot // per_shard:05d}.bin"
        if store.get_file_info(path).type == fs.FileType.NotFound:
            return
        with store.open_input_file(path) as f:
            f.seek(slot % per_shard * 2 * length)
            got = f.read(2 * length * min(n, per_shard - slot % per_shard))
        if not got:
            return
        for k in range(len(got) // (2 * length)):
            yield np.frombuffer(got, "<u2", length, 2 * length * k)
        slot, n = slot + len(got) // (2 * length), n - len(got) // (2 * length)


def op9_token_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token sequences in training order."""
    return token_sequences(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


def token_sequences(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return training_order(spark, pack(spark, docs))
