"""Benchmark decontamination with a distributed positional inverted index.

The training texts are cut into segments of a few MB. Each segment has its own
inverted index: its terms in order, and for each term the ascending positions
of its occurrences. The index is a table; a phrase is looked up in every
segment at once. Within a segment the positions of a phrase's rarest term,
moved back by its offset, are the candidates; each further term, from rare to
frequent, keeps those at whose place it occurs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import SpanHasher, byte_class, chunks, column_of, drop_tables, mixed, numbered, prepare, table, text_bytes, unboxed, word_spans

WINDOW = 10
SEGMENT_BYTES = 4 << 20
QUERY_BYTES = 16 << 20  # of phrase texts in a block
SLICE = 1 << 14  # windows that are looked up at once
GAP = 1 << 10  # positions between two texts of a segment, more than any window or proximity

WORD = byte_class(lambda b: not (b <= 0x2F or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F) or 0x41 <= b <= 0x5A)

SEGMENT = "rows array<bigint>, words array<bigint>, terms binary, counts binary, steps binary, base bigint"


def hashed_words(buf: np.ndarray, off: np.ndarray, hasher: SpanHasher) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z lower-cased), and how many come before each text."""
    start = [np.zeros(0, np.uint64)]
    per = [np.zeros(1, np.int64)]
    for i, j in chunks(off):
        s, e, p = word_spans(buf[off[i] : off[j]], off[i : j + 1] - off[i], WORD)
        start.append(hasher(buf[off[i] : off[j]], s, e))
        per.append(p[1:] + per[-1][-1])
    return np.concatenate(start), np.concatenate(per)


@dataclass
class Postings:
    terms: np.ndarray
    at: np.ndarray  # where each term's positions begin
    positions: np.ndarray
    first: np.ndarray  # position of each text's first word
    words: np.ndarray  # of each text


def make_postings(words: np.ndarray, per: np.ndarray) -> Postings:
    n = np.diff(per)
    first = per[:-1] + GAP * np.arange(len(n))
    place = np.arange(len(words)) + np.repeat(GAP * np.arange(len(n)), n)
    order = np.argsort(words, kind="stable")
    ordered = words[order]
    new = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(words) else np.zeros(0, np.int64)
    return Postings(ordered[new], np.append(new, len(words)), place[order], first, n)


def packed(p: Postings) -> tuple[bytes, bytes, bytes]:
    """Terms, their counts and the steps between positions; a term's first step is from 0."""
    step = np.diff(p.positions, prepend=0)
    step[p.at[:-1]] = p.positions[p.at[:-1]]
    return p.terms.tobytes(), np.diff(p.at).astype(np.uint32).tobytes(), step.astype(np.uint32).tobytes()


def unpacked(words: np.ndarray, terms: bytes, counts: bytes, steps: bytes) -> Postings:
    at = np.concatenate([[0], np.cumsum(np.frombuffer(counts, np.uint32), dtype=np.int64)])
    run = np.cumsum(np.frombuffer(steps, np.uint32), dtype=np.int64)
    before = np.concatenate([[0], run])[at[:-1]]
    first = np.cumsum(words) - words + GAP * np.arange(len(words))
    return Postings(np.frombuffer(terms, np.uint64), at, run - np.repeat(before, np.diff(at)), first, words)


def build_index(spark: SparkSession, docs: DataFrame, key: Column, text: Column, name: str = "postings") -> DataFrame:
    """Writes the index of docs: a row for each segment with its texts' keys (bigint), their numbers of words, the postings and the number of the first text, which the others follow."""
    prepare(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SpanHasher()
        for pid, seen, b in numbered(batches):
            buf, off = text_bytes(b.column(1))
            for i, j in chunks(off, SEGMENT_BYTES):
                words, per = hashed_words(buf[off[i] : off[j]], off[i : j + 1] - off[i], hasher)
                p = make_postings(words, per)
                keys = pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), b.column(0).slice(i, j - i).cast(pa.int64()))
                sizes = pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), pa.array(p.words))
                yield pa.RecordBatch.from_arrays([keys, sizes, *(pa.array([x], pa.binary()) for x in packed(p)), pa.array([(pid << 40) + seen + i], pa.int64())], names=[x.split()[0] for x in SEGMENT.split(", ")])

    return table(spark, docs.select(key.cast("long").alias("key"), text.alias("text")).mapInArrow(run, SEGMENT), name)


@dataclass
class Phrases:
    """Distinct windows of the items, as places in their stream of words."""

    vocabulary: np.ndarray
    words: np.ndarray  # of all items one after another, as numbers of the vocabulary
    start: np.ndarray  # of each window
    length: np.ndarray
    item_at: np.ndarray
    items: np.ndarray  # items of each window, as numbers
    names: list[str]

    def terms(self, windows: slice) -> np.ndarray:
        """Words of some windows: a row for each, -1 past a short window's end."""
        start, length = self.start[windows], self.length[windows]
        k = np.arange(length.max(initial=1))
        return np.where(k < length[:, None], self.words[np.minimum(start[:, None] + k, len(self.words) - 1)], -1)


def windows_of(names: list[str], texts: list[str], window: int = WINDOW) -> Phrases:
    words, per = hashed_words(*text_bytes(pa.array(texts, pa.large_string())), SpanHasher())
    vocabulary, number = np.unique(words, return_inverse=True)
    count = np.diff(per)
    many = np.where(count > window, count - window + 1, np.minimum(count, 1))
    start, owner = ragged(per[:-1], many)
    length = np.minimum(count[owner], window)
    h = length.astype(np.uint64)
    for k in range(window):
        w = words[np.minimum(start + k, max(0, len(words) - 1))] if len(words) else np.zeros(0, np.uint64)
        h = np.where(k < length, mixed(h * np.uint64(0x9E3779B97F4A7C15) + w), h)
    _, first, same = np.unique(h, return_index=True, return_inverse=True)
    label = {n: k for k, n in enumerate(sorted(set(names)))}
    pairs = np.unique(same * max(1, len(label)) + np.array([label[n] for n in names], np.int64)[owner])
    which, items = pairs // max(1, len(label)), pairs % max(1, len(label))
    return Phrases(vocabulary, number.astype(np.int32), start[first], length[first], np.searchsorted(which, np.arange(len(first) + 1)), items, [*label])


def ragged(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices start .. start + size of each row one after another, and the row of each."""
    at = np.cumsum(size) - size
    row = np.repeat(np.arange(len(size)), size)
    return np.arange(size.sum()) + (start - at)[row], row


def find(p: Postings, q: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, position, words) of every occurrence of a window in a segment. SLICE windows are looked up at a time."""
    none = (np.zeros(0, np.int64),) * 3
    if not len(q.start) or not len(p.terms):
        return none
    place = np.minimum(np.searchsorted(p.terms, q.vocabulary), len(p.terms) - 1)
    here = p.terms[place] == q.vocabulary
    count = np.where(here, np.diff(p.at)[place], 0)
    base = int(p.positions.max()) + GAP
    joint = np.repeat(np.arange(len(p.terms)), np.diff(p.at)) * base + p.positions  # ascending
    out = [none]
    for begin in range(0, len(q.start), SLICE):
        terms = q.terms(slice(begin, begin + SLICE))
        freq = np.where(terms >= 0, count[terms], np.iinfo(np.int64).max)
        alive = np.flatnonzero(freq.min(1) > 0)
        freq, terms = freq[alive], terms[alive]
        order = np.argsort(freq, axis=1, kind="stable")  # rarest first; past the end last
        rare = np.take_along_axis(terms, order[:, :1], 1)[:, 0]
        at, row = ragged(p.at[place[rare]], count[rare])
        spot = p.positions[at] - order[row, 0]
        for k in range(1, terms.shape[1]):
            t = terms[row, order[row, k]]
            if not len(t):
                break
            want = place[t] * base + spot + order[row, k]
            ok = (t < 0) | ((joint[np.minimum(np.searchsorted(joint, want), len(joint) - 1)] == want) & (spot + order[row, k] >= 0))
            row, spot = row[ok], spot[ok]
        out.append((begin + alive[row], spot, q.length[begin + alive[row]]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def near(p: Postings, q: Phrases, within: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, first position, words) of the spans of `within` words at most that hold all words of a window, in any order,
    a repeated word as often: the smallest ones, which hold no other such span."""
    out: list[tuple[int, int, int]] = []
    if not len(p.terms):
        return (np.zeros(0, np.int64),) * 3
    place = np.minimum(np.searchsorted(p.terms, q.vocabulary), len(p.terms) - 1)
    here = p.terms[place] == q.vocabulary
    for w in range(len(q.start)):
        own, need = np.unique(q.words[q.start[w] : q.start[w] + q.length[w]], return_counts=True)
        if not here[own].all():
            continue
        lists = [p.positions[p.at[place[t]] : p.at[place[t] + 1]] for t in own]
        rare = min(lists, key=len)
        close = []
        for x in lists:  # only what has the rarest word near it matters
            k = np.searchsorted(rare, x)
            after, before = rare[np.minimum(k, len(rare) - 1)], rare[np.maximum(k - 1, 0)]
            close.append(x[np.minimum(np.abs(after - x), np.abs(x - before)) < within])
        spot = np.concatenate(close)
        who = np.repeat(np.arange(len(own)), [len(x) for x in close])
        by = np.argsort(spot, kind="stable")
        spot, who = spot[by].tolist(), who[by].tolist()
        have, full, left = [0] * len(own), 0, 0
        for right, k in enumerate(who):
            have[k] += 1
            full += have[k] == need[k]
            while full == len(own):
                own_left = who[left]
                if have[own_left] == need[own_left]:  # without its first word the span isn't one any more
                    if spot[right] - spot[left] < within:
                        out.append((w, spot[left], spot[right] - spot[left] + 1))
                    full -= 1
                have[own_left] -= 1
                left += 1
    cols = np.array(out, np.int64).reshape(-1, 3)
    return cols[:, 0], cols[:, 1], cols[:, 2]


def hits(p: Postings, q: Phrases, within: int = 0) -> list[tuple[int, list[list[int]], list[int]]]:
    """(text, spans of hit words [from, to), items) of the segment's texts that have any."""
    window, spot, length = near(p, q, within) if within else find(p, q)
    if not len(window):
        return []
    by = np.argsort(spot, kind="stable")
    window, spot, length = window[by], spot[by], length[by]
    text = np.searchsorted(p.first, spot, "right") - 1
    out = []
    for t in np.unique(text):
        mine = slice(*np.searchsorted(text, [t, t + 1]))
        a = spot[mine] - p.first[t]
        b = np.minimum(a + length[mine], p.words[t])
        top = np.maximum.accumulate(b)
        new = np.flatnonzero(np.concatenate([[True], a[1:] > top[:-1]]))
        ends = top[np.append(new[1:], len(a)) - 1]
        found = np.unique(window[mine])
        at, _ = ragged(q.item_at[found], q.item_at[found + 1] - q.item_at[found])
        out.append((int(t), np.stack([a[new], ends], 1).tolist(), np.unique(q.items[at]).tolist()))
    return out


FOUND = "number bigint, spans array<array<bigint>>, items array<string>"
SPANS, ITEMS = pa.list_(pa.list_(pa.int64())), pa.list_(pa.string())


def search_block(spark: SparkSession, index: DataFrame, phrases: Phrases, within: int) -> DataFrame:
    """(number, spans, items) of the texts that hold a window of these phrases."""
    held = spark.sparkContext.broadcast(vars(phrases))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = Phrases(**held.value)
        for b in batches:
            for k in range(b.num_rows):
                words, first = np.asarray(b.column(0)[k].values), b.column(4)[k].as_py()
                p = unpacked(words, *(b.column(c)[k].as_py() for c in (1, 2, 3)))
                got = hits(p, q, within)
                cols = [pa.array([first + t for t, _, _ in got], pa.int64()), pa.array([s for _, s, _ in got], SPANS), pa.array([[q.names[x] for x in i] for _, _, i in got], ITEMS)]
                yield pa.RecordBatch.from_arrays(cols, names=["number", "spans", "items"])

    return index.select("words", "terms", "counts", "steps", "base").mapInArrow(run, FOUND)


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unites the spans and items that several blocks of phrases found in a text."""
    for b in batches:
        spans, items = [], []
        for lists in b.column(1).to_pylist():
            out: list[list[int]] = []
            for a, e in sorted(x for s in lists for x in s):
                if out and a <= out[-1][1]:
                    out[-1][1] = max(out[-1][1], e)
                else:
                    out.append([a, e])
            spans.append(out)
        for lists in b.column(2).to_pylist():
            items.append(sorted({x for s in lists for x in s}))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, SPANS), pa.array(items, ITEMS)], names=["number", "spans", "items"])


def search(spark: SparkSession, index: DataFrame, items: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW, within: int = 0) -> DataFrame:
    """(key, n_words, spans, items) for every indexed text: the word spans that windows of the items cover, and whose they are.

    A window is `window` consecutive words of an item; an item of fewer, but not
    none, is one window. With within > 0 a window's words count wherever all of
    them stand in any order among that many words (window <= within <= 1024);
    the span is from the first of them to the last. Items without words, and null
    texts, find nothing; a null item id counts as the empty text. Words are
    compared by 64-bit hashes; texts are searched whole. Other columns of the
    items aren't read.

    Items are searched in blocks of QUERY_BYTES, one after another: the driver
    and each worker hold one block's words, and what a block finds is written.
    """
    if within and not window <= within <= GAP:
        raise ValueError("within must lie between window and 1024")
    queries = items.select(F.coalesce(column_of(items, item).cast("string"), F.lit("")).alias("item"), F.coalesce(column_of(items, text), F.lit("")).alias("text"))
    size = queries.agg(F.sum(F.octet_length("text") + F.octet_length("item") + 16)).first()[0] or 0
    blocks, found = int(size // QUERY_BYTES) + 1, None
    for k in range(blocks):
        # Blocks of one size each, about; an item longer than that is a block with what falls in with it.
        got = queries.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).toArrow()
        block = table(spark, search_block(spark, index, windows_of(got.column("item").to_pylist(), got.column("text").to_pylist(), window), within), "found")
        found = found.unionByName(block) if found else block
    whole = found.groupBy("number").agg(F.collect_list("spans").alias("spans"), F.collect_list("items").alias("items")).mapInArrow(merged, FOUND)
    texts = index.select("base", F.posexplode(F.arrays_zip("rows", "words"))).select((F.col("base") + F.col("pos")).alias("number"), F.col("col.rows").alias("key"), F.col("col.words").alias("n_words"))
    none = lambda name: F.coalesce(F.col(name), F.array().cast(whole.schema[name].dataType)).alias(name)
    return texts.join(whole, "number", "left").select("key", "n_words", none("spans"), none("items"))


def digest(matches: DataFrame) -> DataFrame:
    """n_hit, n_items, items_sha256 and contaminated of search()'s rows."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return matches.select("key", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words and items of the benchmark that it holds."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return digest(search(spark, build_index(spark, docs, F.col("doc_id"), F.col("text")), items)).withColumnRenamed("key", "doc_id")


def without_benchmark(spark: SparkSession, docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that hold no window of any item. Texts are told apart by a 64-bit hash, so repeated ids do no harm; columns of any name are carried along unread."""
    own = F.xxhash64(column_of(docs, key), column_of(docs, text))
    index = build_index(spark, docs, own, column_of(docs, text))
    bad = table(spark, search(spark, index, items).where(F.size("spans") > 0).select("key").distinct(), "contaminated")
    drop_tables(spark, index)
    return unboxed(docs.select(F.struct("*").alias("doc"), own.alias("key")).join(bad, "key", "left_anti").select("doc"))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[k : k + 9], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS k FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM bw),
m AS (
  SELECT DISTINCT doc_id, k, x.n, item_id FROM (
    SELECT doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)
  ) x JOIN bw ON x.n = bw.n AND x.g = bw.g
), h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN i ON d.doc_id = i.doc_id
"""
