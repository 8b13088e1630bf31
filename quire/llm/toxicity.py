"""Toxicity by a factorisation machine over hashed terms.

A text is the set of its terms, hashed to 2^20 ids: lower-cased words, and their
first five to eight bytes, which stand for words that no labelled text has. The
score is a logistic of bias, linear weights and pairwise interactions of
factors, so that two terms that are harmless apart can weigh together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import SpanHasher, boxed, byte_class, chunks, crc_mod, drop_tables, part, prepare, schema_with, table, text_bytes, unboxed, word_spans

BITS = 20
SAMPLE = 20_000  # labelled texts that are fitted, at most
MIN_TEXTS = 4  # labelled texts that a term must occur in
FACTORS = 8
TERMS = 1 << 14  # that are fitted, at most: those whose share of toxic texts is furthest from chance
SLOTS = 8_000_000  # fitted terms of all texts together, at most
PREFIXES = (5, 6, 7, 8)  # bytes

WORD = byte_class(lambda b: b >= 128 or chr(b).isalnum())


@dataclass
class Machine:
    bias: float
    slot: np.ndarray  # of a term id, -1: unknown
    linear: np.ndarray
    factors: np.ndarray


def terms(buf: np.ndarray, off: np.ndarray, hasher: SpanHasher, slot: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, term) pairs, each once, ordered by text. With slot: terms are its positions, unknown ones are left out."""
    start, end, per = word_spans(buf, off, WORD)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    heads = [np.minimum(start + n, end) for n in PREFIXES]
    term = np.concatenate([hasher(buf, start, e) ^ np.uint64(k << 64 - BITS) for k, e in enumerate([end, *heads])])
    term = (term >> np.uint64(64 - BITS)).astype(np.int64)
    text = np.tile(np.repeat(np.arange(len(off) - 1), np.diff(per)), len(PREFIXES) + 1)
    if slot is not None:
        term = slot[term]
        text, term = text[term >= 0], term[term >= 0]
    pairs = np.sort(text << BITS | term)
    pairs = pairs[np.flatnonzero(np.diff(pairs, prepend=-1))]
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


def sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of the runs of rows between the offsets at, empty runs 0."""
    run = np.zeros((len(values) + 1, *values.shape[1:]))
    np.cumsum(values, axis=0, out=run[1:])
    return run[at[1:]] - run[at[:-1]]


def raw_scores(m: Machine, term: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores before the logistic, and the factors' sums, of texts whose terms lie between the offsets at."""
    v = m.factors[term]
    total = sums(v, at)
    pairs = 0.5 * ((total**2).sum(1) - sums((v * v).sum(1), at))
    return m.bias + sums(m.linear[term], at) + pairs, total


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(known: np.ndarray, share: float, term: np.ndarray, many: np.ndarray, label: np.ndarray, epochs: int = 12, steps: int = 600, rate: float = 0.08, seed: int = 3) -> Machine:
    """Mini-batches with AdaGrad. known: the fitted terms' ids; term: slots of all texts one after another, many of each text; share of toxic texts."""
    rng = np.random.default_rng(seed)
    n = len(label)
    at = np.concatenate([[0], np.cumsum(many)])
    slot = np.full(1 << BITS, -1, np.int32)
    slot[known] = np.arange(len(known))
    m = Machine(float(np.log(share / (1 - share))), slot, np.zeros(len(known)), rng.normal(0, 0.01, (len(known), FACTORS)))
    if not n or label.min() == label.max() or not len(known):
        return m
    g_bias, g_lin, g_fac = 1e-3, np.full(len(known), 1e-3), np.full(m.factors.shape, 1e-3)
    size = int(np.clip(n // 64, 16, 256))
    for _ in range(max(epochs, min(100, steps * size // n))):  # small samples are passed over more often
        order = rng.permutation(n)
        for rows in np.array_split(order, max(1, n // size)):
            own = at[rows + 1] - at[rows]
            b = np.concatenate([[0], np.cumsum(own)])
            t = term[np.repeat(at[rows] - b[:-1], own) + np.arange(b[-1])]
            score, total = raw_scores(m, t, b)
            err = (logistic(score) - label[rows]) / len(rows)
            e = np.repeat(err, own)
            g_bias += err.sum() ** 2
            m.bias -= rate * err.sum() / np.sqrt(g_bias)
            seen, back = np.unique(t, return_inverse=True)
            lin = np.bincount(back, e, len(seen)) + 1e-5 * m.linear[seen]
            grad = e[:, None] * (np.repeat(total, own, axis=0) - m.factors[t])
            by = np.argsort(back, kind="stable")
            fac = np.add.reduceat(grad[by], np.searchsorted(back[by], np.arange(len(seen))), axis=0) + 1e-4 * m.factors[seen]
            g_lin[seen] += lin**2
            g_fac[seen] += fac**2
            m.linear[seen] -= rate * lin / np.sqrt(g_lin[seen])
            m.factors[seen] -= 0.5 * rate * fac / np.sqrt(g_fac[seen])
    return m


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """Rows (order, label, text) of documents with a label 0 or 1: those of the smallest hashes of their ids, `most` at most."""
    labels = labels.select("doc_id", F.col("toxic").alias("label")).where(F.col("label").isin(0, 1))
    labels = labels.groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    h = F.xxhash64(F.lit("fit"), F.col("doc_id"))
    picked = labels.where(F.col("doc_id").isNotNull()).select("doc_id", "label", h.alias("order")).orderBy("order", "doc_id").limit(most)
    # `most` ids and labels are small enough to broadcast, so texts stay where they are.
    return F.broadcast(picked).join(docs.select("doc_id", "text"), "doc_id").select("order", "label", "text")


def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text of (order, label, text) becomes its terms."""
    hasher = SpanHasher()
    for b in batches:
        buf, off = text_bytes(b.column(2))
        for i, j in chunks(off):
            text, term = terms(buf[off[i] : off[j]], off[i : j + 1] - off[i], hasher)
            at = np.searchsorted(text, np.arange(j - i + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.ListArray.from_arrays(pa.array(at), pa.array(term.astype(np.int32)))], names=["order", "label", "terms"])


def informative(bags: DataFrame, most: int) -> tuple[np.ndarray, float]:
    """The terms of MIN_TEXTS texts at least whose share of toxic texts is furthest from chance, `most` at most, in order; and
    that share of all. Terms are counted on the executors; a term hashes to 2^20 ids, so that is what there can be of them."""
    size = bags.agg(F.count("*").alias("n"), F.sum("label").alias("bad")).first()
    share = float(np.clip((size["bad"] or 0) / max(1, size["n"]), 1e-4, 1 - 1e-4))
    each = bags.select("label", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"), F.sum("label").alias("bad"))
    far = F.abs(F.col("bad") - F.col("n") * share) / F.sqrt(F.col("n") * (share * (1 - share)))
    top = each.where(F.col("n") >= MIN_TEXTS).orderBy(far.desc(), "term").limit(most).select("term").toArrow()
    return np.sort(np.asarray(top.column("term"))).astype(np.int64), share


def bounded(bags: DataFrame, known: np.ndarray, texts: int, most: int) -> pa.Table:
    """(label, slots) of the first bags in order: so many texts at most, and as far as their known terms add up to `most`."""
    slot = np.full(1 << BITS, -1, np.int16)
    slot[known] = np.arange(len(known))
    held = bags.sparkSession.sparkContext.broadcast(slot)

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, size = held.value[np.asarray(b.column(2).flatten())], np.asarray(b.column(2).value_lengths(), np.int64)
            upto = np.concatenate([[0], np.cumsum(own >= 0)])
            at = upto[np.concatenate([[0], np.cumsum(size)])].astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(at), pa.array(own[own >= 0]))], names=["order", "label", "slots"])

    rows = bags.mapInArrow(slots, "order bigint, label int, slots array<smallint>").withColumn("n", F.size("slots") + 1)
    by = ["order", "label", F.xxhash64("slots")]
    upto = F.sum("n").over(Window.orderBy(*by).rowsBetween(Window.unboundedPreceding, 0))  # of a bounded sample
    return rows.orderBy(*by).limit(texts).withColumn("upto", upto).where(F.col("upto") <= most).select("label", "slots").toArrow()


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, most: int = SAMPLE, most_terms: int = TERMS, most_slots: int = SLOTS) -> Machine:
    """Fits a machine. docs and labels hold only rows that may be learnt from.

    Three parameters bound what is fitted and what reaches the driver: `most`
    labelled texts, `most_terms` terms, and `most_slots` terms of all texts
    together (two bytes each); texts behind the last bound are left out. Greater
    bounds only add to what is fitted. More than 32,767 terms can't be.
    """
    if most_terms > np.iinfo(np.int16).max:
        raise ValueError("at most 32,767 terms can be fitted")
    prepare(spark)
    bags = table(spark, labelled_sample(docs, labels, most).mapInArrow(bag, "order bigint, label int, terms array<int>"), "bags")
    known, share = informative(bags, most_terms)
    got = bounded(bags, known, most, most_slots)
    drop_tables(spark, bags)
    slots = got.column("slots").combine_chunks()
    size = np.asarray(slots.value_lengths(), np.int64) if len(slots) else np.zeros(0, np.int64)
    term, label = np.array(slots.flatten()), np.array(got.column("label"), float)
    del got, slots
    pa.default_memory_pool().release_unused()  # the batches have been copied
    return fit(known, share, term, size, label)


def score(spark: SparkSession, df: DataFrame, machine: Machine, text_col: str = "text") -> DataFrame:
    """(doc, score) for each row: doc is the row as a struct, so its names clash with none.

    Null and empty texts score as a text without known terms. Texts are read
    whole, one long text at a time; rows are independent: repeated rows repeat,
    an empty table gives none.
    """
    prepare(spark)
    rows, model = boxed(df), spark.sparkContext.broadcast(vars(machine))
    place = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, m = SpanHasher(), Machine(**model.value)
        for b in batches:
            buf, off = text_bytes(part(b, place))
            out = np.empty(b.num_rows)
            for i, j in chunks(off):
                text, term = terms(buf[off[i] : off[j]], off[i : j + 1] - off[i], hasher, m.slot)
                out[i:j] = logistic(raw_scores(m, term, np.searchsorted(text, np.arange(j - i + 1)))[0])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out)], names=["doc", "score"])

    return rows.mapInArrow(run, schema_with(rows, "score double"))


def learnable(df: DataFrame) -> DataFrame:
    return df.where(crc_mod(F.col("doc_id"), 5) != 0)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learnt from the rows that aren't held out."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    m = train(spark, learnable(docs), learnable(labels))
    out = score(spark, docs.select("doc_id", "text"), m)
    return out.select("doc.doc_id", (crc_mod(F.col("doc.doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the machine scores under 0.5."""
    m = train(spark, learnable(docs), learnable(labels))
    return unboxed(score(spark, docs, m).where(F.col("score") < 0.5))
