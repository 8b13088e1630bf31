"""Language identification by bit-sliced Bloom filters of n-grams.

One array of cells serves all languages: a cell is a bitmask of languages, of as
many 64-bit words as they need, and the AND of an n-gram's cells has the bits of
all languages that contain it. Of a text, each language counts the n-grams whose
mask has its bit; counts are corrected for the filter's false positives, which
follow from how full a language's slice is, and the greatest decides.

The cells are filled on the executors. What reaches the driver is the array
itself: 8 MB for each 64 languages, however much is learnt.
"""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import CHUNK_BYTES, boxed, chunks, column_of, crc_mod, drop_tables, mixed, part, prepare, schema_with, text_bytes
from quire.llm.common import table as write

SAMPLE = 4_000  # different texts of a language that are learnt from, about, at most
FLOOR = 0.05  # of an n-gram's rate in the language where it is most frequent: under that it is taken for a stray quotation
CELLS, PROBES = 1 << 20, 3
WORD = 64  # languages in a word of a mask
N = 4  # letters, or the space between words, in an n-gram


@dataclass
class Filters:
    names: list[str]
    cells: np.ndarray  # of masks: a row for each word of them
    false_rate: np.ndarray  # of a language: chance that an n-gram it lacks passes


@functools.cache
def letters() -> np.ndarray:
    """For each code point: 0 if it is no letter, else its lower-case form."""
    t = np.zeros(sys.maxunicode + 1, np.uint32)
    for c in range(len(t)):
        if (s := chr(c)).isalpha():
            t[c] = ord(s.lower()[0])
    return t


def probes(gram: np.ndarray) -> list[np.ndarray]:
    """Cells of n-grams: pieces of one hash, which are independent enough."""
    return [((gram >> np.uint64(21 * k)) & np.uint64(CELLS - 1)).astype(np.int64) for k in range(PROBES)]


def grams(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n-gram hashes of all texts, the text of each, and for each text whether it has a letter.

    Runs of other characters count as one space; a text has none at its start and
    one at its end.
    """
    joined = " \0 ".join(["", *texts, ""])
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = table[code]
    # Texts may hold NULs themselves: the real separators are where the lengths say.
    ends = np.cumsum([3, *(len(t) + 3 for t in texts)]) - 2
    keep = np.empty(len(code), bool)
    keep[0] = True
    keep[1:] = (letter[1:] > 0) | (letter[:-1] > 0)
    keep[ends] = True
    value = letter.astype(np.uint64)
    value[ends] = 0xFFFFFF
    owner = np.zeros(len(code), np.int64)
    owner[ends[:-1]] = 1
    owner = np.cumsum(owner) - 1
    value, owner = value[keep], owner[keep]
    has = np.bincount(owner[(value > 0) & (value < 0xFFFFFF)], minlength=len(texts))[: len(texts)] > 0
    if len(value) < N:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), has
    m = len(value) - N + 1
    h = np.zeros(m, np.uint64)
    ok = np.ones(m, bool)
    for k in range(N):
        v = value[k : k + m]
        h = h * np.uint64(0x9E3779B97F4A7C15) + v
        ok &= v < 0xFFFFFF
    return mixed(h[ok]), owner[:m][ok], has


def decoded(col: pa.Array) -> Iterator[tuple[int, int, list[str]]]:
    buf, off = text_bytes(col)
    for i, j in chunks(off, CHUNK_BYTES):
        yield i, j, [bytes(buf[off[k] : off[k + 1]]).decode("utf-8", "replace") for k in range(i, j)]


def filters(names: list[str], word: np.ndarray, cell: np.ndarray, mask: np.ndarray) -> Filters:
    """Filters from the masks of their filled cells."""
    cells = np.zeros((max(1, -(-len(names) // WORD)), CELLS), np.uint64)
    cells[word, cell] = mask
    filled = [((cells[k // WORD] >> np.uint64(k % WORD)) & np.uint64(1)).mean() for k in range(len(names))]
    return Filters(names, cells, np.array(filled) ** PROBES)


def languages_of(f: Filters, gram: np.ndarray) -> np.ndarray:
    """The words of the mask of all languages whose filter holds each n-gram: a row for each word."""
    first, *rest = probes(gram)
    masks = []
    for word in f.cells:
        mask = word[first]
        for p in rest:
            mask = mask & word[p]
        masks.append(mask)
    return np.stack(masks)


def decide(f: Filters, gram: np.ndarray, owner: np.ndarray, has: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The language and score of each text: the winner's share of all corrected counts."""
    n = np.bincount(owner, minlength=len(has)).astype(float)
    mask = languages_of(f, gram)
    hits = np.zeros((len(has), max(1, len(f.names))))
    for k in range(len(f.names)):
        hits[:, k] = np.bincount(owner, ((mask[k // WORD] >> np.uint64(k % WORD)) & np.uint64(1)).astype(float), len(has))
    true = np.maximum(0, (hits - n[:, None] * f.false_rate) / (1 - f.false_rate)) if f.names else hits
    best, total = true.argmax(1), true.sum(1)
    known = has & bool(f.names)
    score = np.where(known & (total > 0), true.max(1) / np.maximum(total, 1e-9), np.where(known, 1 / max(1, len(f.names)), 0.0))
    return [f.names[b] if k else "und" for b, k in zip(best, known, strict=True)], score


def counted(batches: Iterator[pa.RecordBatch], table: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of rows (lang, text), language numbers; summed up as far as memory allows."""
    lang, gram, held = [], [], 0

    def summed() -> pa.RecordBatch:
        h, k = np.concatenate(gram), np.concatenate(lang)
        order = np.lexsort((h, k))
        h, k = h[order], k[order]
        new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (k[1:] != k[:-1])]))
        return pa.RecordBatch.from_arrays([pa.array(k[new]), pa.array(h[new].view(np.int64)), pa.array(np.diff(np.append(new, len(h))))], names=["lang", "gram", "n"])

    for b in batches:
        names = b.column(0).to_numpy()
        for i, _, texts in decoded(b.column(1)):
            h, owner, _ = grams(texts, table)
            lang.append(names[i + owner])
            gram.append(h)
            held += len(h)
            if held > 1_000_000:
                yield summed()
                lang, gram, held = [], [], 0
    if held:
        yield summed()


def learn(spark: SparkSession, docs: DataFrame, lang: str = "lang", text: str = "text", sample: int = SAMPLE) -> Filters:
    """Filters of the languages of docs.

    Of a language about `sample` different texts are read at most, those of the
    smallest hashes; a text counts once however often it is repeated. An n-gram
    belongs to every language whose texts have it twice at least, and not under
    FLOOR of its rate in another. Rows without a text or a language teach nothing.
    """
    prepare(spark)
    rows = docs.where(column_of(docs, lang).isNotNull() & column_of(docs, text).isNotNull()).select(column_of(docs, lang).alias("lang"), column_of(docs, text).alias("text"))
    h = F.xxhash64("text")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct(h).alias("n")).collect()}
    names = sorted(sizes)
    if not names:
        return filters([], *(np.zeros(0, np.int64) for _ in range(3)))
    known = spark.createDataFrame([(n, k, sample / sizes[n]) for k, n in enumerate(names)], "lang string, number int, share double")
    # A row for each language, which the driver has held.
    picked = rows.join(F.broadcast(known), "lang").where(F.pmod(h, F.lit(1 << 30)) / float(1 << 30) < F.col("share"))
    texts = picked.groupBy("number", h.alias("hash")).agg(F.first("text").alias("text")).select("number", "text")
    table = spark.sparkContext.broadcast(letters())
    each = texts.mapInArrow(lambda bs: counted(bs, table.value), "lang int, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")).where("n > 1")
    each = write(spark, each, "grams")
    rate = F.col("n") / F.col("total")
    rated = each.join(F.broadcast(each.groupBy("lang").agg(F.sum("n").alias("total"))), "lang").select("lang", "gram", rate.alias("rate"))
    top = rated.groupBy("gram").agg(F.max("rate").alias("top"))
    members = rated.join(top, "gram").where(F.col("rate") >= F.col("top") * FLOOR)
    cell = F.explode(F.array(*(F.shiftrightunsigned("gram", 21 * k).bitwiseAND(F.lit(CELLS - 1)) for k in range(PROBES))))
    bit = F.expr(f"shiftleft(1L, lang % {WORD})")
    filled = members.select(F.floor(F.col("lang") / WORD).alias("word"), cell.alias("cell"), bit.alias("bit")).groupBy("word", "cell").agg(F.bit_or("bit").alias("mask")).toArrow()
    out = filters(names, *(np.asarray(filled.column(c)) for c in ("word", "cell")), np.asarray(filled.column("mask")).view(np.uint64))
    drop_tables(spark, each)
    return out


def identify(spark: SparkSession, df: DataFrame, filters: Filters, text_col: str = "text") -> DataFrame:
    """(doc, lang, score) for each row: doc is the row as a struct, so its names clash with none; score is 0 to 1.

    `und` and 0 where the text is null or has no letter. Of languages that count
    the same the first by name wins. Texts are read whole, one long text at a
    time; rows are independent: repeated rows repeat, an empty table gives none.
    """
    prepare(spark)
    rows, model, known = boxed(df), spark.sparkContext.broadcast(vars(filters)), spark.sparkContext.broadcast(letters())
    place = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Filters(**model.value)
        for b in batches:
            lang, score = [], []
            for _, _, texts in decoded(part(b, place)):
                got = decide(f, *grams(texts, known.value))
                lang += got[0]
                score.append(got[1])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(np.concatenate(score) if score else np.zeros(0))], names=["doc", "lang", "score"])

    return rows.mapInArrow(run, schema_with(rows, "lang string, score double"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learnt from the rows that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    out = identify(spark, docs.select("doc_id", "text"), learn(spark, docs.where(crc_mod(F.col("doc_id"), 4) != 2)))
    return out.select("doc.doc_id", (crc_mod(F.col("doc.doc_id"), 4) == 2).alias("held_out"), F.col("lang").alias("lang_pred"), "score")
