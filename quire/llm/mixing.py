"""Mixing sources to target weights by Pareto order sampling.

Every source has a target in words. A document's expected number of copies is
its source's rate times a mild preference for longer documents, three at most.
The whole part of it is certain. For the rest documents are ranked by
(u / (1 - u)) / (p / (1 - p)), u uniform from a hash of the document's id and p
the fractional part, and taken in that order until the source's remaining words
are filled: a sample of fixed size, in words, with unequal probabilities.

The cut through each source's ranking is found by radix selection: four
histograms of 13 bits of the rank each. Nothing is sorted, no source is
gathered, and ranks are compared exactly. A second cut, among shorter documents
behind the first, fills the words that the document at the first cut leaves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import byte_class, chunks, column_of, dense_index, part, per_batch, prepare, schema_with, table, text_bytes, unboxed, unit_interval, word_spans

MOST_COPIES = 3.0
DIGIT, LEVELS = 13, 4  # 52 bits of rank


WORD = byte_class(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))


def sized_rows(df: DataFrame, source: str, text: str, key: str, seed: int, carry: list[str]) -> DataFrame:
    """(doc, _source, _u, _size): doc has the carried columns; _size is the number of runs of bytes that aren't white space, 0 for null.

    One pass over the bytes, without a list of the words. A carried text isn't sent to the workers twice.
    """
    doc = F.struct(*(column_of(df, c) for c in carry)).alias("doc")
    apart = text not in carry
    own = [column_of(df, text).alias("_text")] if apart else []
    rows = df.select(doc, column_of(df, source).cast("string").alias("_source"), unit_interval(column_of(df, key), seed).alias("_u"), *own)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        buf, off = text_bytes(b.column(3) if apart else part(b, carry.index(text)))
        n = np.zeros(b.num_rows, np.int64)
        for i, j in chunks(off):
            n[i:j] = np.diff(word_spans(buf[off[i] : off[j]], off[i : j + 1] - off[i], WORD)[2])
        return pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(n)], names=["doc", "_source", "_u", "_size"])

    return rows.mapInArrow(per_batch(run), schema_with(rows.drop("_text"), "_size bigint"))


def size_class(size: Column) -> Column:
    """Bits of the size: 0 for none, 64 classes at most."""
    return F.when(size > 0, F.length(F.bin(size))).otherwise(0).cast("int")


def preference(kind: np.ndarray | Column) -> np.ndarray | Column:
    return kind / 16.0 + 1.0


def cycle_weights(spark: SparkSession, totals: DataFrame) -> DataFrame:
    """Weights 1, 2, 3, repeating, for the sources in code-point order, null last."""
    ordered = totals.repartitionByRange(F.col("_source").asc_nulls_last()).sortWithinPartitions(F.col("_source").asc_nulls_last())
    return dense_index(spark, ordered, "sources").withColumn("_weight", (F.col("_index") % 3 + 1).cast("double")).drop("_index")


def reshared(weighted: DataFrame) -> float:
    """Words for each unit of weight, so that targets min(cap, weight * unit) add up to all words.

    Every round looks at one row of sums. A source that has reached its cap
    stays there, so the rounds end; usually there are a handful.
    """
    cap, total, unit = F.col("_total") * MOST_COPIES, None, 0.0
    while True:
        full = cap <= F.col("_weight") * unit
        s = weighted.agg(F.sum("_total").alias("t"), F.sum(F.when(full, cap).otherwise(0.0)).alias("capped"), F.sum(F.when(full, 0.0).otherwise(F.col("_weight"))).alias("open")).first()
        total = float(s["t"] or 0)
        if not s["open"] or total == 0:
            return unit
        better = (total - s["capped"]) / s["open"]
        if better <= unit * (1 + 1e-12):
            return unit
        unit = better


def rates(classes: DataFrame) -> DataFrame:
    """The rate c of each source for which sum(words * min(3, c * preference)) meets its target; from 64 classes a source at most."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for target, rows in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                kind, words = np.array([r["_class"] for r in rows], float), np.array([r["_words"] for r in rows], float)
                order = np.argsort(-kind)
                g, w = preference(kind[order]), words[order]
                rate = 0.0
                for i in range(len(g)):  # the i classes of highest preference are at the limit
                    rest = float((w[i:] * g[i:]).sum())
                    rate = (target - MOST_COPIES * float(w[:i].sum())) / rest if rest else MOST_COPIES / g[i]
                    if rate * g[i] <= MOST_COPIES:
                        break
                out.append(min(max(rate, 0.0), MOST_COPIES / g[-1]) if len(g) else 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(out, pa.float64())], names=["_source", "_total", "_target", "_rate"])

    return classes.mapInArrow(solve, "_source string, _total bigint, _target double, _rate double")


def with_rank(df: DataFrame) -> DataFrame:
    """Adds _whole copies and _key, the rank in 52 bits; needs _size, _u and _rate."""
    e = F.least(F.lit(MOST_COPIES), F.col("_rate") * preference(size_class(F.col("_size"))))
    df = df.withColumn("_expected", e).withColumn("_whole", F.floor("_expected"))
    p, u = F.col("_expected") - F.col("_whole"), F.col("_u")
    # odds(u) / (odds(u) + odds(p)) orders as odds(u) / odds(p) does and lies in (0, 1]; p = 0 comes last.
    share = u * (1 - p) / (u * (1 - p) + p * (1 - u))
    return df.withColumn("_key", F.least(F.floor(share * float(1 << DIGIT * LEVELS)), F.lit((1 << DIGIT * LEVELS) - 1)).cast("long"))


def cut(spark: SparkSession, small: DataFrame, state: DataFrame, open_: Column) -> DataFrame:
    """state with _cut, the rank at which the words _rest of each source run out, and _last, the words at that very rank.

    Ranks count only rows for which open_ holds; _rest becomes what is left before _cut.
    """
    now = state.withColumn("_cut", F.lit(0).cast("long"))
    for level in range(LEVELS):
        shift = DIGIT * (LEVELS - 1 - level)
        rows = with_rank(small.join(now, small["_source"].eqNullSafe(now["_s"]), "inner")).where(open_ & (F.shiftright("_key", shift + DIGIT) == F.col("_cut")))
        bins = rows.groupBy("_s", F.shiftright("_key", shift).alias("_bin")).agg(F.sum("_size").alias("_words"), F.first("_rest").alias("_rest"))
        up = Window.partitionBy("_s").orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)  # of 8192 bins a source at most
        run = bins.withColumn("_sum", F.sum("_words").over(up))
        # The bin in which the words run out; where they never do, the last one.
        over = F.when(F.col("_sum") > F.col("_rest"), F.struct("_bin", "_sum", "_words"))
        hit = run.groupBy("_s").agg(F.coalesce(F.min(over), F.max(F.struct("_bin", "_sum", "_words"))).alias("_hit"))
        step = hit.select(F.col("_s").alias("_k"), F.col("_hit._bin").alias("_to"), (F.col("_hit._sum") - F.col("_hit._words")).alias("_before"), F.col("_hit._words").alias("_run"))
        keep = [c for c in now.columns if c not in ("_cut", "_rest", "_last")]
        # A source without open rows has no bin: nothing of it lies under rank 0.
        found = now.join(step, now["_s"].eqNullSafe(F.col("_k")), "left").select(*keep, F.coalesce("_to", F.lit(0)).alias("_cut"), (F.col("_rest") - F.coalesce("_before", F.lit(0))).alias("_rest"), F.coalesce("_run", F.lit(0)).alias("_last"))
        now = table(spark, found, "cut")
    return now


def cuts(spark: SparkSession, small: DataFrame, state: DataFrame) -> DataFrame:
    """state with the cuts of two passes.

    The first takes ranks under _cut1; the document at the cut may be long. The
    second fills what is left over with documents behind the cut of a quarter
    of those words at most (_fit), so targets are met within an eighth of them
    where there are enough such documents.
    """
    ranked = with_rank(small.join(state, small["_source"].eqNullSafe(state["_s"]), "inner"))
    whole = ranked.groupBy("_source").agg(F.sum(F.col("_whole") * F.col("_size")).alias("_sure")).withColumnRenamed("_source", "_w")
    rest = F.greatest(F.lit(0.0), F.col("_target") - F.coalesce(F.col("_sure"), F.lit(0)))
    first = table(spark, state.join(whole, state["_s"].eqNullSafe(F.col("_w")), "left").select(state["*"], rest.alias("_rest")), "cut")
    some = F.col("_expected") > F.col("_whole")
    one = cut(spark, small, first, some)
    one = one.select("_s", "_total", "_target", "_rate", F.col("_cut").alias("_cut1"), (F.col("_rest") >= F.col("_last")).alias("_with1"), F.when(F.col("_rest") >= F.col("_last"), F.col("_rest") - F.col("_last")).otherwise(F.col("_rest")).alias("_rest"))
    one = one.withColumn("_fit", F.col("_rest") / 4)
    two = cut(spark, small, one, some & ~under_first() & (F.col("_size") <= F.col("_fit")))
    return two.select(*(c for c in one.columns if c != "_rest"), F.col("_cut").alias("_cut2"), (F.col("_rest") * 2 >= F.col("_last")).alias("_with2"))


def under_first() -> Column:
    return (F.col("_key") < F.col("_cut1")) | ((F.col("_key") == F.col("_cut1")) & F.col("_with1"))


def under_second() -> Column:
    return (F.col("_size") <= F.col("_fit")) & ((F.col("_key") < F.col("_cut2")) | ((F.col("_key") == F.col("_cut2")) & F.col("_with2")))


def mix(spark: SparkSession, df: DataFrame, source: str = "source", text: str = "text", key: str = "doc_id", seed: int = 11, carry: list[str] | None = None) -> DataFrame:
    """(doc, size, total, target, copies) for each row: doc is a struct of the carried columns (all of df), so their names clash
    with none; size is the row's words, total and target those of its source; copies is 0 to 3.

    Null sources are one source of their own, null texts have size 0, an empty
    table gives an empty result. Texts are counted whole. Rows that repeat an id
    share its random number: at a cut they are taken or left together. Decisions
    depend on id, source and size alone: reruns agree, and so do runs over other
    partitions.
    """
    prepare(spark)
    # Written once: sizes are counted once, and all that follows reads its few columns.
    full = table(spark, sized_rows(df, source, text, key, seed, df.columns if carry is None else carry), "sizes")
    small = full.select("_source", "_size", "_u")
    classes = small.groupBy("_source", size_class(F.col("_size")).alias("_class")).agg(F.sum("_size").alias("_words"))
    totals = classes.groupBy("_source").agg(F.sum("_words").alias("_total"), F.collect_list(F.struct("_class", "_words")).alias("_classes"))
    weighted = table(spark, cycle_weights(spark, totals), "weights")
    target = F.least(F.col("_total") * MOST_COPIES, F.col("_weight") * reshared(weighted))
    state = rates(weighted.select("_source", "_total", target.alias("_target"), "_classes")).withColumnRenamed("_source", "_s")
    found = cuts(spark, small, table(spark, state, "rates"))
    ranked = with_rank(full.join(found, full["_source"].eqNullSafe(found["_s"]), "inner"))
    some = (F.col("_expected") > F.col("_whole")) & (under_first() | under_second())
    return ranked.select("doc", F.col("_size").alias("size"), F.col("_total").alias("total"), F.col("_target").alias("target"), (F.col("_whole") + some.cast("long")).alias("copies"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its source's target and the words the mix takes."""
    out = mix(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"), carry=["doc_id"])
    return out.select("doc.doc_id", "size", F.col("total").alias("source_size"), "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mixed_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents of the mix, as often as it takes them. A partition's second copies follow all its first ones, so copies aren't neighbours."""
    out = mix(spark, docs).where("copies > 0")
    copies = out.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return unboxed(copies.sortWithinPartitions("copy").select("doc"))


# The same decisions with every source sorted by rank. All sums are of whole numbers and sixteenths, so they are exact in any order.
OP2_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, (CAST(CAST('0x' || substr(md5('11:' || CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496 AS u FROM documents
), k AS (SELECT *, CASE WHEN size > 0 THEN length(bin(size)) ELSE 0 END AS kind FROM d),
w AS (SELECT source, CAST(sum(size) AS BIGINT) AS total, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight FROM k GROUP BY source),
r AS (
  SELECT CAST(0 AS DOUBLE) AS unit, 0 AS n
  UNION ALL
  SELECT better, n + 1 FROM (SELECT r.unit, r.n, ((SELECT CAST(sum(total) AS DOUBLE) FROM w) - (SELECT coalesce(sum(CASE WHEN total * CAST(3 AS DOUBLE) <= weight * r.unit THEN total * CAST(3 AS DOUBLE) ELSE 0 END), 0) FROM w)) / nullif((SELECT sum(CASE WHEN total * CAST(3 AS DOUBLE) <= weight * r.unit THEN 0 ELSE weight END) FROM w), 0) AS better FROM r) WHERE better > unit * (1 + 1e-12)
), t AS (SELECT source, total, least(total * CAST(3 AS DOUBLE), weight * (SELECT max(unit) FROM r)) AS target FROM w),
c AS (SELECT source, kind, CAST(sum(size) AS DOUBLE) AS words, kind / CAST(16 AS DOUBLE) + 1 AS g FROM k GROUP BY source, kind),
v AS (
  SELECT c.source, target, g, coalesce(sum(words) OVER (PARTITION BY c.source ORDER BY g DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above, sum(words * g) OVER (PARTITION BY c.source ORDER BY g DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest,
    min(g) OVER (PARTITION BY c.source) AS least_g, row_number() OVER (PARTITION BY c.source ORDER BY g DESC) AS i FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source
), s AS (SELECT *, CASE WHEN rest > 0 THEN (target - 3 * above) / rest ELSE 3 / g END AS rate FROM v),
o AS (SELECT source, coalesce(min_by(rate, i) FILTER (rate * g <= 3), max_by(rate, i)) AS rate, min(least_g) AS least_g FROM s GROUP BY source),
e AS (SELECT k.*, least(CAST(3 AS DOUBLE), least(greatest(o.rate, 0), 3 / o.least_g) * (kind / CAST(16 AS DOUBLE) + 1)) AS want FROM k JOIN o ON k.source IS NOT DISTINCT FROM o.source),
p AS (SELECT *, CAST(floor(want) AS BIGINT) AS whole, want - floor(want) AS p FROM e),
x AS (SELECT *, want > whole AS open_, CAST(least(floor(u * (1 - p) / (u * (1 - p) + p * (1 - u)) * 4503599627370496), 4503599627370495) AS BIGINT) AS place FROM p),
f AS (SELECT t.source, t.total, t.target, greatest(0, t.target - sum(x.whole * x.size)) AS rest FROM t JOIN x ON t.source IS NOT DISTINCT FROM x.source GROUP BY t.source, t.total, t.target),
a AS (SELECT x.*, f.total, f.target, f.rest, sum(CASE WHEN open_ THEN size ELSE 0 END) OVER (PARTITION BY x.source ORDER BY place) AS run FROM x JOIN f ON x.source IS NOT DISTINCT FROM f.source),
b AS (SELECT *, open_ AND run <= rest AS one, rest - coalesce(max(CASE WHEN open_ AND run <= rest THEN run END) OVER (PARTITION BY source), 0) AS left_ FROM a),
h AS (SELECT *, open_ AND NOT one AND size <= left_ / 4 AS fits FROM b),
j AS (SELECT *, sum(CASE WHEN fits THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY place) AS run2, sum(CASE WHEN fits THEN size ELSE 0 END) OVER (PARTITION BY source, place) AS same FROM h),
l AS (SELECT *, min(CASE WHEN fits AND run2 > left_ THEN place END) OVER (PARTITION BY source) AS cut FROM j)
SELECT doc_id, size, total AS source_size, target, (whole + CASE WHEN one OR (fits AND (cut IS NULL OR place < cut OR (place = cut AND (left_ - (run2 - same)) * 2 >= same))) THEN 1 ELSE 0 END) * size AS taken,
  whole + CASE WHEN one OR (fits AND (cut IS NULL OR place < cut OR (place = cut AND (left_ - (run2 - same)) * 2 >= same))) THEN 1 ELSE 0 END AS copies FROM l
"""
