"""Near-duplicates: MinHash bands, odd sketches, exact verification, components.

1. Every text's set of five-word shingles gives a 128-bit fingerprint, 32 band
   keys of four MinHash values each, and an odd sketch: the 128 values folded
   into a bitmap of 512 parities. Texts of equal fingerprint are one class from
   here on.
2. In each band bucket every class is paired with the bucket's first one. Pairs
   whose sketches' XOR has too many bits are dropped: its population count
   estimates high similarities closely. The rest are confirmed on full sets.
3. Components of the confirmed links. A bucket whose classes all lie in one
   component needs no more pairs, however large it is. In the others, classes
   outside the largest component are compared with all of other components:
   those with a partner that the sketches allow are read again, block by block,
   and their whole sets compared there. What leaves a block is no more than the
   links that tie its components together.
4. Components again, now of all links.

A pair of similarity 0.75 shares no band with a chance of 5e-6; the sketch
drops one with a chance of about 1e-5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quire.llm.common import SpanHasher, bucketed, byte_class, chunks, column_of, drop_tables, mixed, numbered, prepare, table, text_bytes, word_spans
from quire.llm.components import components

SHINGLE = 5
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
SKETCH = 512  # bits
SIMILAR = 0.75
PLAUSIBLE = 0.45  # estimated similarity under which a pair of 0.75 hardly falls
PAIRS = 256  # of a bucket's size, that share a copy of its first text, about
SIDE, PER_ROOT = 1024, 8  # classes of a block, or for each unit of the root of its bucket's size
MOST_INSIDE = 1 << 16  # classes of a block inside the largest component
BLOCK_SHINGLES = 4 << 20  # of a block, about, at most
TILE, TILE_ROWS = 8 << 20, 1024  # bytes and number of texts whose sets are compared at once

WORD = byte_class(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))

SIGNED = "n_shingles bigint, fp1 bigint, fp2 bigint, bands array<bigint>, sketch array<bigint>"


def shingles(buf: np.ndarray, off: np.ndarray, hasher: SpanHasher) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of each text, repeats included, and the n + 1 offsets."""
    start, end, per = word_spans(buf, off, WORD)
    words = hasher(buf, start, end)
    count = np.diff(per)
    many = np.where(count >= SHINGLE, count - SHINGLE + 1, np.minimum(count, 1))
    at = np.concatenate([[0], np.cumsum(many)])
    if not len(words):
        return np.zeros(0, np.uint64), at
    first = np.repeat(per[:-1] - at[:-1], many) + np.arange(at[-1])
    # Words past the end of a short text are left out of its only shingle.
    stop = np.repeat(per[1:], many)
    h = np.zeros(at[-1], np.uint64)
    for k in range(SHINGLE):
        i = first + k
        w = np.where(i < stop, words[np.minimum(i, len(words) - 1)], np.uint64(0))
        h = h * np.uint64(0x9E3779B97F4A7C15) + w
    return mixed(h), at


def distinct_sets(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's hashes once, in order."""
    parts, sizes = [], np.zeros(len(at) - 1, np.int64)
    for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
        if b > a:
            s = np.sort(h[a:b])
            s = s[np.concatenate([[True], s[1:] != s[:-1]])]
            sizes[i] = len(s)
            parts.append(s)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(sizes)])


def minhash(sets: np.ndarray, at: np.ndarray, seed: int = 5) -> np.ndarray:
    """(texts, HASHES) smallest values; texts must have shingles."""
    rng = np.random.default_rng(seed)
    mult, add = rng.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)
    x, out = (sets >> np.uint64(32)).astype(np.uint32), np.empty((len(at) - 1, HASHES), np.uint32)
    for a, b in chunks(at, 1 << 14):  # pieces that stay in the cache
        piece, where = x[at[a] : at[b]], at[a:b] - at[a]
        for k in range(HASHES):
            out[a:b, k] = np.minimum.reduceat(piece * mult[k] + add[k], where)
    return out


def band_keys(low: np.ndarray) -> np.ndarray:
    keys = np.empty((len(low), BANDS), np.uint64)
    for i in range(BANDS):
        h = np.full(len(low), i + 1, np.uint64)
        for k in range(ROWS):
            h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + low[:, ROWS * i + k].astype(np.uint64))
        keys[:, i] = h
    return keys


def odd_sketch(low: np.ndarray) -> np.ndarray:
    """Parities of how many of a text's values fall on each bit, as 64-bit words."""
    salt = np.arange(HASHES, dtype=np.uint64) << np.uint64(32)
    bit = (mixed(low.astype(np.uint64) | salt) % np.uint64(SKETCH)).astype(np.int64)
    flat = (np.arange(len(low))[:, None] * SKETCH + bit).ravel()
    odd = (np.bincount(flat, minlength=len(low) * SKETCH) & 1).astype(np.uint8).reshape(len(low), SKETCH)
    return np.packbits(odd, axis=1, bitorder="little").view(np.int64)


def most_bits(similarity: float) -> int:
    """Bits of the XOR of two sketches at which the estimate is this similarity."""
    return int(SKETCH / 2 * (1 - np.exp(-(1 - similarity) * 4 * HASHES / SKETCH)))


def lists(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel()))


def signed(b: pa.RecordBatch, place: int, hasher: SpanHasher) -> Iterator[pa.RecordBatch]:
    """n_shingles, fingerprint, bands and sketch of each text; null fingerprint, no bands where there are no shingles."""
    buf, off = text_bytes(b.column(place))
    for i, j in chunks(off):
        sets, at = distinct_sets(*shingles(buf[off[i] : off[j]], off[i : j + 1] - off[i], hasher))
        size = np.diff(at)
        full = np.flatnonzero(size)
        one, two = np.zeros(j - i, np.int64), np.zeros(j - i, np.int64)
        bands, sketch = np.zeros((j - i, BANDS), np.int64), np.zeros((j - i, SKETCH // 64), np.int64)
        if len(full):
            where = at[:-1][full]
            low = minhash(sets, np.append(where, at[-1]))
            one[full] = np.add.reduceat(sets, where).view(np.int64)
            two[full] = np.bitwise_xor.reduceat(mixed(sets + np.uint64(1)), where).view(np.int64)
            bands[full], sketch[full] = band_keys(low).view(np.int64), odd_sketch(low)
        none = size == 0
        cols = [pa.array(size), pa.array(one, mask=none), pa.array(two, mask=none), lists(bands), lists(sketch)]
        yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in b.columns), *cols], names=[*b.schema.names, *(x.split()[0] for x in SIGNED.split(", "))])


def sign(spark: SparkSession, docs: DataFrame, key: str, text: str) -> DataFrame:
    """Writes (row, id, text, doc, signature): row numbers the rows, so repeated ids stay apart; doc holds all columns but the text."""
    prepare(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SpanHasher()
        for pid, seen, b in numbered(batches):
            row = pa.array((pid << 40) + seen + np.arange(b.num_rows, dtype=np.int64))
            yield from signed(pa.RecordBatch.from_arrays([row, *b.columns], names=["row", "id", "text", "doc"]), 2, hasher)

    rest = [column_of(docs, c) for c in docs.columns if c != text]
    plain = docs.select(column_of(docs, key).alias("id"), column_of(docs, text).alias("text"), F.struct(*rest).alias("doc"))
    kinds = [*StructType.fromDDL("row bigint").fields, *plain.schema.fields, *StructType.fromDDL(SIGNED).fields]
    return table(spark, plain.mapInArrow(run, StructType(kinds)), "signatures")


def xor_bits() -> Column:
    parts = [F.bit_count(F.col("s1")[k].bitwiseXOR(F.col("s2")[k])) for k in range(SKETCH // 64)]
    return sum(parts[1:], parts[0])


def star_pairs(members: DataFrame) -> DataFrame:
    """(a, b, salt): every class of a bucket with the bucket's first. A leader's pairs are spread over its salts, PAIRS of a bucket to each, about."""
    return members.where("a <> b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int").alias("salt")).distinct()


def salted(rows: DataFrame, leaders: DataFrame) -> DataFrame:
    """rows, which have a column b, once for each salt of that leader."""
    return rows.join(leaders, "b").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")


def plausible(pairs: DataFrame, sketches: DataFrame, leaders: DataFrame) -> DataFrame:
    """Pairs (a, b, salt) of classes whose sketches allow the similarity."""
    one, two = sketches.select(F.col("row").alias("a"), F.col("sketch").alias("s1")), sketches.select(F.col("row").alias("b"), F.col("sketch").alias("s2"))
    return pairs.join(one, "a").join(salted(two, leaders), ["b", "salt"]).where(xor_bits() <= most_bits(PLAUSIBLE)).select("a", "b", "salt")


def confirmed(spark: SparkSession, pairs: DataFrame, texts: DataFrame, leaders: DataFrame) -> DataFrame:
    """Pairs (a, b) with 100 * intersection >= 75 * union of their whole shingle sets.

    pairs has (a, b, salt): the pairs of one b are dealt out by salt, each with
    its copy of b's text. Rows come by b, whose set is kept for the next.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, last, theirs = SpanHasher(), None, np.zeros(0, np.uint64)
        for batch in batches:
            ids_b = batch.column(1).to_numpy()
            keep = np.zeros(batch.num_rows, bool)
            buf1, off1 = text_bytes(batch.column(2))
            buf2, off2 = text_bytes(batch.column(3))
            for i, j in chunks(off1):
                sets, at = distinct_sets(*shingles(buf1[off1[i] : off1[j]], off1[i : j + 1] - off1[i], hasher))
                for r in range(i, j):
                    if ids_b[r] != last:
                        own = buf2[off2[r] : off2[r + 1]]
                        theirs, last = distinct_sets(*shingles(own, np.array([0, len(own)]), hasher))[0], ids_b[r]
                    mine = sets[at[r - i] : at[r - i + 1]]
                    small, big = (mine, theirs) if len(mine) < len(theirs) else (theirs, mine)
                    if len(small) * 100 < 75 * len(big):
                        continue
                    spot = np.minimum(np.searchsorted(big, small), len(big) - 1)
                    both = int((big[spot] == small).sum())
                    keep[r] = 100 * both >= 75 * (len(small) + len(big) - both)
            yield batch.select([0, 1]).filter(pa.array(keep))

    one, two = texts.select(F.col("row").alias("a"), F.col("text").alias("t1")), texts.select(F.col("row").alias("b"), F.col("text").alias("t2"))
    rows = pairs.join(one, "a").join(salted(two, leaders), ["b", "salt"]).select("a", "b", "t1", "t2")
    return rows.mapInArrow(run, "a bigint, b bigint")


def groups_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each block pair (key, i, j), which lead the columns; rows come in their order."""
    held, now = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        marks = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(3)], 1)
        cuts = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1).tolist(), batch.num_rows]
        for x, y in zip(cuts, cuts[1:], strict=False):
            mark = tuple(marks[x].tolist())
            if mark != now and held:
                yield pa.Table.from_batches(held)
                held = []
            now = mark
            held.append(batch.slice(x, y - x))
    if held:
        yield pa.Table.from_batches(held)


def sides(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows of blocks i and j. Where they are one block, it stands on both sides."""
    left = rows.column(3).to_numpy()
    one = np.flatnonzero(left)
    return one, one if rows.column(1)[0] == rows.column(2)[0] else np.flatnonzero(~left)


def worth_reading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, i, j, left, row, component, sketch), those with a partner of another component that the sketches allow."""
    most = most_bits(PLAUSIBLE)
    for rows in groups_of(batches):
        one, two = sides(rows)
        # Unsigned words: of signed ones the bits of the absolute value would be counted.
        sketch = np.asarray(rows.column(6).combine_chunks().flatten()).view(np.uint64).reshape(rows.num_rows, -1)
        comp, keep = rows.column(5).to_numpy(), np.zeros(rows.num_rows, bool)
        theirs, their_comp = sketch[two], comp[two]
        for k in one.tolist():
            far = np.bitwise_count(theirs ^ sketch[k]).sum(1, dtype=np.int64)
            ok = (far <= most) & (their_comp != comp[k])
            if ok.any():
                keep[two[ok]] = keep[k] = True
        if keep.any():
            yield from rows.select(range(6)).filter(pa.array(keep)).to_batches()


def intersections(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of a with all of b: products of 0/1 matrices over the hashes that both have."""
    (ha, at_a), (hb, at_b) = a, b
    both = np.intersect1d(ha, hb)
    out = np.zeros((len(at_a) - 1, len(at_b) - 1), np.float32)
    entries = []
    for h, at in (a, b):
        spot = np.minimum(np.searchsorted(both, h), max(0, len(both) - 1))
        hit = both[spot] == h if len(both) else np.zeros(len(h), bool)
        row, col = np.repeat(np.arange(len(at) - 1), np.diff(at))[hit], spot[hit]
        by = np.argsort(col, kind="stable")
        entries.append((row[by], col[by]))
    width = 2048
    for start in range(0, len(both), width):
        parts = []
        for (row, col), n in zip(entries, out.shape, strict=True):
            x, y = np.searchsorted(col, [start, start + width])
            m = np.zeros((n, width), np.float32)
            m[row[x:y], col[x:y] - start] = 1
            parts.append(m)
        out += parts[0] @ parts[1].T
    return out


def exact_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, i, j, left, row, component, text), links that tie components together: whole sets of all pairs are compared, and only links that tie what this block pair hasn't tied yet are given."""
    hasher = SpanHasher()
    for rows in groups_of(batches):
        text, row, comp = rows.column(6).cast(pa.large_string()).combine_chunks(), rows.column(4).to_numpy(), rows.column(5).to_numpy()
        root: dict[int, int] = {}

        def sets_of(place: np.ndarray, text: pa.Array = text) -> tuple[np.ndarray, np.ndarray]:
            buf, off = text_bytes(text.take(pa.array(place)))
            parts = [distinct_sets(*shingles(buf[off[i] : off[j]], off[i : j + 1] - off[i], hasher)) for i, j in chunks(off)]
            return np.concatenate([h for h, _ in parts]), np.concatenate([[0], np.cumsum(np.concatenate([np.diff(at) for _, at in parts]))])

        def tiles(place: np.ndarray, text: pa.Array = text) -> list[np.ndarray]:
            off = text_bytes(text.take(pa.array(place)))[1]
            return [place[k : min(j, k + TILE_ROWS)] for i, j in chunks(off, TILE) for k in range(i, j, TILE_ROWS)]

        def find(x: int, root: dict[int, int] = root) -> int:
            while (up := root.get(x, x)) != x:
                root[x] = x = root.get(up, up)
            return x

        found = []
        one, two = sides(rows)
        for x in tiles(one):
            own = sets_of(x)
            for y in tiles(two):
                other = own if y is x else sets_of(y)
                both = intersections(own, other)
                union = np.diff(own[1])[:, None] + np.diff(other[1])[None, :] - both
                near = (100 * both >= 75 * union) & (both > 0) & (comp[x][:, None] != comp[y][None, :])
                for p, q in np.argwhere(near).tolist():
                    c, d = find(int(comp[x[p]])), find(int(comp[y[q]]))
                    if c != d:
                        root[max(c, d)] = min(c, d)
                        found.append(sorted((int(row[x[p]]), int(row[y[q]])), reverse=True))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])


def open_links(spark: SparkSession, members: DataFrame, reps: DataFrame, texts: DataFrame, links: DataFrame) -> DataFrame:
    """Links (a, b) between different components of links, from the buckets whose classes lie in several of them.

    In such a bucket the classes outside its largest component meet all others;
    those inside it meet only these. Classes are compared block by block. A block
    of classes outside has `side` of them, 1,024 or 8 * sqrt(n), fewer where their
    sets are large, and one of classes inside as many as make side * side pairs:
    so a few outsiders are copied once or twice, and no class more than sqrt(n) / 8
    times in buckets of over 16,384.
    """
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    comp = components(spark, links, rounds=2)  # classes that are still apart are only compared once more
    own = members.where("n > 2").join(comp, F.col("a") == F.col("id"), "left").select("key", "a", F.coalesce("component", "a").alias("component"))
    labelled = table(spark, own.join(reps.select(F.col("row").alias("a"), "n_shingles"), "a"), "open")
    parts_ = labelled.groupBy("key", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("size"))
    whole = parts_.groupBy("key").agg(F.sum("n").alias("n"), F.sum("size").alias("size"), F.count("*").alias("parts"), F.max(F.struct("n", "component")).alias("top")).where("parts > 1")
    side = F.greatest(F.lit(1.0), F.least(F.greatest(F.lit(float(SIDE)), PER_ROOT * F.sqrt("n")), F.col("n") * float(BLOCK_SHINGLES) / F.col("size")))
    outside = (F.col("n") - F.col("top.n")).cast("double")
    keys = whole.select("key", F.col("top.component").alias("top"), F.col("top.n").alias("k"), outside.alias("m"), side.alias("side")).withColumn("few", F.ceil(F.col("m") / F.col("side")).cast("int"))
    wide = F.least(F.col("side") * F.col("side") * F.col("few") / F.col("m"), F.lit(float(MOST_INSIDE)))
    keys = keys.select("key", "top", "few", F.ceil(F.col("k") / wide).cast("int").alias("many"))
    rows = labelled.join(keys, "key").withColumn("inside", F.col("component") == F.col("top"))
    hashed = F.xxhash64(F.lit(3), "a")
    rows = rows.withColumn("own", F.when(F.col("inside"), F.col("few") + F.pmod(hashed, F.col("many"))).otherwise(F.pmod(hashed, F.col("few"))).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("inside"), F.col("few")).otherwise(F.col("few") + F.col("many")) - 1)))
    rows = rows.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") <= F.col("other")).alias("left"), F.col("a").alias("row"), "component")
    drawn = rows.join(reps.select("row", "sketch"), "row").select("key", "i", "j", "left", "row", "component", "sketch")
    dealt = drawn.repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j")
    read = dealt.mapInArrow(worth_reading, "key bigint, i int, j int, left boolean, row bigint, component bigint")
    whole_texts = read.join(texts, "row").select("key", "i", "j", "left", "row", "component", "text")
    found = whole_texts.repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(exact_links, "a bigint, b bigint").distinct()
    found = table(spark, found, "links")
    drop_tables(spark, labelled, comp)
    return found


def classes_and_links(spark: SparkSession, signs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fp1, fp2, n_shingles, class, low) of each class of equal sets, low its smallest id; and confirmed links (a, b) between classes.

    No step deals rows by band key or by leader alone except joins and partial
    aggregates, which Spark can split: a bucket may hold any share of the classes.
    """
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    same = ["fp1", "fp2", "n_shingles"]
    groups = table(spark, signs.where("n_shingles > 0").groupBy(*same).agg(F.min("row").alias("class"), F.min("id").alias("low")), "classes")
    first = signs.join(groups.select(F.col("class").alias("row")), "row", "left_semi")
    reps = table(spark, first.select("row", "n_shingles", "bands", "sketch"), "sketches")
    buckets = reps.select("row", F.explode("bands").alias("key"))
    shared = table(spark, buckets.groupBy("key").agg(F.min("row").alias("b"), F.count("*").alias("n")).where("n > 1"), "shared")
    # A class that leads several buckets has salts for the largest of them.
    leaders = table(spark, shared.groupBy("b").agg(F.ceil(F.max("n") / PAIRS).cast("int").alias("salts")), "leaders")
    members = table(spark, buckets.join(shared.join(leaders, "b"), "key").select("key", F.col("row").alias("a"), "b", "n", "salts"), "buckets")
    # Verification reads texts by row many times: those that share a bucket are dealt out once and stay so.
    shared_rows = members.select(F.col("a").alias("row")).distinct()
    dealt = signs.where("n_shingles > 0").select("row", "text").repartition(n, "row").join(shared_rows, "row", "left_semi")
    with bucketed(spark, dealt, "texts", "row", n) as texts:
        star = plausible(star_pairs(members), reps, leaders)
        links = table(spark, confirmed(spark, star, texts, leaders), "links")
        links = links.unionByName(open_links(spark, members, reps, texts, links))
    drop_tables(spark, reps, shared, leaders, members)
    return groups, links


def near_duplicates(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, id, text, doc, n_shingles, component, group) for each row: component is the smallest id of its group, doc its other columns.

    group numbers the groups themselves, which may share a smallest id or have
    none; it is null where there are no shingles.

    Null texts and texts without words have no shingles and stay alone. Rows of
    one id and different texts are different rows; a null id counts for nothing
    in a group's smallest id, which is null where all are. An empty table gives
    an empty result; columns of any name are carried along unread.
    """
    return with_components(spark, sign(spark, docs, key, text))


def with_components(spark: SparkSession, signs: DataFrame) -> DataFrame:
    groups, links = classes_and_links(spark, signs)
    comp = components(spark, links)
    labelled = groups.join(comp, F.col("class") == F.col("id"), "left").select("fp1", "fp2", "n_shingles", "low", "class", F.coalesce("component", "class").alias("c"))
    lows = labelled.groupBy("c").agg(F.min("low").alias("component"))
    by_set = table(spark, labelled.join(lows, "c").select("fp1", "fp2", F.col("n_shingles").alias("m"), "component", F.col("c").alias("group")), "components")
    drop_tables(spark, groups, links, comp)
    rows = signs.select("row", "id", "text", "doc", "n_shingles", "fp1", "fp2")
    on = (rows["fp1"] == by_set["fp1"]) & (rows["fp2"] == by_set["fp2"]) & (rows["n_shingles"] == by_set["m"])
    return rows.join(by_set, on, "left").select("row", "id", "text", "doc", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("id")).alias("component"), "group")


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component of near-duplicates."""
    out = near_duplicates(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group, the first of its smallest id. Rows without shingles all stay. Columns of any name are carried along."""
    signs = sign(spark, docs, key, text)
    out = with_components(spark, signs).select("row", "id", "n_shingles", "component", "group")
    first = out.where(F.col("id").eqNullSafe(F.col("component")) & (F.col("n_shingles") > 0)).groupBy("group").agg(F.min("row").alias("row")).select("row")
    keep = signs.select("row", "text", "doc").join(first.unionByName(signs.where("n_shingles = 0").select("row")), "row", "left_semi")
    return keep.select(*(F.col("text").alias(c) if c == text else F.col("doc").getField(c).alias(c) for c in docs.columns))


OP7_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[k : k + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS k FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 75 * (x.n + y.n - c)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT l.b, r.c FROM r JOIN l ON r.doc_id = l.a),
k AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT k.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, k.doc_id = component_id AS kept FROM k LEFT JOIN n ON k.doc_id = n.doc_id
"""
