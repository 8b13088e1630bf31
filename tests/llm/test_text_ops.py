"""Operators on texts against plain code: near-duplicates, phrases, toxicity, languages."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.llm import common, dedup, language, phrases, toxicity
from quire.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", "s", None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(rows):
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both, union = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if sets[a] and 100 * both >= 75 * union and root(a) != root(b):
                parent[root(a)] = root(b)
    low = {}
    for i in range(len(rows)):
        low[root(i)] = min(low.get(root(i), rows[i][0]), rows[i][0])
    return sorted((rows[i][0], len(sets[i]), low[root(i)]) for i in range(len(rows)))


def near_corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(4))
    base = [[word() for _ in range(rng.choice([1, 3, 5, 8, 40, 120]))] for _ in range(40)]
    texts = [" ".join(b) for b in base]
    hub = [word() for _ in range(100)]
    for _ in range(150):  # a large group whose members differ in places of their own
        own = list(hub)
        for _ in range(rng.randint(1, 3)):
            own[rng.randrange(len(own))] = word()
        texts.append(" ".join(own))
    texts += [texts[7]] * 20 + [texts[8].upper(), texts[9] + " tail", "", None, "  \t ", "x", "X", "one two three four"]
    rng.shuffle(texts)
    return texts


def test_near_duplicates_equal_brute_force(spark):
    texts = near_corpus()
    rows = list(enumerate(texts))
    out = dedup.near_duplicates(spark, documents(spark, texts).repartition(5)).select("id", "n_shingles", "component").collect()
    assert sorted(map(tuple, out)) == brute_components(rows)
    kept = dedup.without_near_duplicates(spark, documents(spark, texts))
    assert kept.columns == [c.split()[0] for c in DOCS.split(", ")]
    want = {c for i, n, c in brute_components(rows)}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)


def test_near_duplicates_with_repeated_and_null_ids(spark):
    texts = ["a b c d e f g"] * 3 + ["h i j k l m"] * 2
    ids = [4, 4, None, 9, 9]
    out = dedup.near_duplicates(spark, documents(spark, texts, ids)).select("id", "component").collect()
    assert sorted(((r.id or -1), r.component) for r in out) == [(-1, 4), (4, 4), (4, 4), (9, 9), (9, 9)]
    assert sorted(r.doc_id for r in dedup.without_near_duplicates(spark, documents(spark, texts, ids)).collect()) == [4, 9]
    assert dedup.near_duplicates(spark, documents(spark, ["x"]).where("doc_id > 5")).count() == 0


def test_unlike_texts_of_one_or_no_id_all_stay(spark):
    a, b, c, d, e, f = ("a b c d e f g", "h i j k l m n", "o p q r s t u", "v w x y z a b", "1 2 3 4 5 6 7", "8 9 1 8 9 1 8")
    rows = [(None, a), (None, b), (None, b), (5, c), (5, c), (5, d), (6, d), (7, e), (None, e), (None, None), (None, ""), (8, f)]
    kept = dedup.without_near_duplicates(spark, documents(spark, [t for _, t in rows], [i for i, _ in rows]).repartition(3)).collect()
    want = [(None, a), (None, b), (5, c), (5, d), (7, e), (8, f), (None, None), (None, "")]
    assert sorted(((r.doc_id, r.text) for r in kept), key=repr) == sorted(want, key=repr)


def test_near_duplicates_carry_clashing_columns(spark):
    df = documents(spark, ["a b", "a b"]).withColumns({"row": F.lit(1), "id": F.lit("q"), "component": F.lit(2.5)})
    (r,) = dedup.without_near_duplicates(spark, df).collect()
    assert (r.doc_id, r.row, r.id, r.component, r.text) == (0, 1, "q", 2.5, "a b")


def test_bucket_blocks_find_links_between_blocks(spark, monkeypatch):
    monkeypatch.setattr(dedup, "SIDE", 5)
    monkeypatch.setattr(dedup, "PER_ROOT", 1)
    monkeypatch.setattr(dedup, "TILE_ROWS", 3)
    monkeypatch.setattr(dedup, "MOST_INSIDE", 7)
    monkeypatch.setattr(dedup, "PAIRS", 3)
    monkeypatch.setattr(dedup, "TILE", 2000)
    texts = near_corpus()
    out = dedup.near_duplicates(spark, documents(spark, texts)).select("id", "n_shingles", "component").collect()
    assert sorted(map(tuple, out)) == brute_components(list(enumerate(texts)))


def family(rng, n, common, own):
    """Texts that share most words: one bucket of one band holds a large part of them."""
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    base = [word() for _ in range(common)]
    return [" ".join([*base[:k], *(word() for _ in range(own)), *base[k:]]) for k in (rng.randrange(common) for _ in range(n))]


def test_no_task_holds_a_hot_bucket(spark, monkeypatch):
    """A cluster of near copies, and a family too far apart to be one: no leader's pairs and no pair of blocks are many."""
    rng, seen = random.Random(11), {}
    monkeypatch.setattr(dedup, "SIDE", 64)
    monkeypatch.setattr(dedup, "PAIRS", 64)
    monkeypatch.setattr(dedup, "PER_ROOT", 2)
    close, far = family(rng, 1500, 150, 1), family(rng, 800, 60, 7)
    real, original, groups_of = dedup.star_pairs, dedup.worth_reading, dedup.groups_of

    def pairs(members):
        out = common.table(spark, real(members), "pairs")
        rows = out.groupBy("b", "salt").count().agg(F.max("count"), F.sum("count")).first()
        seen["pairs"] = (rows[0], rows[1])
        return out

    def counted(batches):
        for rows in groups_of(batches):
            assert rows.num_rows <= 64 * 64 + 2 * 64 * 2
            yield from original(iter(rows.to_batches()))

    monkeypatch.setattr(dedup, "star_pairs", pairs)
    monkeypatch.setattr(dedup, "worth_reading", counted)
    texts = close + far
    out = dedup.near_duplicates(spark, documents(spark, texts)).select("id", "component").collect()
    groups = Counter(r.component for r in out)
    assert groups[0] >= 1495 and seen["pairs"][1] > 3000 and seen["pairs"][0] < 400
    sets = [shingle_set(t) for t in far]
    comp = {r.id: r.component for r in out}
    for x in range(0, len(far), 40):
        for y in range(len(far)):
            both = len(sets[x] & sets[y])
            if 100 * both >= 75 * (len(sets[x]) + len(sets[y]) - both):
                assert comp[1500 + x] == comp[1500 + y]


def test_recall_on_a_real_table(spark):
    """Of every tenth document all links to any other end in one component."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    comp = {r.id: r.component for r in dedup.near_duplicates(spark, documents(spark, [t for _, t in rows], [i for i, _ in rows])).select("id", "component").collect()}
    sets = [shingle_set(t) for _, t in rows]
    links = lost = 0
    for x in range(0, len(rows), 10):
        for y in range(len(rows)):
            if x != y and sets[x] and sets[y] and 4 * min(len(sets[x]), len(sets[y])) >= 3 * max(len(sets[x]), len(sets[y])):
                both = len(sets[x] & sets[y])
                if 100 * both >= 75 * (len(sets[x]) + len(sets[y]) - both):
                    links += 1
                    lost += comp[rows[x][0]] != comp[rows[y][0]]
    assert links > 10 and not lost


def test_odd_sketch_estimates_high_similarity():
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(30):
        both, own = rng.integers(0, 2**63, 800, dtype=np.uint64), rng.integers(0, 2**63, (2, 50), dtype=np.uint64)
        low = dedup.minhash(np.concatenate([both, own[0], both, own[1]]), np.array([0, 850, 1700]))
        s = dedup.odd_sketch(low)
        bits = int(np.bitwise_count((s[0] ^ s[1]).view(np.uint64)).sum())
        errors.append(1 + dedup.SKETCH / (4 * dedup.HASHES) * np.log(1 - 2 * bits / dedup.SKETCH) - 800 / 900)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, k) for k in range(101, 140)] + [(200, 200), (300, 299), (299, 300)]
    got = {r.id: r.component for r in components(spark, spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(1, 31)}, **{k: 100 for k in range(101, 140)}, 300: 299}
    assert components(spark, spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# --- phrases -------------------------------------------------------------------

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_phrases(docs, items, window=10):
    wins = {}
    for item, text in items:
        w = WORDS.findall((text or "").translate(LOWER))
        for k in range(max(1, len(w) - window + 1) if w else 0):
            wins.setdefault(tuple(w[k : k + window]), set()).add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        w, hit, found = WORDS.findall((text or "").translate(LOWER)), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if own := wins.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= own
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def phrase_corpus():
    rng = random.Random(3)
    word = lambda: rng.choice("the of a Be é ü1 x y zz".split())
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([0, 1, 2, 9, 10, 11, 30, 14])] + [(7, "the of, THE of"), (None, "zz zz zz"), (50, None), (51, "!?")]
    docs = [" ".join(word() for _ in range(rng.choice([0, 1, 5, 60, 400]))) for _ in range(60)]
    docs += [docs[5] + " " + (items[6][1] or "") + " tail", (items[7][1] or "").upper().replace(" ", "-"), items[6][1][:-1], "", None, "the the the the"]
    return list(enumerate(docs)), items


def test_phrases_equal_brute_force(spark, monkeypatch):
    docs, items = phrase_corpus()
    df, it = documents(spark, [t for _, t in docs]), spark.createDataFrame(items, "item_id bigint, text string")
    index = phrases.build_index(spark, df, F.col("doc_id"), F.col("text"))
    want = brute_phrases(docs, items)
    assert sorted(map(tuple, phrases.digest(phrases.search(spark, index, it)).collect())) == want
    monkeypatch.setattr(phrases, "QUERY_BYTES", 100)  # many blocks of phrases
    assert sorted(map(tuple, phrases.digest(phrases.search(spark, index, it)).collect())) == want
    monkeypatch.setattr(phrases, "SEGMENT_BYTES", 200)
    index = phrases.build_index(spark, df, F.col("doc_id"), F.col("text"))
    assert sorted(map(tuple, phrases.digest(phrases.search(spark, index, it)).collect())) == want
    clean = phrases.without_benchmark(spark, df, it)
    assert clean.columns == df.columns
    assert sorted(r.doc_id for r in clean.collect()) == sorted(w[0] for w in want if not w[5])


def test_blocks_of_phrases_keep_texts_of_one_key_apart(spark, monkeypatch):
    monkeypatch.setattr(phrases, "QUERY_BYTES", 20)
    docs = [(1, "a b c d"), (1, "a b x x"), (1, "x x x x"), (None, "x x c d"), (None, "x x x x"), (None, "x x x x"), (1, "x x x x")]
    items = [(1, "a b"), (2, "c d")]
    df, it = documents(spark, [t for _, t in docs], [i for i, _ in docs]), spark.createDataFrame(items, "item_id bigint, text string")
    out = phrases.digest(phrases.search(spark, phrases.build_index(spark, df, F.col("doc_id"), F.col("text")), it)).collect()
    want = [brute_phrases([d], items)[0] for d in docs]
    assert sorted(map(tuple, out), key=repr) == sorted(want, key=repr)


def test_phrases_of_nothing(spark):
    df = documents(spark, ["a b c"])
    none = spark.createDataFrame([], "item_id bigint, text string")
    index = phrases.build_index(spark, df, F.col("doc_id"), F.col("text"))
    assert [tuple(r)[:4] for r in phrases.digest(phrases.search(spark, index, none)).collect()] == [(0, 3, 0, 0)]
    assert phrases.search(spark, phrases.build_index(spark, df.where("doc_id > 1"), F.col("doc_id"), F.col("text")), none).count() == 0


def test_proximity(spark):
    texts = ["red x x blue x green", "green blue red", "red blue " + "x " * 9 + "green", "red red blue", None]
    index = phrases.build_index(spark, documents(spark, texts), F.col("doc_id"), F.col("text"))
    items = spark.createDataFrame([(1, "blue green red")], "item_id bigint, text string")
    hit = lambda within: {r.key for r in phrases.search(spark, index, items, window=3, within=within).collect() if r.spans}
    assert hit(3) == {1} and hit(6) == {0, 1} and hit(12) == {0, 1, 2}
    with pytest.raises(ValueError, match="within"):
        phrases.search(spark, index, items, window=3, within=2)


def brute_near(words, item, within):
    """Words in the smallest spans that hold an item's words, as often as the item does."""
    need, spans = Counter(item), []
    for a in range(len(words)):
        for b in range(a + 1, min(len(words), a + within) + 1):
            if not need - Counter(words[a:b]):
                spans.append((a, b))
                break
    spans = [(a, b) for a, b in spans if not any((c, d) != (a, b) and a <= c and d <= b for c, d in spans)]
    return {k for a, b in spans for k in range(a, b)}


def test_proximity_equals_brute_force(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abcdx") for _ in range(rng.choice([0, 2, 8, 40]))) for _ in range(50)] + ["a b x x x x"]
    items = [(k, " ".join(rng.choice("abcd") for _ in range(n))) for k, n in enumerate([1, 2, 3, 3, 4])] + [(9, "a b")]
    index = phrases.build_index(spark, documents(spark, texts), F.col("doc_id"), F.col("text"))
    table = spark.createDataFrame(items, "item_id bigint, text string")
    for within in (4, 6, 9):
        for r in phrases.search(spark, index, table, window=4, within=within).collect():
            words = texts[r.key].split()
            want = {str(i): brute_near(words, t.split(), within) for i, t in items}
            assert {k for a, b in r.spans for k in range(a, b)} == set().union(*want.values())
            assert sorted(r["items"]) == sorted(i for i, hit in want.items() if hit)
    one = phrases.search(spark, index, table.where("item_id = 9"), window=4, within=6).where("key = 50").first()
    assert one.spans == [[0, 2]]


# --- toxicity and languages ------------------------------------------------------


def test_machine_learns_an_interaction_that_linear_weights_cannot(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(1500):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        w = [rng.choice(["tree", "house", "river", "stone", "cloud"]) for _ in range(6)] + ["idiots"] * a + ["neighbours"] * b
        rng.shuffle(w)
        rows.append(" ".join(w))
        labels.append((i, 1, int(a and b)))
    docs = documents(spark, rows)
    lab = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    m = toxicity.train(spark, toxicity.learnable(docs), toxicity.learnable(lab))
    out = {r.doc.doc_id: r.score for r in toxicity.score(spark, docs.where(common.crc_mod(F.col("doc_id"), 5) == 0), m).collect()}
    right = np.mean([(s >= 0.5) == labels[i][2] for i, s in out.items()])
    assert len(out) > 200 and right > 0.97


def test_sample_of_a_machine(spark, monkeypatch):
    n, seen = 20_100, []
    monkeypatch.setattr(toxicity, "fit", lambda known, share, term, many, label: seen.append((len(label), len(many), len(term), len(known))))
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("some words").alias("text"))
    labels = lambda most: docs.where(F.col("doc_id") < most).select("doc_id", (F.col("doc_id") % 2).alias("toxic"))
    for most in (19_000, n):
        toxicity.train(spark, docs, labels(most))
    assert [x[:2] for x in seen] == [(19_000, 19_000), (20_000, 20_000)]
    terms = seen[0][3]
    toxicity.train(spark, docs, labels(n), most_slots=100 * (terms + 1))
    toxicity.train(spark, docs, labels(n), most_terms=terms - 2)
    assert seen[2][0] == 100 and seen[3][2:] == (20_000 * (terms - 2), terms - 2)
    one = docs.withColumn("doc_id", F.lit(1).cast("bigint"))  # a label that all texts share
    toxicity.train(spark, one, labels(n), most=500)
    assert seen[4][0] <= 500


def test_greater_bounds_only_add(spark):
    rng = random.Random(4)
    docs = documents(spark, [" ".join(f"w{rng.randrange(60)}" for _ in range(12)) for _ in range(400)])
    labels = docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    bags = common.table(spark, toxicity.labelled_sample(docs, labels, 10**6).mapInArrow(toxicity.bag, "order bigint, label int, terms array<int>"), "bags")
    few, many = (set(toxicity.informative(bags, n)[0].tolist()) for n in (20, 50))
    assert len(few) == 20 and len(many) == 50 and few < many
    counts = Counter((t, r.label) for r in bags.collect() for t in r.terms)
    share = sum(r.label for r in bags.collect()) / 400
    n = {t: counts[t, 0] + counts[t, 1] for t, _ in counts}
    far = sorted((t for t in n if n[t] >= toxicity.MIN_TEXTS), key=lambda t: (-abs(counts[t, 1] - n[t] * share) / (n[t] * share * (1 - share)) ** 0.5, t))
    assert set(far[:20]) == few


def test_scores_of_odd_rows_and_untrained_machines(spark):
    docs = documents(spark, ["", None, "a " * 50_000, "x"])
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    m = toxicity.train(spark, docs, none)
    assert all(0 <= r.score <= 1 for r in toxicity.score(spark, docs, m).collect())
    assert toxicity.without_toxic(spark, docs, none).columns == docs.columns
    odd = spark.createDataFrame([(0, None, None), (1, 1, 7), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    assert toxicity.score(spark, docs, toxicity.train(spark, docs, odd)).count() == 4
    assert toxicity.score(spark, docs.where("doc_id > 9"), m).count() == 0


def test_factors_score_as_the_sum_over_pairs():
    rng = np.random.default_rng(0)
    m = toxicity.Machine(0.3, np.arange(6), rng.normal(size=6), rng.normal(size=(6, 3)))
    term = np.array([0, 2, 5])
    want = 0.3 + m.linear[term].sum() + sum(m.factors[a] @ m.factors[b] for a in term for b in term if a < b)
    got = toxicity.raw_scores(m, np.concatenate([term, [1]]), np.array([0, 3, 3, 4]))[0]
    assert np.allclose(got, [want, 0.3, 0.3 + m.linear[1]])


def test_languages(spark):
    rng = random.Random(2)
    make = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(40))
    rows = [(i, make("abcdefg" if i % 2 else "efghijk"), "aa" if i % 2 else "bb") for i in range(200)]
    docs = spark.createDataFrame([*rows, (900, "x", None)], "doc_id bigint, text string, lang string")
    f = language.learn(spark, docs)
    assert f.names == ["aa", "bb"]
    more = spark.createDataFrame([(i, make("abcdefg" if i % 2 else "efghijk")) for i in range(60)] + [(100, None), (101, "12 ,.!"), (102, "")], "doc_id bigint, text string")
    out = {r.doc.doc_id: (r.lang, r.score) for r in language.identify(spark, more, f).collect()}
    assert np.mean([out[i][0] == ("aa" if i % 2 else "bb") for i in range(60)]) > 0.98
    assert [out[i] for i in (100, 101, 102)] == [("und", 0.0)] * 3
    assert all(0 <= s <= 1 for _, s in out.values())
    empty = language.learn(spark, docs.where("lang = 'zz'"))
    assert {r.lang for r in language.identify(spark, more, empty).collect()} == {"und"}


def test_more_languages_than_a_mask_word_holds(spark):
    rng = random.Random(8)
    make = lambda k: " ".join("".join(chr(0x4E00 + 20 * k + rng.randrange(20)) for _ in range(4)) for _ in range(2)) * 20
    texts = [(k, make(k), f"l{k:03d}") for k in range(130) for _ in range(2)]
    f = language.learn(spark, spark.createDataFrame(texts, "doc_id bigint, text string, lang string"))
    assert f.names == [f"l{k:03d}" for k in range(130)]
    out = language.identify(spark, spark.createDataFrame(texts, "doc_id bigint, text string, lang string"), f).collect()
    assert [r.lang for r in out] == [r.doc.lang for r in out]


def made_filters(grams):
    word, cell, mask = [], [], []
    for k, g in enumerate(grams):
        for p in language.probes(g):
            word += [0] * len(p)
            cell += p.tolist()
            mask += [1 << k] * len(p)
    held = Counter()
    for c, m in zip(cell, mask, strict=True):
        held[c] |= m
    return language.filters([f"l{k}" for k in range(len(grams))], np.zeros(len(held), np.int64), np.array([*held]), np.array([*held.values()], np.uint64))


def test_bloom_slices_have_no_false_negatives_and_the_expected_false_positives():
    rng = np.random.default_rng(4)
    grams = [common.mixed(rng.integers(0, 2**63, 20_000, dtype=np.uint64)) for _ in range(2)]
    grams[1][:1000] = grams[0][:1000]
    f = made_filters(grams)
    assert (language.languages_of(f, grams[0][:1000]) == 3).all()  # all languages that contain an n-gram
    assert ((language.languages_of(f, grams[0]) & np.uint64(1)) == 1).all() and ((language.languages_of(f, grams[1]) & np.uint64(2)) == 2).all()
    other = common.mixed(rng.integers(0, 2**63, 200_000, dtype=np.uint64))
    rate = ((language.languages_of(f, other) & np.uint64(1)) == 1).mean()
    assert abs(rate - f.false_rate[0]) < 3e-4


def plain_grams(text):
    """4-grams of letters, runs of other characters as one space, none at the start and one at the end."""
    s = "".join(c.lower()[0] if c.isalpha() else " " for c in text) + " "
    s = re.sub(" +", " ", s).lstrip(" ")
    return [s[k : k + 4] for k in range(len(s) - 3)]


def test_languages_equal_plain_sets(spark, monkeypatch):
    """Membership, counts and decisions against sets of n-grams. Filters with few false positives; sets have none."""
    monkeypatch.setattr(language, "CELLS", 1 << 21)
    rng = random.Random(12)
    words = {k: ["".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(40)] for k, letters in (("a", "abcdeé"), ("b", "defghı"), ("c", "ghijk中"))}
    make = lambda k, n: " ".join(rng.choice(words[k] if rng.random() < 0.9 else words[rng.choice("abc")]) + rng.choice(["", ",", " 12"]) for _ in range(n))
    rows = [(i, make("abc"[i % 3], 30), "abc"[i % 3]) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    f = language.learn(spark, docs.unionByName(docs.where("lang = 'a'")))  # repeated texts count once
    counts = {k: Counter(g for _, t, lang in rows if lang == k for g in plain_grams(t)) for k in "abc"}
    counts = {k: {g: n for g, n in c.items() if n > 1} for k, c in counts.items()}
    rate = {k: {g: n / sum(c.values()) for g, n in c.items()} for k, c in counts.items()}
    top = {g: max(r.get(g, 0) for r in rate.values()) for r in rate.values() for g in r}
    member = {k: {g for g, x in r.items() if x >= language.FLOOR * top[g]} for k, r in rate.items()}
    assert f.names == ["a", "b", "c"] and any(g in member["b"] for g in member["a"])
    probe = [make(rng.choice("abc"), rng.randint(1, 20)) for _ in range(80)]
    out = language.identify(spark, spark.createDataFrame([(t,) for t in probe], "text string"), f).collect()
    for r in out:
        hits = [sum(g in member[k] for g in plain_grams(r.doc.text)) for k in "abc"]
        if hits.count(max(hits)) == 1 and sum(hits):
            assert r.lang == "abc"[hits.index(max(hits))]
            assert abs(r.score - max(hits) / sum(hits)) < 0.02


def test_letters_are_those_of_unicode(spark):
    f = language.learn(spark, spark.createDataFrame([("abc abc abc", "x")], "text string, lang string"))
    odd = ["䷀", "ힰ", "ª", "ʰ", "١", "٣", "𝒳", "𐐷", "中", "々", "〇", "\u0301", "🙂", "_", "Ⅷ"]
    out = language.identify(spark, spark.createDataFrame([(c,) for c in odd], "text string"), f).collect()
    assert {r.doc.text: r.lang != "und" for r in out} == {c: c.isalpha() for c in odd}


def test_a_language_of_one_repeated_text_is_learnt(spark):
    rows = [("one text only, again and again and again", "x")] * 3000 + [(f"ein anderer text mit worten und nummer {chr(97 + k % 26)}{chr(97 + k // 26)}", "y") for k in range(300)]
    f = language.learn(spark, spark.createDataFrame(rows, "text string, lang string"), sample=50)
    out = language.identify(spark, spark.createDataFrame(rows[:1] + rows[-1:], "text string, l string"), f).collect()
    assert [r.lang for r in out] == ["x", "y"]


def test_grams_see_letters_only():
    table = language.letters()
    h1, o1, has = language.grams(["Ab,c", "ab c", "", "1", "a\0b"], table)
    per = [sorted(h1[o1 == k].tolist()) for k in range(5)]
    assert per[0] == per[1] and not per[2] and not per[3] and has.tolist() == [True, True, False, False, True]


def test_span_hashes_agree_with_bytes():
    texts = ["a bb  Ccc", "", "ccc", None, "é É"]
    buf, off = common.text_bytes(pa.array(texts))
    s, e, per = common.word_spans(buf, off, dedup.WORD)
    assert np.diff(per).tolist() == [3, 0, 1, 0, 2]
    h = common.SpanHasher()(buf, s, e)
    assert h[2] == h[3] and len(set(h.tolist())) == 5
