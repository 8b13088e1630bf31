"""All operators and stages on tables with further columns of awkward names, long and missing values, repeats and no rows."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import audio, dedup, language, mixing, pages, phrases, sequences, sharding, toxicity, urls
from quire.llm.common import boxed, unboxed

SMALL = "/root/testdata/sf0.001"
NAMES = "_key _score _text _part _local _size _lang _blocks _u _source _s _h _p _host key row id doc text_ component number spans items slot shard my-col a.b tick`s number\xa0é select col size a".split(" ") + ["a b", "", "CASE"]
NAMES = [n for n in NAMES if n]
LONG = "word " * 400_000 + "end"


def widened(df):
    """df with a column of every name, each with a value of its own, and a struct and a map."""
    more = {n: F.concat(F.lit(f"{n}:"), F.monotonically_increasing_id().cast("string")) for n in NAMES if n not in df.columns}
    out = df.select("*", *(c.alias(n) for n, c in more.items()))
    return out.select("*", F.struct(F.lit(1).alias("x y"), F.lit("q").alias("_key")).alias("a struct"), F.create_map(F.lit("k"), F.lit(2)).alias("map"))


def odd_documents(spark):
    rows = [(1, LONG, "en", "s"), (2, LONG, "en", "s"), (3, None, None, None), (3, "", "en", None), (4, "one two three four five six", "en", "s"), (4, "one two three four five six", "en", "s"), (None, "x", "de", ""), (9, "  \n ", "de", "t")]
    df = spark.createDataFrame([(*r, None) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return widened(df.repartition(2)).cache()


def as_dict(row):
    return {k: v.asDict(True) if hasattr(v, "asDict") else v for k, v in zip(row.__fields__, row, strict=True)}


def values(rows):
    return sorted((repr(sorted(as_dict(r).items(), key=repr)) for r in rows))


def language_rows(spark, df):
    return language.identify(spark, df, language.learn(spark, df))


def toxic_rows(spark, df):
    labels = widened(spark.createDataFrame([(1, 1, 0), (4, 1, 1)], "doc_id bigint, quality int, toxic int"))
    return toxicity.score(spark, df, toxicity.train(spark, toxicity.learnable(df), toxicity.learnable(labels)))


DOCUMENT_OPERATORS = {
    "op2": (lambda s, df: mixing.mix(s, df), {"size", "total", "target", "copies"}),
    "op3": (language_rows, {"lang", "score"}),
    "op5": (toxic_rows, {"score"}),
    "op8": (lambda s, df: sharding.assign_shards(s, df, F.col("doc_id"), 3), {"shard", "slot", "grown_shard"}),
}


@pytest.mark.parametrize("name", DOCUMENT_OPERATORS)
def test_rows_are_carried_whole(spark, name):
    run, made = DOCUMENT_OPERATORS[name]
    df = odd_documents(spark)
    out = run(spark, df)
    assert set(out.columns) == {"doc", *made}
    back = unboxed(out)
    assert back.columns == df.columns and back.dtypes == df.dtypes
    assert values(back.collect()) == values(df.collect())
    assert run(spark, df.where("doc_id > 99")).count() == 0


@pytest.mark.parametrize("column", ["url", "html"])
def test_page_rows_are_carried_whole(spark, column):
    long = "<p>" + "some words of a long page. " * 100_000
    df = widened(spark.createDataFrame([(1, "http://a.org/x", long), (1, None, None), (None, "http://" + "a." * 2000 + "org/" + "x" * 100_000, ""), (2, "", "<")], "page_id bigint, url string, html string"))
    rules = widened(spark.createDataFrame(urls.RULES, "host string, path string, verdict string"))
    run = (lambda d: urls.judge(spark, d, rules)) if column == "url" else (lambda d: pages.extract(spark, d))
    out = run(df)
    assert values(unboxed(out).collect()) == values(df.collect()) and unboxed(out).columns == df.columns
    assert run(df.where("page_id > 9")).count() == 0


def test_operators_that_keep_ids_alone(spark):
    df = odd_documents(spark)
    media = audio.text_to_media(df).collect()
    assert sorted((r.doc_id, r.n_bytes) for r in media if r.doc_id) == [(1, len(LONG)), (2, len(LONG)), (3, 0), (3, 0), (4, 27), (4, 27), (9, 4)]
    tokens = sequences.token_sequences(spark, df).collect()
    assert {d.doc_id for r in tokens for d in r.docs} == {1, 2, 3, 4, 9, None} and sum(r.n_tokens for r in tokens) > 800_000
    near = dedup.near_duplicates(spark, df)
    assert sorted((r.id, r.n_shingles, r.component) for r in near.select("id", "n_shingles", "component").collect() if r.id) == [(1, 2, 1), (2, 2, 1), (3, 0, 3), (3, 0, 3), (4, 2, 4), (4, 2, 4), (9, 0, 9)]
    items = widened(spark.createDataFrame([(7, "three four five six"), (None, None)], "item_id bigint, text string"))
    hit = phrases.search(spark, phrases.build_index(spark, df, F.col("doc_id"), F.col("text")), items)
    assert sorted((r.key, r.n_words, len(r.spans)) for r in hit.collect() if r.key) == [(1, 400_001, 0), (2, 400_001, 0), (3, 0, 0), (3, 0, 0), (4, 6, 1), (4, 6, 1), (9, 0, 0)]


@pytest.mark.parametrize("stage", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_keep_every_column(spark, stage):
    run, df = dict(corpus_pipeline.STAGES)[stage], odd_documents(spark)
    out = run(spark, df, SMALL)
    if stage != corpus_pipeline.STAGES[-1][0]:
        assert out.columns == df.columns and out.dtypes == df.dtypes
        mine = values(df.collect())
        assert set(values(out.collect())) <= set(mine)
    assert out.count() > 0 and run(spark, df.where("doc_id > 99"), SMALL).count() == 0


def test_boxes_hold_any_names(spark):
    df = widened(spark.range(3))
    assert unboxed(boxed(df)).collect() == df.collect()
