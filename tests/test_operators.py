"""Store, limiter, availability, layout, scores and images."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.functions import images, text
from quire.operators import availability, history, layout, limiter, metrics, requests
from quire.plans import chain
from quire.sources import files, tables


def test_history_keeps_twenty_and_prunes_fifty(spark):
    rows = spark.range(91).selectExpr("id doc_id", "'u' uid", "timestamp_seconds(id) timestamp", "'r' result", "false truncated")
    other = spark.range(100, 105).selectExpr("id doc_id", "'v' uid", "timestamp_seconds(1) timestamp", "'r' result", "false truncated")
    all_ = rows.unionByName(other)
    assert sorted(r.doc_id for r in history.recent(all_).where("uid = 'u'").collect()) == list(range(71, 91))
    once = history.retained(all_)
    assert once.where("uid = 'u'").count() == 41 and once.where("uid = 'v'").count() == 5
    assert history.retained(once).where("uid = 'u'").count() == 20
    assert [r.doc_id for r in history.recent_of(all_, "u", 2, 1).collect()] == [89, 88]
    assert history.recent_of(all_, None).count() == 0
    assert history.owned_item(all_, "100", "v").count() == 1 and history.owned_item(all_, "100", "u").count() == 0
    assert history.owned_item(all_, "../100", "v").count() == 0
    new = spark.createDataFrame([(1, "w", "x" * 10), (2, "", "y"), (3, "w", " "), (4, None, "z")], "doc_id bigint, uid string, result string").withColumn("timestamp", F.current_timestamp())
    got = history.saved(all_, new, 4).where("uid = 'w'").collect()
    assert [(r.result, r.truncated) for r in got] == [("xxxx" + text.TRUNCATION_MARK, True)]


def test_plan_prunes_columns_and_limits_groups_before_the_shuffle(spark, tmp_path):
    spark.range(100).selectExpr("id doc_id", "id % 3 uid", "timestamp_seconds(id) timestamp", "'x' props").write.parquet(f"{tmp_path}/t")
    plan = history.recent(spark.read.parquet(f"{tmp_path}/t").select("doc_id", "uid", "timestamp"))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "props" not in plan


def brute_limiter(rows, allowance, window):
    seen, out = {}, {}
    for c, t, e in sorted(rows, key=lambda r: (r[1], r[2])):
        s = [x for x in seen.get(c, []) if t - x <= window * 1_000_000]
        over = len(s) >= allowance
        out[e] = (over, max(1, -(-(window * 1_000_000 - (t - s[0])) // 1_000_000)) if over else 0)
        seen[c] = s if over else [*s, t]
    return out


def limiter_rows():
    rng = random.Random(1)
    return [(rng.choice(["a", "b", "hot", "hot", "hot"]), rng.randrange(4000) * 500_000, k) for k in range(800)]


def test_limiter_equals_a_loop(spark):
    rows = limiter_rows()
    log = spark.createDataFrame([("convert", *r) for r in rows], "group string, caller string, micros bigint, event_id bigint")
    out = {r.event_id: (r.limited, r.retry_after) for r in limiter.limited(spark, log, {"convert": (4, 30)}).collect()}
    assert out == brute_limiter(rows, 4, 30) and any(x for x, _ in out.values())
    assert not any(r.limited for r in limiter.limited(spark, log, {"convert": (0, 30)}).collect())
    assert limiter.limited(spark, log.where("event_id < 0")).count() == 0 and limiter.limited(spark, log, {}).where("limited").count() == 0


def test_sessions_cut_callers_where_they_paused(spark):
    rows = limiter_rows()
    log = spark.createDataFrame([("convert", *r) for r in rows], "group string, caller string, micros bigint, event_id bigint")
    window = 3_000_000
    out = {r.event_id: (r.caller, r.session) for r in limiter.sessions(log, F.lit(window)).collect()}
    want, last = {}, {}
    for c, t, e in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        n, before = last.get(c, (0, t))
        last[c] = (n + (t - before > window), t)
        want[e] = (c, last[c][0])
    assert out == want and max(n for _, n in want.values()) > 20


def test_limiter_stream_equals_the_batch(spark, tmp_path):
    from quire.streaming.limiter import limited_stream

    rows = sorted(limiter_rows(), key=lambda r: (r[1], r[2]))
    kind = "`group` string, caller string, micros bigint, event_id bigint"
    for k in range(3):
        part = rows[k * 267 : (k + 1) * 267]
        spark.createDataFrame([("convert", *r) for r in part], kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log/p{k}")
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/log/")
    got = tables.run_to_end(spark, limited_stream(stream, {"convert": (4, 30)}).writeStream, "limited")
    out = {r.event_id: (r.limited, r.retry_after) for r in got.collect()}
    assert out == brute_limiter(rows, 4, 30)


def test_availability(spark):
    log = spark.createDataFrame([("a", 10, 1, False, 429, 0), ("b", 10, 2, False, 503, 60), ("b", 20, 3, True, 200, 0), ("c", 5, 4, False, 429, 7)], "model string, at bigint, event_id bigint, ok boolean, status int, retry_after int")
    gone = log.withColumn("gone", F.col("model") == "c")
    assert {r.model: r.until for r in availability.latest_outages(gone).collect()} == {"a": 910, "c": 86_405}
    models = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "model string, ord int")
    out = availability.latest_outages(log)
    assert {r.model: r.until for r in out.collect()} == {"a": 910, "c": 12}
    assert {r.model for r in availability.available(models, out, 11).collect()} == {"b"}
    assert {r.model for r in availability.available(models, out, 12).collect()} == {"b", "c"}
    assert {r.model for r in availability.available(models, out, spark.range(12, 13).toDF("x")).collect()} == {"b", "c"}
    assert tuple(availability.status(models, out, 0).first()) == (True, "b", 1, None)
    assert tuple(availability.status(models.where("model <> 'b'"), out, 0).first()) == (False, None, 0, 12)
    cases = [(200, "", True, "ok"), (429, "", True, "park"), (500, "not found", True, "park"), (404, "", True, "retire"), (400, "models/x was not found", True, "retire"), (400, "Thinking", True, "retry_plain"), (400, "thinking", False, "fatal"), (401, None, True, "fatal")]
    df = spark.createDataFrame(cases, "code int, said string, thinking boolean, want string")
    assert df.where(availability.outcome(F.col("code"), F.col("said"), F.col("thinking")) != F.col("want")).count() == 0


def test_chain(spark):
    rows = [(1, 1, 1, "park", "a"), (1, 1, 2, "ok", "b"), (1, 2, 1, "fatal", "a"), (1, 3, 1, "ok", "a"), (2, 1, 1, "ok", "a")] + [(3, 1, k, "park", "a") for k in range(1, 11)] + [(3, 1, 11, "ok", "a")]
    pages = chain.page_outcomes(spark.createDataFrame(rows, "doc int, page int, step int, outcome string, model string"))
    got = {(r.doc, r.page): (r.ok, r.steps, r.model) for r in pages.collect()}
    assert got == {(1, 1): (True, 2, "b"), (1, 2): (False, 1, None), (1, 3): (True, 1, "a"), (2, 1): (True, 1, "a"), (3, 1): (False, 10, None)}
    assert {r.doc: (r.pages, r.ai_pages, r.fallback_pages, r.path) for r in chain.conversion_path(pages).collect()} == {1: (3, 1, 2, "mixed"), 2: (1, 1, 0, "ai"), 3: (1, 0, 1, "converters")}


def test_rounds(spark):
    kind = "doc int, page int, step int, speculative boolean, ok boolean, retryable boolean, next_attempt int, same_model boolean, without_thinking boolean, error string"
    move = lambda k, n: (False, False, True, n, False, False, "busy")
    rows = [
        (1, 1, 1, True, True, True, 0, False, False, ""), (1, 2, 1, True, False, True, None, False, False, "burst"), (1, 2, 2, *move(0, 2)), (1, 2, 3, False, False, True, 2, False, True, ""), (1, 2, 4, False, True, True, 0, False, False, ""),
        (1, 3, 1, False, False, True, 1, True, False, ""), (1, 3, 2, False, False, True, 1, True, False, ""), (1, 4, 1, False, True, True, 0, False, False, ""),
        (2, 1, 1, False, False, True, None, False, False, ""), (3, 1, 1, False, False, False, 1, False, False, "bad file"), *((4, 1, k, *move(0, k)) for k in range(1, 13)), (5, 1, 1, *move(0, 1)),
    ]
    out = {(r.doc, r.page): (r.ok, r.steps, r.attempt, r.thinking, r.resent, r.exhausted, r.error) for r in chain.rounds(spark.createDataFrame(rows, kind)).collect()}
    assert out == {
        (1, 1): (True, 0, 0, True, False, False, ""), (1, 2): (True, 3, 2, False, False, False, ""), (1, 3): (False, 2, 2, True, True, False, chain.NOT_SENT),
        (2, 1): (False, 1, 0, True, False, True, chain.NO_QUOTA), (3, 1): (False, 1, 0, True, False, False, "bad file"), (4, 1): (False, 10, 10, True, False, False, chain.UNAVAILABLE), (5, 1): (False, 1, 1, True, False, False, chain.UNAVAILABLE),
    }


def test_layout(spark):
    lines = spark.createDataFrame([(1, 1, 10, 0, 90, 20, "A long sentence of text.", 90, 1), (1, 2, 80, 40, 120, 60, "lim =1", 5, 1), (1, 3, 0, 100, 90, 120, "x", 80, 1)], "page int, id int, l int, t int, r int, b int, text string, min_conf int, block int")
    boxes = spark.createDataFrame([(1, 10, 0, 0, 200, 60, 200), (1, 11, 0, 200, 50, 205, 200), (1, 12, 0, 300, 100, 330, 200), (1, 13, 0, 2, 200, 18, 200), (1, 14, 0, 98, 200, 122, 200)], "page int, id int, l int, t int, r int, b int, width int")
    got = {(r.box_id, r.t, r.b): (r.nominated, r.reason) for r in layout.nominated(lines, boxes).collect()}
    assert got == {
        (10, 20, 60): (True, None), (11, 200, 205): (False, "too short to be a displayed formula"), (12, 300, 330): (True, None),
        (13, 2, 18): (False, "the region is prose, not displayed maths"), (14, 98, 122): (False, "read as text (min conf 80)"),
    }
    eq = spark.createDataFrame([(1, 50, 0, 42, 100, 58, "x=1")], "page int, id int, l int, t int, r int, b int, text string")
    assert [(r.kind, r.id, r.ord) for r in layout.assembled(lines, eq).orderBy("ord").collect()] == [("text", 1, 1), ("equation", 50, 2), ("text", 3, 3)]
    assert spark.range(1).select(layout.carved(F.lit(0), F.lit(100), F.array(F.struct(F.lit(30).cast("bigint").alias("t"), F.lit(50).cast("bigint").alias("b"))))).first()[0] == [(0, 30), (50, 100)]
    words = spark.createDataFrame([(1, 1, 1, 1, 2, "b", 91.7, 5, 1, 9, 4), (1, 1, 1, 1, 1, "a", 95.2, 1, 0, 4, 3), (1, 1, 1, 1, 3, " ", 95.0, 0, 0, 99, 99), (1, 1, 1, 1, 4, "c", -1.0, 0, 0, 99, 99)], "page int, block int, par int, line int, ord int, text string, conf double, l int, t int, r int, b int")
    r = layout.line_words(words).first()
    assert (r.text, r.min_conf, r.l, r.t, r.r, r.b) == ("a b", 91, 1, 0, 9, 4)


def test_emitted_document(spark):
    rows = [(1, 1, 1, "text", "1. Intro", 0, 10, 1, 1), (1, 1, 2, "text", "Some words", 20, 30, 2, 1), (1, 1, 3, "text", "and more.", 30, 40, 2, 1), (1, 1, 4, "equation", "x=1", 50, 60, None, None), (1, 2, 1, "text", "Next page,", 0, 10, 1, 1)]
    items = spark.createDataFrame(rows, "doc int, page int, ord int, kind string, text string, t int, b int, block int, par int")
    tex = layout.emitted(items, lambda c: c).first().tex
    assert tex == "\\documentclass{article}\n\\usepackage[utf8]{inputenc}\n\\usepackage[T1]{fontenc}\n\\usepackage{amsmath}\n\\begin{document}\n\n\\text" .replace("\\text", "") + "1. Intro\n\nSome words and more.\n\n\\[\nx=1\n\\]\n\n\\clearpage\n\nNext page,\n\n\\end{document}\n"
    head = items.withColumn("text", F.when(F.col("ord") == 1, "1.2 Intro").otherwise(F.col("text")))
    assert "\\subsection{Intro}\n\nSome words" in layout.emitted(head, lambda c: c).first().tex


def test_scores(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert value(text.normalised(F.lit(" $\\dfrac{ a }{b} \\left( x \\right)$ "))) == "\\fracab(x)"
    assert value(text.normalised(F.lit("\\operatorname{sin} x \\, y"))) == "\\sinxy"
    assert value(text.tokens(F.lit("\\frac a\n"))) == ["\\frac", " ", "a", "\n"]
    assert value(text.plain_text(F.lit("\\begin{document}Hi \\textbf{You} $x$ % no\nthere\\end{document}"))) == "hi you there"
    assert value(text.text_score(F.lit("abcd"), F.lit("abxd"))) == 0.75 and value(text.text_score(F.lit("$x$"), F.lit("a"))) is None
    assert value(text.math_expressions(F.lit("$$a b$$ \\[c\\]"))) == ["ab", "ab", "c"]
    assert value(text.structure_score(F.lit("\\item \\item \\frac"), F.lit("\\item \\frac"))) == pytest.approx(2 / 3)
    rows = spark.createDataFrame([("a", "x", "x"), ("a", "xyz", "xy"), ("b", "q", "")], "cond string, truth string, guess string")
    got = {r.cond: (r.n, r.exact, r.accuracy) for r in metrics.micro(metrics.scored(rows)).collect()}
    assert got == {"a": (2, 1, 0.75), "b": (1, 0, 0.0), None: (3, 1, 0.6)}
    s = metrics.spread(spark.createDataFrame([("g", 4), ("g", 1), ("g", 3), ("g", 3)], "g string, v int"), "g", "v").first()
    assert (s.least, s.median, s["most"]) == (1, 3, 4)
    rng = random.Random(3)
    many = [(rng.choice("ab"), rng.choice([rng.random(), 0.5, float(rng.randrange(5))])) for _ in range(5000)] + [("one", 2.0), ("none", None), (None, 1.0), (None, 3.0)]
    out = metrics.spread(spark.createDataFrame(many, "g string, v double"), "g", "v", accuracy=100).collect()
    sort = {g: sorted(v for x, v in many if x == g and v is not None) for g, _ in many}
    assert {r.g: (r.least, r.median, r["most"]) for r in out} == {g: (v[0], v[len(v) // 2], v[-1]) for g, v in sort.items() if v}


def test_text_columns(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert [value(text.filename_base(F.lit(x))) for x in ("a.b.pdf", ".pdf", "", None, "plain")] == ["a.b", "document", "document", "document", "plain"]
    assert value(text.filename_safe(F.lit("my file?.png"))) == "my_file_"
    assert [value(text.input_allowed(F.lit(x))) for x in ("a.PNG", "a.exe", "a", "a.")] == [True, False, True, False]
    assert value(text.mime_safe(F.lit("IMAGE/JPEG; x=1"))) == "image/jpeg" and value(text.mime_safe(F.lit("text/html"))) == "image/png"
    assert [value(text.attempt_number(F.lit(x))) for x in ("3.7", "-1", "x", None, "Infinity", "NaN")] == [3, 0, 0, 0, 0, 0]
    assert value(text.fenced_latex(F.lit("```\na\n``` ```tex\n\\begin{document} b\n``` ```\nc\n```"))) == "\\begin{document} b"
    assert value(text.fenced_latex(F.lit("nothing"))) is None
    assert value(text.looks_like_loop(F.lit("a a a a a a"))) and not value(text.looks_like_loop(F.lit("a a a")))
    assert value(text.files_for(F.lit("\\documentclass[x]{book}\n%\\usepackage{no}\n\\usepackage{a, b}\\usepackage{a}"))) == ["26/book.cls", "26/a.sty", "26/b.sty"]
    assert value(text.retry_seconds(F.lit('{"error":{"details":[{"@type":"RetryInfo","retryDelay":"17.5s"}]}}'))) == 17 and value(text.retry_seconds(F.lit("?"))) == 0


def test_sources(spark, tmp_path):
    (tmp_path / "a.tex").write_text("one\ntwo")
    (tmp_path / "b.txt").write_text("no")
    (tmp_path / "m.json").write_text('[{"file": "x", "n": 1}, {"file": "y"}]')
    assert [tuple(r) for r in files.tex_corpus(spark, str(tmp_path)).collect()] == [("a", "one\ntwo")]
    assert files.manifest(spark, f"{tmp_path}/m.json", "file string, n int").count() == 2
    assert files.inventory(spark, str(tmp_path)).count() == 3
    refs = files.references(spark.createDataFrame([("f", "src='x.js' src='skip.js'"), ("g", "src='x.js'")], "file string, text string"), [r"src='([^']+)'"], "^skip")
    assert [(r.path, r.files) for r in files.missing_references(refs, spark.createDataFrame([("q",)], "path string")).collect()] == [("x.js", ["f", "g"])]
    docs = spark.createDataFrame([(1, 12), (2, 0)], "doc int, total int")
    got = files.units(docs).groupBy("doc").agg(F.max("unit").alias("u"), F.max("dropped").alias("d")).orderBy("doc").collect()
    assert [tuple(r) for r in got] == [(1, 10, 2), (2, 1, 0)]
    made = files.write_tex(spark.createDataFrame([("a b.pdf", "x\ny"), ("é", None)], "name string, tex string"), f"file://{tmp_path}/out").collect()
    assert sorted((r.name, r.bytes) for r in made) == [("_.tex", 0), ("a_b.tex", 3)] and (tmp_path / "out" / "a_b.tex").read_text() == "x\ny"
    assert sorted(x.name for x in (tmp_path / "out").iterdir() if not x.name.endswith(".crc")) == ["_.tex", "a_b.tex"]
    assert [r.unit for r in files.units(spark.createDataFrame([(1, None)], "doc int, total int")).collect()] == [1]


def page(height=400, width=300):
    p = np.full((height, width), 255, np.uint8)
    for top in range(40, 360, 60):
        p[top : top + 20, 30:270] = np.where(np.arange(240) % 4 < 2, 0, 255)
    return p


def test_images(spark):
    p = page()
    mask = images.ink_mask(p)
    boxes = images.segment_boxes(mask)
    assert len(boxes) == 6 and boxes[0] == (22, 32, 276, 68)
    assert images.segment_boxes(np.zeros((50, 40), bool)) == [(0, 0, 40, 50)] and images.segment_boxes(np.zeros((50, 40), bool), allow_empty=True) == []
    assert images.tighten(mask, (0, 0, 300, 90)) == (22, 32, 276, 68)
    assert images.skew(p) == 0.0 and images.skew(np.full((30, 30), 255, np.uint8)) == 0.0
    turned = 255 - images.rotated(255 - p, 5.0)
    straight, angle = images.deskewed(turned)
    assert angle == -5.0 and straight.shape[0] > 400
    assert np.allclose(images.weights(10, 7, "cubic").sum(1), 1) and np.allclose(images.resized(np.full((9, 8), 7.0), 20, 5, "lanczos"), 7)
    assert np.allclose(images.resized(p[:50, :50], 50, 50), p[:50, :50])
    big, factor = images.upscaled(p)
    assert factor == 2.0 and big.shape == (800, 600) and images.upscaled(np.zeros((1000, 3)))[1] == 1.0
    rgb = np.stack([p] * 3, 2)
    assert images.tensor(rgb, 32).shape == (1, 3, 32, 32) and images.grey(rgb).tolist() == p.tolist()
    assert images.measure_ink(rgb, (0, 0, 300, 90)) == (30, 40, 268, 60) and images.measure_ink(rgb[:20], (0, 0, 9, 9)) is None
    df = spark.createDataFrame([("x", bytearray(p.tobytes()))], "path string, content binary")
    r = images.page_regions(df, lambda c: np.frombuffer(c, np.uint8).reshape(400, 300)).first()
    assert r.path == "x" and r.angle == 0.0 and len(r.boxes) == 6 and r.note is None
    bad = images.page_regions(df.union(spark.createDataFrame([("y", bytearray(b"no"))], df.schema)), lambda c: np.frombuffer(c, np.uint8).reshape(400, 300)).collect()
    assert [(r.path, r.note, r.boxes is None) for r in bad] == [("x", None, False), ("y", "could not be read: ValueError", True)]


def test_runs_join_close_bands():
    rows = np.array([1, 1, 0, 1, 0, 0, 0, 1], bool)
    assert images.runs(rows, 1).tolist() == [[0, 2], [3, 4], [7, 8]] and images.runs(rows, 2).tolist() == [[0, 4], [7, 8]]


def test_request_rules(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    form = lambda *v: value(requests.form_error(*(F.lit(x) for x in v)))
    assert form("n", "e", "12345678", "12345678", True) is None
    assert [form("", "e", "x", "x", True), form("n", "e", "x", "y", True), form("n", "e", "x", "x", None), form("n", "e", "12345678", "12345678", None)] == requests.FORM_ERRORS
    assert [value(requests.session_valid(F.lit(s), F.lit(i), F.lit(2_592_100))) for s, i in ((True, 100), (True, 99), (False, 100), (True, None))] == [True, False, False, False]
    good = {"alg": "RS256", "kid": "k", "aud": "p", "iss": "i/p", "sub": "u", "exp": 101, "iat": 160, "auth_time": 50, "disabled": False, "valid_since": 50}
    for change, want in (({}, True), ({"exp": 100}, False), ({"iat": 161}, False), ({"aud": "q"}, False), ({"alg": "none"}, False), ({"kid": "x"}, False), ({"iss": "i/q"}, False), ({"sub": ""}, False), ({"disabled": True}, False), ({"valid_since": 51}, False), ({"valid_since": None, "disabled": None}, True)):
        kinds = {"exp": "bigint", "iat": "bigint", "auth_time": "bigint", "valid_since": "bigint", "disabled": "boolean"}
        claims = F.struct(*(F.lit(v).cast(kinds.get(k, "string")).alias(k) for k, v in (good | change).items()))
        assert value(requests.claims_valid(claims, "p", "i/p", ["k"], F.lit(100))) is want
    assert [value(requests.too_large(F.lit(x))) for x in ("1048576", "1048577", "x", None)] == [False, True, False, False]
    assert value(requests.message(F.lit(None).cast("string"), {"A": "b"}, "c")) == "c" and value(requests.terms_outdated(F.lit(None).cast("string"), "2")) is False
    assert value(requests.without(F.array(*map(F.lit, "abab")), F.array(F.lit("a")))) == ["b", "b"]
