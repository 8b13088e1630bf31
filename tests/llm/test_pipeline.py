"""Every stage of the pipeline against plain code, on what the stage before has kept."""

import re
import subprocess
import sys
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from quire.llm import common, sequences, toxicity

from ..conftest import ROOT
from .test_other_ops import plain_mix
from .test_text_ops import brute_components, brute_phrases

SMALL = "/root/testdata/sf0.001"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def plain_score(machine, text):
    """The machine's score of one text, term by term."""
    hasher = common.SpanHasher()
    ids = set()
    for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", (text or "").encode()):
        for k, piece in enumerate([w, *(w[:n] for n in toxicity.PREFIXES)]):
            buf = np.frombuffer(piece, np.uint8)
            h = hasher(buf, np.array([0]), np.array([len(piece)]))
            ids.add(int((h ^ np.uint64(k << 64 - toxicity.BITS))[0] >> np.uint64(64 - toxicity.BITS)))
    slots = [machine.slot[i] for i in ids if machine.slot[i] >= 0]
    x = machine.bias + sum(machine.linear[s] for s in slots)
    for f in range(toxicity.FACTORS):
        v = [machine.factors[s, f] for s in slots]
        x += 0.5 * (sum(v) ** 2 - sum(y * y for y in v))
    return 1 / (1 + np.exp(-x))


def test_stages_equal_plain_code(spark):
    raw = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    docs, rows = raw, {r.doc_id: r for r in raw.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "minhash_near_dedup", "benchmark_decontamination", "mixing", "token_sequences"]

    def kept(name):
        out = common.table(spark, stages[name](spark, docs, SMALL), name)
        assert out.columns == raw.columns and [f.dataType for f in out.schema] == [f.dataType for f in raw.schema]
        return out

    docs = kept("toxicity")
    m = toxicity.train(spark, toxicity.learnable(raw), toxicity.learnable(labels))
    scores = {i: plain_score(m, r.text) for i, r in rows.items()}
    assert all(abs(s - 0.5) > 1e-6 for s in scores.values())
    want = {i for i, s in scores.items() if s < 0.5}
    assert Counter(r.doc_id for r in docs.collect()) == Counter(want) and len(want) < len(rows)

    docs = kept("minhash_near_dedup")
    want = {c for _, _, c in brute_components([(i, rows[i].text) for i in sorted(want)])}
    assert Counter(r.doc_id for r in docs.collect()) == Counter(want)

    docs = kept("benchmark_decontamination")
    want = {r[0] for r in brute_phrases([(i, rows[i].text) for i in want], items) if not r[5]}
    assert {r.doc_id: r for r in docs.collect()} == {i: rows[i] for i in want}

    docs = kept("mixing")
    u = {r.doc_id: r.u for r in raw.select("doc_id", common.unit_interval(F.col("doc_id"), 11).alias("u")).collect()}
    copies = plain_mix([(i, len(SPACE.findall(rows[i].text or "")), rows[i].source) for i in sorted(want)], u)
    got = Counter(r.doc_id for r in docs.collect())
    assert sum(got[i] != n for i, n in copies.items()) <= 2 and set(got) <= want

    out = stages["token_sequences"](spark, docs, SMALL).collect()
    assert sorted(r.slot for r in out) == list(range(len(out)))
    encode = sequences.encoder(sequences.read_ranks(spark, sequences.VOCABULARY), sequences.PATTERN)
    tokens = Counter()
    for r in out:
        for d in r.docs:
            tokens[d.doc_id] += d.n
    assert tokens == Counter({i: n * (len(encode([rows[i].text or ""])[0]) + 1) for i, n in got.items()})


def test_run_and_registration(spark):
    assert entry.queries()["pipeline"] is corpus_pipeline.run and "pipeline" not in entry.oracle_sql()
    assert {f"op{n}" for n in range(1, 11)} == {q.split("_")[0] for q in entry.queries() if re.match(r"op\d", q)}
    out = corpus_pipeline.run(spark, SMALL)
    assert out.where("n_tokens > 0").count() == out.select("slot").distinct().count() > 0


def test_errors_inside_the_subpackage_are_not_swallowed(tmp_path):
    for f in ("quire", "__spark_entry__.py", "corpus_pipeline.py"):
        subprocess.run(["cp", "-r", f"{ROOT}/{f}", str(tmp_path)], check=True)
    (tmp_path / "quire" / "llm" / "queries.py").write_text("from quire.llm.common import no_such_name\n")
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=False)
    assert said.returncode and "no_such_name" in said.stderr
