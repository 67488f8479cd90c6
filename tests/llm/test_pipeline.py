import zlib
from collections import Counter

import corpus_pipeline
import pytest
from cases import DOCS_SCHEMA, docs
from conftest import SF
from pyspark.sql import functions as F
from test_decontam import brute as contaminated
from test_pii import scored
from test_quality import brute as measures
from test_simhash import fp, groups

from seqloom.llm import packing, pii, quality
from seqloom.llm.tokens import Encoder


def held(rule, m):
    part, whole = 1000 * m[rule.measure], m[rule.per]
    return m.n_words < rule.words or ((rule.low is None or part >= whole * rule.low) and (rule.high is None or part <= whole * rule.high))


def test_empty_table(spark):
    df = spark.createDataFrame([], DOCS_SCHEMA)
    for name, f in corpus_pipeline.STAGES:
        out = f(spark, df, SF)
        assert out.count() == 0
        df = out if name != "best_fit_packing" else df
    assert df.columns == spark.createDataFrame([], DOCS_SCHEMA).columns


def test_stages_against_brute_force(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["quality_rules", "near_dedup", "decontamination", "personal_data", "best_fit_packing"]
    text = {r.doc_id: r.text for r in df.collect()}
    q = stage["quality_rules"](spark, df, SF)
    assert q.columns == df.columns
    left = {r.doc_id for r in q.collect()}
    told = {r.doc_id: r for r in quality.quality_report(df).collect()}
    for i, t in text.items():
        m = measures(t)
        assert tuple(told[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == tuple(m[:6])
        assert (i in left) == (not m[5] and all(held(r, told[i]) for r in quality.RULES))
    n = stage["near_dedup"](spark, q, SF)
    stay = {r.doc_id for r in n.collect()}
    of = groups(fp(text[i]) for i in left)
    least = {}
    for i in sorted(left):
        least.setdefault(of[fp(text[i])], i)
    assert n.columns == df.columns and stay == set(least.values())
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    c = stage["decontamination"](spark, n, SF)
    ids = sorted(stay)
    clean = {i for i, b in zip(ids, contaminated([text[i] for i in ids], items), strict=True) if not b[4]}
    assert c.columns == df.columns and {r.doc_id for r in c.collect()} == clean
    p = stage["personal_data"](spark, c, SF)
    rows, ids = {r.doc_id: r.text for r in p.collect()}, sorted(clean)
    assert p.columns == df.columns and set(rows) == clean
    spans = scored([text[i] for i in ids])
    assert any(spans) and rows == {i: pii.redacted(text[i], [(a, b, k) for k, a, b in x]) for i, x in zip(ids, spans, strict=True)}
    encoder, pieces, places = Encoder.of("byte_bpe_50k.json"), Counter(), {}
    for i, t in rows.items():
        b = encoder.ids(t) + (2).to_bytes(4, "little")
        for k, (at, n) in enumerate(packing.cuts(len(b) // 4, 1024)):
            pieces[i, k, at, n, zlib.crc32(b[4 * at : 4 * (at + n)])] += 1
    packed = stage["best_fit_packing"](spark, p, SF).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == pieces
    for r in packed:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in places.values():
        x.sort()
        assert x[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(x, x[1:], strict=False)) and sum(n for _, n in x) <= 1024
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").distinct().collect()} == clean


def test_awkward_rows_pass_through(spark):
    long = " ".join(f"word{i} of the long tale" for i in range(60))
    other = " ".join(f"Other{i} is in that story" for i in range(60))
    texts = [None, "", "short", long, long, long, other, other]
    ids = [1, 2, 3, 4, 4, 5, None, None]
    df = spark.createDataFrame(docs(texts, ids), DOCS_SCHEMA)
    for name, f in corpus_pipeline.STAGES[:-1]:
        df = f(spark, df, SF)
        assert df.columns == spark.createDataFrame([], DOCS_SCHEMA).columns, name
    rows = df.collect()
    assert sorted(str(r.doc_id) for r in rows) == ["4", "None"]
    assert all(r.kept == "x" and r["a.b"] == 6 for r in rows)
    packed = corpus_pipeline.STAGES[-1][1](spark, df, SF)
    assert packed.count() >= 2


def test_goes_on_behind_the_last_stage(spark, tmp_path, monkeypatch):
    """A run that fails in its third stage reads the second one's rows when it is started again."""
    calls = []

    def stage(name, fails=False):
        def run(spark, docs, sf_dir):
            calls.append(name)
            if fails and calls.count(name) == 1:
                raise RuntimeError(name)
            return docs.withColumn(name, F.lit(len(calls)))

        return run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("one", stage("one")), ("two", stage("two")), ("three", stage("three", True))])
    with pytest.raises(RuntimeError):
        corpus_pipeline.run(spark, SF, f"file://{tmp_path}/run")
    got = corpus_pipeline.run(spark, SF, f"file://{tmp_path}/run")
    assert calls == ["one", "two", "three", "three"]
    assert {(r.one, r.two, r.three) for r in got.select("one", "two", "three").distinct().collect()} == {(1, 2, 4)} and got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
