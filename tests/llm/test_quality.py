import random
import re

from cases import DOCS_SCHEMA, docs

from seqloom.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), len(words) < 10 or 100 * len(hit) > 20 * len(words)


def test_measures(spark):
    rnd = random.Random(1)
    texts = [None, "", " \n\t", "a b c d e a b c d e", "x " * 9 + "x", "é\x0bb\x85c d\n\nd\nd", "a|b <c> $%&*#"]
    texts += ["".join(rnd.choice(["the ", "of ", "b ", "c\n", "#", "| ", "é"]) for _ in range(rnd.randint(0, 120))) for _ in range(150)]
    got = quality.with_quality(spark.createDataFrame(docs(texts), DOCS_SCHEMA)).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(texts[r.doc_id]), texts[r.doc_id]
        assert r["a.b"] == 6 and r.spans == 2
        assert not (r.base_failed and r.kept)


def test_verdicts(spark):
    clean = " ".join(f"word{i} of the tale" for i in range(40))
    junk = " ".join(f"w{i}$$$" for i in range(60))
    pipes = " | ".join(f"w{i}" for i in range(60))
    lines = "\n".join(["the same line again"] * 3 + [f"line {i} is of the rest" for i in range(2)])
    rows = quality.with_quality(spark.createDataFrame(docs([clean, junk, pipes, lines]), DOCS_SCHEMA)).collect()
    assert {r.doc_id: r.kept for r in rows} == {0: True, 1: False, 2: False, 3: False}
    plan = quality.quality_report(spark.createDataFrame(docs([clean]), DOCS_SCHEMA))._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Python" not in plan
