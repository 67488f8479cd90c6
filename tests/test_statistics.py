"""Matching statistics against brute force: every place, every case."""

import random

import pytest

from seqloom.operators import match, statistics


def brute(texts, pattern):
    out = []
    for e in range(1, len(pattern) + 1):
        n = next(n for n in range(e, -1, -1) if n == 0 or any(pattern[e - n : e] in t for t in texts))
        occ = sum(t[i:].startswith(pattern[e - n : e]) for t in texts for i in range(len(t))) if n else 0
        out.append((n, occ))
    return out


def tables(spark, texts, patterns):
    return spark.createDataFrame(list(enumerate(texts)), "seq_id int, seq string").repartition(3), spark.createDataFrame(list(enumerate(patterns)), "read_id int, pattern string")


def check(spark, texts, patterns):
    s, p = tables(spark, texts, patterns)
    got = {r.pattern: list(zip(r.lengths, r.occs)) for r in statistics.matching_statistics(s, p).collect()}
    assert got == {x: brute([t or "" for t in texts], x) for x in patterns if x}


@pytest.mark.parametrize("seed", range(3))
def test_random_texts_and_patterns(spark, seed):
    r = random.Random(seed)
    word = lambda n, a: "".join(r.choice(a) for _ in range(r.randrange(n)))
    letters = ("ab", "abcdé\U0001f600", "ab\x00 \n")[seed]
    check(spark, [word(60, letters) for _ in range(20)], [word(25, letters) for _ in range(15)])


def test_nulls_ties_empty_and_no_texts(spark):
    check(spark, [None, "", "abab", "abab"], [None, "", "abab", "abab", "xabx", "b"])
    check(spark, [], ["ab"])
    s, p = tables(spark, ["ab"], [])
    assert statistics.matching_statistics(s, p).collect() == []


def test_lanes_batches_and_blocks_cut_no_match(spark, monkeypatch):
    """Texts of many lanes and patterns of many blocks: long matches over their borders are whole."""
    r = random.Random(7)
    text = "".join(r.choice("acgt") for _ in range(9_000))
    patterns = [text[1000:1400], text[5:905] + "n" + text[4000:4300], text[8990:] + text[:50], "acgt" * 9]
    monkeypatch.setattr(statistics, "CELLS", 9_000)
    s, p = tables(spark, [text, text[:3000], "acgt" * 700], patterns)
    got = {x.pattern: list(x.lengths) for x in statistics.matching_statistics(s, p).collect()}
    assert got[patterns[0]] == list(range(1, 401))
    assert got[patterns[1]][899] == 900 and got[patterns[1]][900] == 0 and got[patterns[1]][-1] == 300
    assert got[patterns[3]][-1] == 36
    assert [(x.seg_start, x.seg_end, x.occ) for x in match.piecewise(s, p.where("read_id = 1")).orderBy("segment").collect()] == [(901, 1200, 1), (0, 899, 2)]


def test_patterns_that_no_block_holds(spark, monkeypatch):
    """They are matched from anchors, with the same result."""
    s, p = tables(spark, ["abcabcabd" * 5, "xyz"], ["zzabcabcabd" + "q" + "abd", "bd", "q"])
    want = [sorted(tuple(r) for r in f(s, p).collect()) for f in (match.longest_suffix, match.piecewise)]
    monkeypatch.setattr(statistics, "CELLS", 20)
    assert [sorted(tuple(r) for r in f(s, p).collect()) for f in (match.longest_suffix, match.piecewise)] == want


def test_one_pass_over_the_texts_a_block_and_no_shuffle_of_them(spark):
    s, _ = tables(spark, ["abc"], ["b"])
    plan = statistics._seen(s, ["b"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Aggregate [state" in plan
    assert plan.index("Aggregate [state") < plan.index("MapInArrow")
