"""Collocations against plain counting; the perfect hash; blocks, hashes that meet, sums in a tree."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from cases import DOCS_SCHEMA

from seqloom.llm import phrases


def plain(rows, least, longest, cover, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        mine = []
        for p, a in cand.items():
            if any(len(q) > len(p) and inside(p, q) and 100 * b >= cover * a for q, b in cand.items()):
                continue
            score, m = min((2_000_000 * a // (c[p[:m]] + c[p[m:]]), m) for m in range(1, len(p)))
            mine.append((-score, -a, " ".join(p).encode(), c[p[:m]], c[p[m:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(mine)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def corpus(seed=1):
    rnd = random.Random(seed)
    words = ["New", "york", "é", "Été", "a b", "\x00", "city", "of", "the", "x9", "ÀB"]
    rows = [(rnd.choice(["en", "de", None, "und", "1:2"]), " ".join(rnd.choices(words, weights=range(11, 0, -1), k=rnd.randint(0, 60)))) for _ in range(80)]
    rows += [("en", "new york city, of the\tNEW york  city. of the new\x0byork city"), ("en", None), (None, ""), ("fr", " .. ,"), ("en", "new york city " * 3000), (None, None)]
    return rows + rows[:5]


def frame(spark, rows):
    return spark.createDataFrame([(i % 9, t, lang, "s", 1, "x", 1, 2, 3, 4, 5, 6) for i, (lang, t) in enumerate(rows)], DOCS_SCHEMA)


@pytest.mark.parametrize(("least", "longest", "block", "top"), [(4, 4, 1 << 20, 2000), (3, 4, 60, 9), (30, 3, 1 << 20, 2000)])
def test_collocations(spark, least, longest, block, top):
    rows = corpus()
    d = frame(spark, rows).repartition(5)
    got = phrases.collocations(d, least, longest, 80, top, block, 1 << 10)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain(rows, least, longest, 80, top)


def test_nothing_to_find(spark):
    d = frame(spark, [("en", "one two"), (None, None)])
    assert phrases.collocation_report(d).collect() == [] == phrases.collocation_report(d.limit(0)).collect()
    assert phrases.collocation_report(frame(spark, [("en", "a, " * 99)])).collect() == []


def test_slots_are_minimal_and_verified():
    rnd = np.random.default_rng(3)
    keys = np.unique(rnd.integers(0, 500, (4000, 3), dtype=np.int32), axis=0)
    for of in (None, lambda x: phrases.phrase_hash(x) % np.uint64(1000)):  # the second: hashes meet
        s = phrases.Slots(keys, of)
        assert sorted(s.find(keys).tolist()) == list(range(len(keys)))
        assert (s.keys[s.find(keys)] == keys).all()
        assert (s.find(keys + 500) == -1).all()
        assert (of is not None) == bool(s.rest)
    w = phrases.Slots([b"%d" % i for i in range(1000)], lambda k: phrases.word_hash(k) % np.uint64(90))
    assert sorted(w.find(w.keys).tolist()) == list(range(1000)) and (w.find([b"x", b"1000"]) == -1).all()
    assert phrases.Slots(keys[:0]).find(keys).max() == -1


def test_segments_hold_each_longer_phrase_once():
    rnd = random.Random(4)
    flat = np.array([rnd.choice([-1, 0, 1, 2, 3]) for _ in range(3000)], dtype=np.int32)
    for k in (1, 2, 3):
        at, x = phrases.windows(flat, k)
        good = x.sum(axis=1) % 3 != 1
        small = phrases.segments(flat, at[good], k)
        keep = {tuple(r) for r in x[good].tolist()}
        want = Counter(tuple(r) for r in phrases.windows(flat, k + 1)[1].tolist() if r and tuple(r[:k]) in keep and tuple(r[1:]) in keep)
        assert Counter(tuple(r) for r in phrases.windows(small, k + 1)[1].tolist()) == want


def test_tree_sum(spark, monkeypatch):
    monkeypatch.setattr(phrases, "FAN", 64)
    parts = [(p, c, bytearray(phrases._packed(np.array([p, c, 0, 300])))) for p in range(150) for c in range(3)]
    d = phrases.tree_sum(spark.createDataFrame(parts, "part int, chunk int, data binary"))
    assert {r.chunk: phrases._unpacked(r.data).tolist() for r in d.collect()} == {c: [11175, 150 * c, 0, 45000] for c in range(3)}
    stop = phrases.tree_sum(spark.createDataFrame(parts, "part int, chunk int, data binary"), 30)
    assert {r.chunk: phrases._unpacked(r.data).tolist() for r in stop.collect()} == {c: [30, min(30, 150 * c), 0, 30] for c in range(3)}
