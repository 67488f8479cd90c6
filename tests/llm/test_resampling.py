"""Resampling against plain Python: features of several lengths, gains, weights and the draw."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from cases import DOCS_SCHEMA, docs

from seqloom.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, n, buckets):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for i in range(len(w)) for k in range(1, n + 1) if i + k <= len(w)]


def plain(rows, target, n, buckets, share, least):
    f = [(i, *features(t, n, buckets)) for i, t in rows]
    s, t = Counter(b for _, _, x in f for b in x), Counter(b for x in target for b in features(x, n, buckets)[1])
    S, T = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    out = []
    for i, w, x in f:
        weight = sum(map(gain, x)) // len(x) if x else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, w, len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    may = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[4], x[0] is not None, x[0] or 0))
    for k, x in enumerate(may[: len(may) * share // 100], 1):
        x[5] = k
    return sorted((str(x[0]), *x[2:5], str(x[5])) for x in out)


def got(df):
    return sorted((str(r.doc_id), r.n_features, r.weight, r.score, str(r["rank"])) for r in df.collect())


def test_ring_hashes_every_run():
    words = [w.encode() for w in "a bb é a bb ccc a".split()]
    for n in (1, 2, 3, 9):
        want = [zlib.crc32(b" ".join(words[i : e + 1])) for e in range(len(words)) for i in range(max(0, e - n + 1), e + 1)]
        assert list(resampling.ring(words, n)) == want
        assert sorted(resampling.bucket_array("A bb é a, BB ccc a", n, 7)[1]) == sorted(h % 7 for h in want)


def test_resampled(spark):
    rnd = random.Random(3)
    vocabulary = ["alpha", "Beta", "é", "Été", "x9", "zz", "target", "words"]
    texts = [None, "", " ,. ", "A" * 5000, " ".join(rnd.choices(vocabulary, k=30_000)), *(" ".join(rnd.choices(vocabulary[: rnd.randint(2, 8)], k=rnd.randint(1, 40))) for _ in range(120))]
    target = ["target words é", None, "x9 target words beta"]
    rows = list(enumerate(texts)) + [(None, "alpha beta " * 12), (7, "zz " * 25)]
    d = spark.createDataFrame(docs([t for _, t in rows], [i for i, _ in rows]), DOCS_SCHEMA).repartition(5)
    t = spark.createDataFrame([(i, x) for i, x in enumerate(target)], "item_id long, text string")
    assert got(resampling.resampling_report(d, t)) == plain(rows, target, 1, 10_000, 10, 20)
    assert got(resampling.resampled(d, t, n=3, buckets=50, share=33, least_words=0)) == plain(rows, target, 3, 50, 33, 0)
    none = t.limit(0)
    assert got(resampling.resampling_report(d, none)) == plain(rows, [], 1, 10_000, 10, 20)
    assert resampling.resampling_report(d.limit(0), t).collect() == []


def test_weights_are_floored_means(spark):
    f = spark.createDataFrame([(1, 3, [0, 1, 1], None, None), (2, 0, [], None, None), (3, 2, [1, 0], None, None)], resampling.FEATURES)
    w = {r.doc_id: (r.n_features, r.weight) for r in resampling.weighed(f, np.array([-1, -2])).collect()}
    assert w == {1: (3, -2), 2: (0, 0), 3: (2, -2)}
