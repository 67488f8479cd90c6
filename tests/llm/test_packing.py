import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from cases import DOCS_SCHEMA, docs

from seqloom.llm import packing
from seqloom.llm.tokens import Encoder


def test_cuts():
    assert packing.cuts(1, 1024) == [(0, 1)] and packing.cuts(1024, 1024) == [(0, 1024)]
    assert packing.cuts(2049, 1024) == [(0, 1), (1, 1024), (1025, 1024)]


@pytest.mark.parametrize("seed", range(8))
def test_plan_holds_every_piece_once(seed):
    rnd = random.Random(seed)
    size = rnd.choice([16, 64, 1024])
    h = np.zeros(size + 1, dtype=np.int64)
    for _ in range(rnd.choice([1, 20, 3000])):
        h[rnd.choice([rnd.randint(1, size), min(size, 1 + int(rnd.expovariate(8 / size))), size // 2 + 1])] += rnd.choice([1, 1, 50])
    got = Counter()
    fitted, rest = packing.plan(h, size)
    runs = fitted + rest
    assert all(sum(pattern) == size for pattern, _ in fitted)
    for pattern, n in runs:
        assert sum(pattern) <= size and n > 0
        for a in pattern:
            got[a] += n
    assert got == Counter({i: int(c) for i, c in enumerate(h) if c})
    assert sum(n for _, n in runs) <= 1.25 * packing.lower_bound(h, size) + 1


def test_nnls_finds_the_counts_of_a_mixture():
    h, made = np.zeros(1025, dtype=np.int64), {(700, 324): 40, (512, 512): 9, (600, 300, 124): 25, (1024,): 70}
    for pattern, n in made.items():
        for a in pattern:
            h[a] += n
    fitted, rest = packing.plan(h)
    assert sum(n for _, n in fitted) == sum(made.values()) and not rest


def test_fitted_patterns_carry_a_corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").repartition(8)
    h = np.zeros(1025, dtype=np.int64)
    for r in packing.pieces(docs).groupBy("length").count().collect():
        h[r["length"]] = r["count"]
    fitted, rest = packing.plan(h)
    carried, n = sum(n for _, n in fitted), sum(n for _, n in fitted + rest)
    assert n == packing.lower_bound(h) and carried > 0.9 * n
    assert sum(n for p, n in fitted if len(p) > 1) > 0.8 * (n - h[1024])


def test_pack(spark):
    rnd = random.Random(9)
    texts = [None, "", "a", "b " * 3000, "same text"] + ["the tale of " * rnd.randint(0, 700) for _ in range(60)] + ["same text"]
    ids = [*range(len(texts) - 1), 4]
    got = packing.pack(spark.createDataFrame(docs(texts, ids), DOCS_SCHEMA)).collect()
    encoder, want, at = Encoder.of("byte_bpe_50k.json"), Counter(), defaultdict(list)
    for i, t in zip(ids, texts, strict=True):
        b = encoder.ids(t or "") + (2).to_bytes(4, "little")
        for k, (s, n) in enumerate(packing.cuts(len(b) // 4, 1024)):
            want[i, k, s, n, zlib.crc32(b[4 * s : 4 * (s + n)])] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    for r in got:
        at[r.sequence_id].append((r.offset, r.length))
    for places in at.values():
        end = 0
        for o, n in sorted(places):
            assert o == end
            end += n
        assert end <= 1024
