"""Exact duplicates against plain grouping, with tries that spill and hot groups that are dealt out."""

import hashlib
import random
from collections import defaultdict

import pytest
from cases import DOCS_SCHEMA, docs

from seqloom.llm import exact


def plain(rows, largest):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    best = {t: (max if largest else min)((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return sorted((str(i), str(best[t or ""]), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)


def rows_of(texts, seed=0):
    rnd = random.Random(seed)
    ids = list(range(len(texts)))
    rnd.shuffle(ids)
    return list(zip(ids, texts, strict=True))


RND = random.Random(5)
LONG = "é" * 4_000
TEXTS = [None, "", "", "a", "ab", "abc", "ab", LONG, LONG + "x", LONG, *["the hot one"] * 300, *("".join(RND.choices("ab", k=RND.randint(1, 9))) for _ in range(400))]


@pytest.mark.parametrize("largest", [False, True])
@pytest.mark.parametrize(("budget", "fan"), [(exact.BUDGET, exact.FAN), (4000, 4), (700, 2)])
def test_owners(spark, largest, budget, fan):
    rows = rows_of(TEXTS)
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = exact.owners(d, "largest" if largest else "smallest", budget, fan).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == plain(rows, largest)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_nulls_ties_and_columns(spark):
    texts, ids = ["x", "x", "x", "y", "y", "z", None, "", "w"], [3, 3, None, None, None, 2**62, -5, 9, None]
    d = spark.createDataFrame(docs(texts, ids), DOCS_SCHEMA)
    got = exact.owners(d, "largest").collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == plain(list(zip(ids, texts, strict=True)), True)
    by = defaultdict(list)
    for r in got:
        by[r.text_sha256].append(r)
    assert all(sum(r.kept for r in g) == 1 and all(r.doc_id == r.keep_id for r in g if r.kept) for g in by.values())
    stay = exact.deduplicated(d, "largest")
    assert stay.columns == d.columns
    assert sorted((str(r.doc_id), r.text or "") for r in stay.collect()) == sorted([("3", "x"), ("None", "y"), (str(2**62), "z"), ("9", ""), ("None", "w")])
    assert exact.owners(d.limit(0)).collect() == []


def test_trie_spills_and_stays_whole():
    trie, rnd, gone = exact.Trie(), random.Random(2), {}
    keys = [bytes(rnd.choices(b"ab", k=rnd.randint(0, 12))) for _ in range(500)]
    for k in keys:
        node = trie.terminal(k)
        if node is None:
            gone[k] = gone.get(k, 0) + 1
            continue
        node.held = (node.held or 0) + 1
        while trie.size > 60 and (out := trie.spill(stub=True)):
            for x, s in out:
                gone[s] = gone.get(s, 0) + x.held
    here = {s: x.held for x, s in exact.walk(trie.root, b"") if x.held}
    assert here and gone and not set(here) & set(gone)
    assert {**here, **gone} == {k: keys.count(k) for k in keys}
    assert {hashlib.sha256(s).hexdigest() for s in here} == {d for _, d in exact.digests(trie.root)}
