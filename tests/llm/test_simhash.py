import random
import re

import pytest
import xxhash
from cases import DOCS_SCHEMA, docs

from seqloom.llm import simhash


def fp(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(nodes):
    nodes = sorted(set(nodes))
    up = {x: x for x in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if bin(a ^ b).count("1") <= 2:
                up[find(b)] = find(a)
    return {x: find(x) for x in nodes}


def test_fingerprint():
    rnd = random.Random(12)
    for _ in range(200):
        t = "".join(rnd.choice(["A", "b ", "É", "\x85", "\x0b", "ç ", "\n"]) for _ in range(rnd.randint(0, 60)))
        assert simhash.fingerprint(t) == fp(t) == simhash.fingerprint(t, block=2), t


@pytest.mark.parametrize("dense", [1, 8, 32])
def test_components_of_links(spark, dense):
    rnd = random.Random(13)
    made = [0, rnd.getrandbits(64)]
    for _ in range(250):
        x = rnd.choice(made)
        for _ in range(rnd.randint(1, 3)):
            x ^= 1 << rnd.randrange(64)
        made.append(x)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    links = simhash.links(spark.createDataFrame([(signed(x),) for x in set(made)], "fp long"), dense)
    assert all(bin((r.a ^ r.b) & (2**64 - 1)).count("1") <= 2 for r in links.collect())
    root = {r.a: r.b for r in simhash.components(links).collect()}
    of = groups(made)
    got, want = {}, {}
    for x in set(made):
        got.setdefault(root.get(signed(x), signed(x)), set()).add(x)
        want.setdefault(of[x], set()).add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_pairs_of_five_shared_bytes_are_dropped_by_the_tally(spark):
    """Pairs one list apart: bits differ in one byte, two bytes, three bytes; the last within one shared list of four bytes."""
    base = 0x0123456789ABCDEF
    near, two, three = base ^ 3, base ^ (1 << 8 | 1), base ^ (1 << 40 | 1 << 8 | 1)
    got = simhash.links(spark.createDataFrame([(x,) for x in (base, near, two, three)], "fp long"))
    want = {tuple(sorted(p, reverse=True)) for p in ((base, near), (base, two), (near, two), (two, three))}
    assert {(r.a, r.b) for r in got.collect()} == {p for p in want if bin(p[0] ^ p[1]).count("1") <= 2}


def test_very_long_text():
    t = "One two three four five six seven " * 60_000
    assert simhash.fingerprint(t) == simhash.fingerprint(t, block=999)


def test_long_chains_and_hubs(spark):
    chain = [(i + 1, i) for i in range(60)] + [(1000 + i, 500) for i in range(300)]
    root = {r.a: r.b for r in simhash.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert root == {**{i: 0 for i in range(1, 61)}, **{1000 + i: 500 for i in range(300)}}


def test_documents(spark):
    rnd = random.Random(14)
    base = [" ".join(f"w{rnd.randint(0, 500)}" for _ in range(120)) for _ in range(8)]
    texts = [None, "", " \n", "one", "ONE", *base, *[b.replace(" ", "  ", 1) for b in base], *[b + " tail" for b in base]]
    ids = [*range(10, 10 + len(texts))]
    ids[2] = None
    got = simhash.near_duplicates(spark.createDataFrame(docs(texts, ids), DOCS_SCHEMA)).collect()
    of = groups(fp(t) for t in texts)
    least = {}
    for i, t in zip(ids, texts, strict=True):
        if i is not None:
            least[of[fp(t)]] = min(i, least.get(of[fp(t)], i))
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == sorted((str(i), f"{fp(t):016x}", least[of[fp(t)]]) for i, t in zip(ids, texts, strict=True))
