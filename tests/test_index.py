"""Index views of small strings against plain Python."""

import random

import pytest

from seqloom.operators import index, match, prefix_free, run_graph, samples


def plain_sa(t):
    return sorted(range(len(t) + 1), key=lambda i: t[i:])


def seqs(spark, *texts):
    return spark.createDataFrame([(i, f"s{i}", t) for i, t in enumerate(texts)], "seq_id long, name string, seq string")


@pytest.mark.parametrize(("text", "start"), [("BANANA", 1), ("ACGTACGTTACG", 2), ("AAAAAAAAAAAAAAAAAAAAAAAA", 2), ("".join(random.Random(1).choices("ACGT", k=200)) * 2, 16)])
def test_views(spark, text, start):
    half = len(text) // 3
    s = seqs(spark, text[:half], text[half:])
    sa, n = plain_sa(text), len(text) + 1
    got = index.suffix_array(s, start)
    assert [r.pos for r in got.orderBy("rk").collect()] == sa
    letters = index.letters(s)
    b = index.bwt(got, letters)
    bwt = [text[i - 1] if i else None for i in sa]
    assert [r.c for r in b.orderBy("rk").collect()] == bwt
    c = index.c_array(letters)
    lf = {r.rk: r.lf for r in index.lf(b, c).collect()}
    assert sorted(lf.values()) == list(range(n)) and all(sa[lf[k]] == (sa[k] - 1) % n for k in range(n))
    assert {r.pos: r.phi for r in index.phi(got).collect()} == {sa[k]: sa[k - 1] for k in range(1, n)}
    runs = index.bwt_runs(b, n)
    r = runs.orderBy("run").collect()
    assert "".join((x.head or "$") * x.len for x in r) == "".join(x or "$" for x in bwt)
    assert all(x.first_tpos == (sa[x.lo] - 1) % n and x.last_tpos == (sa[x.hi] - 1) % n for x in r)
    phi = {x.pos: x.phi for x in index.phi_by_samples(got.where("rk > 0").select("pos"), runs, n).collect()}
    assert phi == {sa[k]: sa[k - 1] for k in range(1, n)}


@pytest.mark.parametrize(("texts", "w", "p"), [
    (["BANANA"], 2, 2), (["", "A" * 30, "", "A" * 11], 3, 2), (["ab", "", "a", "b", "ab", "a"] * 5, 4, 3), ([""], 8, 32), (["é", "x"], 8, 32),
    (["".join(random.Random(k).choices("ABé", k=k * 7)) for k in range(9)] + ["".join(random.Random(8).choices("ABé", k=56))] * 3, 3, 4),
])
def test_prefix_free(spark, texts, w, p):
    s = seqs(spark, *texts)
    text = "".join(texts)
    sa, n = plain_sa(text), len(text) + 1
    assert [r.pos for r in prefix_free.suffix_array(s, w, p).orderBy("rk").collect()] == sa
    got = prefix_free.bwt_runs(s, w, p).orderBy("run").collect()
    bwt = [text[i - 1] if i else None for i in sa]
    assert [x for r in got for x in [r["head"]] * r.len] == bwt and [r.run for r in got] == list(range(len(got)))
    assert all(r.first_tpos == (sa[r.lo] - 1) % n and r.last_tpos == (sa[r.hi] - 1) % n and r.hi - r.lo + 1 == r.len for r in got)
    assert all(a["head"] != b["head"] for a, b in zip(got, got[1:], strict=False))


def test_copies_share_phrases(spark):
    """A hundred copies have a few phrases more than one: those over their seams."""
    one = "".join(random.Random(4).choices("ACGT", k=3000))
    sizes = []
    for k in (1, 100):
        parse, words, n = prefix_free.parsed(seqs(spark, *[one] * k))
        assert n == 3000 * k
        sizes.append((words.count(), parse.count(), words.selectExpr("sum(length(phrase))").first()[0]))
    assert sizes[1][0] <= sizes[0][0] + 3 and sizes[1][2] < 1.5 * sizes[0][2] and sizes[1][1] > 90 * sizes[0][1]


def test_golden_samples(spark):
    s = seqs(spark, "BANANA")
    r = index.bwt_runs(index.bwt(index.suffix_array(s), index.letters(s)), 7).orderBy("run").collect()
    assert [x.first_tpos for x in r] == [5, 4, 0, 6, 3] and [x.last_tpos for x in r] == [5, 2, 0, 6, 1]
    assert {x.c: x.c_before for x in index.c_array(index.letters(s)).collect()} == {"A": 1, "B": 4, "N": 5}


def indexed(spark, text):
    s = seqs(spark, text)
    b = index.bwt(index.suffix_array(s, 4), index.letters(s))
    from seqloom.tables import written

    return plain_sa(text), written(index.bwt_runs(b, len(text) + 1))


@pytest.mark.parametrize(("text", "limit"), [("ACGTACGTTACG", samples.LIMIT), ("A" * 40, samples.LIMIT), ("".join(random.Random(2).choices("AB", k=50)) * 3, samples.LIMIT), ("ACGTACGTTACG" + "é" * 9, 0)])
def test_questions_to_runs(spark, text, limit):
    """Ranges, toeholds, suffix-array values and hits, with the samples in the tasks and by merges."""
    sa, runs = indexed(spark, text)
    n = len(text) + 1
    pats = ["ACG", "CGT", "TACG", "GGG", "A", "AB", "é", "BBB", text[5:8]] + ([text[5:14], text, text + "A", "AAAA"] if limit else [])
    found = samples.backward_search(runs, spark.createDataFrame(list(enumerate([*pats, ""])), "read_id long, pattern string"), limit)
    want = {}
    for i, x in enumerate(pats):
        ks = [k for k in range(n) if text.startswith(x, sa[k]) and sa[k] < len(text)]
        if ks:
            want[i] = (ks[0], ks[-1], sa[ks[-1]])
    assert {r.read_id: (r.lo, r.hi, r.toehold) for r in found.collect()} == want
    graph = samples.sample_graph(runs, n)
    hits = samples.locate(found, runs, graph, n, limit=limit).collect()
    assert sorted(map(tuple, hits)) == sorted((i, hi - k + 1, sa[k]) for i, (lo, hi, _) in want.items() for k in range(lo, hi + 1))
    some = samples.locate(found, runs, graph, n, 2, limit).collect()
    assert sorted(map(tuple, some)) == sorted(tuple(h) for h in hits if h.nth <= 2)
    at = samples.suffix_array_at(spark.range(n).selectExpr("id AS rk", "id * 2 AS other"), runs, graph, n, limit)
    assert sorted(map(tuple, at.select("rk", "pos", "other").collect())) == [(k, sa[k], 2 * k) for k in range(n)]


def test_rank_select_and_ranges(spark):
    text = "".join(random.Random(9).choices("ABC", k=90)) + "D" * 20
    sa, runs = indexed(spark, text)
    bwt = [text[i - 1] if i else None for i in sa]
    of = samples.directory(runs)
    q = [(i, c) for i in range(len(bwt) + 1) for c in "ABCDZ"]
    got = samples.rank(spark.createDataFrame(q, "i long, c string"), of).collect()
    assert {(r.i, r.c): r["rank"] for r in got} == {(i, c): bwt[:i].count(c) for i, c in q}
    places = {c: [i for i, x in enumerate(bwt) if x == c] for c in "ABCDZ"}
    got = samples.select(spark.createDataFrame([(k, c) for k, c in q], "k long, c string"), of).collect()
    assert {(r.k, r.c): r.place for r in got} == {(k, c): places[c][k] if k < len(places[c]) else None for k, c in q}
    ranges = [(i, lo, hi, c) for i, (lo, hi, c) in enumerate((lo, hi, c) for lo in range(0, 110, 17) for hi in (lo - 1, lo, lo + 3, 110) for c in "ABDZ")]
    d = spark.createDataFrame(ranges, "q long, lo long, hi long, c string")
    want, near = [], {}
    for i, lo, hi, c in ranges:
        at = [k for k in range(lo, min(hi, len(bwt) - 1) + 1) if bwt[k] == c]
        parts = [[k for k in at if k - at.index(k) == g] for g in sorted({k - at.index(k) for k in at})]
        want += [(i, p[0], p[-1]) for p in parts]
        beside = [k for k in at if (k > lo and bwt[k - 1] != c) or k == max(p[-1] for p in parts if k in p)]
        if parts:
            near[i] = min(p[0] if p[0] > lo else p[-1] for p in parts)
            assert near[i] in beside
    assert sorted(map(tuple, samples.break_ranges(d, runs).collect())) == sorted(want)
    assert {r.q: r.place for r in samples.closest_breaks(d, runs).collect()} == near


def test_run_graph_and_walks(spark):
    text = "".join(random.Random(3).choices("AB", k=60))
    s = seqs(spark, text)
    sa, n = plain_sa(text), len(text) + 1
    runs = index.bwt_runs(index.bwt(index.suffix_array(s), index.letters(s)), n)
    r = runs.orderBy("run").collect()
    e = run_graph.edges(runs, n)
    starts = sorted(x.first_tpos for x in r)
    at = {x.first_tpos: x.run for x in r}
    edges = {x.run: x for x in e.collect()}
    for x in r[1:]:
        before = r[x.run - 1].last_tpos
        pre = max((t for t in starts if t <= before), default=starts[-1] - n)
        larger = [t for t in starts if t > x.first_tpos]
        assert (edges[x.run].next, edges[x.run].cost, edges[x.run].limit) == (at[pre % n], before - pre, (larger[0] - x.first_tpos) if larger else 1)
    # path cover in root order, step by step
    seen, want = set(), {}
    into = {x.next for x in edges.values()}
    for root in sorted(set(edges) - into):
        at_run, path = root, []
        while at_run not in seen and at_run != 0:
            seen.add(at_run)
            path.append(at_run)
            at_run = edges[at_run].next
        want[root] = path
    cover = {}
    for x in run_graph.path_cover(e, 1).orderBy("root", "place").collect():
        cover.setdefault(x.root, []).append(x.run)
    assert cover == {k: v for k, v in want.items() if v}
    # walks by doubling equal single steps
    queries = [(i, x.run, a, w) for i, (x, a, w) in enumerate((x, a, w) for x in r[1:] for a in (0, 1) for w in (1, 3, 7))]
    got = {x.q: (x.run, x.ahead, x.steps) for x in run_graph.walk(spark.createDataFrame(queries, "q long, run long, ahead long, want long"), run_graph.doubled(e, 3)).collect()}
    for q, run, ahead, wanted in queries:
        steps = 0
        while steps < wanted and run in edges and ahead < edges[run].limit:
            ahead, run, steps = ahead + edges[run].cost, edges[run].next, steps + 1
        assert got[q] == (run, ahead, steps), q


def test_tree_goldens(spark):
    """Fixed trees and walks, and every walk of random ones step by step."""
    rnd = random.Random(6)
    paths = {0: [(i, 0, 1) for i in range(8)], 1: [(26, 5, 1), (3, 0, 6), (11, 0, 3), (20, 2, 1), (0, 0, 3), (17, 4, 1)], 2: [(i, 0, 1) for i in range(14)], 3: [(i, 0, 1) for i in range(9)], 4: [(i, 0, 1) for i in range(19)], 5: [(7, 3, 2)]}
    paths |= {k: [(rnd.randint(0, 99), rnd.randint(0, 3), rnd.randint(0, 12)) for _ in range(rnd.randint(2, 40))] for k in range(6, 10)}
    rows = [(k, i, *x) for k, p in paths.items() for i, x in enumerate(p)]
    tree = run_graph.trees(spark.createDataFrame(rows, "path long, place long, run long, cost long, limit long"))
    want, queries = {}, []
    for k, p in paths.items():
        for start in range(len(p)):
            for distance in {1, 2, 3, len(p) - start - 1, len(p) + 5}:
                for cost in {0, rnd.randint(0, 4)}:
                    queries.append((len(queries), k, start, cost, distance))
                    at, c = start, cost
                    while at - start < min(distance, len(p) - 1 - start) and p[at][2] >= c:
                        c, at = c + p[at][1], at + 1
                    want[queries[-1][0]] = (p[at][0], at - start, c)
    got = {r.q: (r.run, r.steps, r.cost) for r in run_graph.tree_walk(spark.createDataFrame(queries, "q long, path long, place long, cost long, distance long"), tree).collect()}
    assert got == want
    of = {(x[1], x[2], x[4]): got[x[0]] for x in queries if x[3] == 0}
    assert [of[1, 0, d] for d in (1, 2, 3)] == [(3, 1, 5), (11, 2, 5), (11, 2, 5)]
    assert [of[1, 1, d] for d in (1, 2)] == [(11, 1, 0), (20, 2, 0)]
    assert [of[1, 2, d] for d in (1, 2, 3)] == [(20, 1, 0), (0, 2, 2), (17, 3, 2)]
    assert of[4, 0, 18] == (18, 18, 0) and of[4, 3, 24] == (18, 15, 0)
    # a node is its leaves' edges as one
    t = {(r.path, r.node): (r.cost, r.limit) for r in tree.collect()}
    assert all(t[k, n] == (t[k, 2 * n][0] + t[k, 2 * n + 1][0], min(t[k, 2 * n][1], t[k, 2 * n + 1][1] - t[k, 2 * n][0])) for k, n in t if (k, 2 * n + 1) in t)
    assert (0, 1) in t and (3, 1) not in t and len([1 for k, _ in t if k == 0]) == 15


def test_random_searches(spark):
    rnd = random.Random(4)
    texts = ["".join(rnd.choices("ABé", k=rnd.randint(0, 90))) for _ in range(12)] + ["AB" * 9000, None]
    pats = list({"".join(rnd.choices("ABé", k=rnd.randint(1, 7))) for _ in range(40)}) + ["Z"]
    s = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "seq_id long, seq string")
    p = spark.createDataFrame([(i, x) for i, x in enumerate(pats)], "read_id long, pattern string")
    want = sorted((i, k, j) for i, x in enumerate(pats) for k, t in enumerate(texts) if t for j in range(len(t)) if t.startswith(x, j))
    assert sorted(map(tuple, match.locate(s, p).collect())) == want
    occ = {r.read_id: r.occ for r in match.count(s, p).collect()}
    assert occ == {i: sum(w[0] == i for w in want) for i in range(len(pats))}
    assert sorted(map(tuple, match.locate(s, p, block=7).collect())) == want
    with pytest.raises(ValueError):
        match.locate(s, spark.createDataFrame([(1, "")], "read_id long, pattern string"))


def test_mixed_lengths_and_contexts(spark):
    rnd = random.Random(7)
    texts = ["".join(rnd.choices("abcdeé ", k=n)) for n in (0, 1, 700, 5000, 9000)]
    pats = [texts[4][100:1900], texts[3][3900:4600], texts[3][-513:], texts[4][:512], "a", texts[2][:3], texts[2][50:90], "abab" * 300, texts[4][100:1899] + "#"]
    s = spark.createDataFrame(list(enumerate(texts)), "seq_id long, seq string")
    p = spark.createDataFrame(list(enumerate(pats)), "read_id long, pattern string")
    want = sorted((i, k, j, t[max(0, j - 30) : j], t[j : j + 20]) for i, x in enumerate(pats) for k, t in enumerate(texts) for j in range(len(t)) if t.startswith(x, j))
    assert {w[0] for w in want} == {0, 1, 2, 3, 4, 5, 6}
    assert sorted(map(tuple, match.locate(s, p, before=30, after=20).collect())) == want
    reads = spark.createDataFrame([(1, "#" + texts[4][3:3000]), (2, "x" + texts[3]), (3, texts[3][:600] + "#" + texts[3][601:1400]), (4, "##é")], "read_id long, pattern string")
    found = {r.read_id: (r.match_len, r.occ) for r in match.longest_suffix(s, reads).collect()}
    assert found == {1: (2997, 1), 2: (5000, 1), 3: (799, 1), 4: (1, sum(t.count("é") for t in texts))}


def test_plans_shuffle_no_texts(spark):
    """Hits bring their context: nothing but hits and reads is exchanged."""
    s = spark.createDataFrame([(0, "some text of a document")], "seq_id long, seq string")
    p = spark.createDataFrame([(0, "text of"), (1, "tex# of a")], "read_id long, pattern string")
    for d in (match.locate(s, p), match.inexact(s, p, 1), match.containing(s, p)):
        plan = d._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "NestedLoop" not in plan and "SinglePartition" not in plan


def test_inexact(spark):
    rnd = random.Random(5)
    texts = ["".join(rnd.choices("ACGT", k=80)) for _ in range(5)]
    pats = [texts[0][5:15], "ACGTAC", texts[2][:9]]
    s = spark.createDataFrame(list(enumerate(texts)), "seq_id long, seq string")
    p = spark.createDataFrame(list(enumerate(pats)), "read_id long, pattern string")
    d = lambda a, b: sum(x != y for x, y in zip(a, b, strict=True))
    for z in (0, 1, 2):
        want = sorted((i, k, j, d(t[j : j + len(x)], x)) for i, x in enumerate(pats) for k, t in enumerate(texts) for j in range(len(t) - len(x) + 1) if d(t[j : j + len(x)], x) <= z)
        assert sorted(map(tuple, match.inexact(s, p, z).collect())) == want


GOLDEN = {  # pattern: segments (start, end, legacy end), right to left
    "CGT": [(0, 2, 2)],
    "ACGAACG": [(4, 6, 6), (0, 2, 3)],
    "ACGTXACG": [(5, 7, 7), (0, 3, 4)],
    "ACGX": [(4, 3, 3), (0, 2, 3)],
    "XACG": [(1, 3, 3), (0, -1, 0)],
}


def test_piecewise_and_longest_suffix_goldens(spark):
    s = seqs(spark, "ACGTACGTTACG")
    p = spark.createDataFrame([(x,) for x in GOLDEN], "pattern string").selectExpr("pattern AS read_id", "pattern")
    got = {}
    for r in match.piecewise(s, p).orderBy("read_id", "segment").collect():
        got.setdefault(r.read_id, []).append((r.seg_start, r.seg_end, r.legacy_end))
    assert got == GOLDEN
    q = spark.createDataFrame([(1, "GGACG"), (2, "ACGA"), (3, "ACGX")], "read_id long, pattern string")
    assert {r.read_id: (r.match_len, r.occ) for r in match.longest_suffix(s, q).collect()} == {1: (3, 3), 2: (1, 3), 3: (0, 0)}
    bounds = {}
    for r in match.lower_bounds(s, p).orderBy("read_id", "i").collect():
        bounds.setdefault(r.read_id, []).append(r.d)
    for x, d in bounds.items():
        want, n, piece = [], 0, ""
        for ch in x:
            piece += ch
            if piece not in "ACGTACGTTACG":
                n, piece = n + 1, ""
            want.append(n)
        assert d == want, x
