"""Search in one pass: seams, stretches, blocks, against plain Python."""

import random

import pyarrow as pa

from seqloom import tables
from seqloom.operators import match, scan


def test_passages_over_seams(spark):
    rnd = random.Random(3)
    texts = ["".join(rnd.choices("abé", k=n)) for n in (40, 0, 3, 1, 2, 700, 5, 90)] + [None, "ab"]
    whole = "".join(t or "" for t in texts)
    pats = [whole[38:52], whole[30:60], whole[a : a + 5] if (a := 700) else "", whole[-4:], "ab", "a", whole[600:], "zz", ""]
    s = spark.createDataFrame([(i, f"n{i}", t) for i, t in enumerate(texts)], "seq_id long, name string, seq string")
    p = spark.createDataFrame(list(enumerate(pats)), "read_id long, pattern string")
    want = {i: sum(whole.startswith(x, j) for j in range(len(whole))) if x else 0 for i, x in enumerate(pats)}
    assert {r.read_id: r.occ for r in match.count_over_seams(s, p).collect()} == want
    assert sum(1 for i in (0, 1, 3, 6) if want[i] == 1) >= 3


def test_running_total_of_any_names(spark):
    """Columns of a table may be called what the totals were called inside."""
    d = spark.createDataFrame([(i, i, "x") for i in range(9)], "_p long, _before long, c string")
    assert sorted(r.t for r in tables.running_total(d, "_p", "_p", name="t").collect()) == [0, 0, 1, 3, 6, 10, 15, 21, 28]
    assert sorted(r.n for r in tables.ranked(d, "_p", name="n").collect()) == list(range(9))


def test_scan_in_stretches_and_blocks(spark, monkeypatch):
    """Hits over the ends of stretches, of many equal patterns, within z differences, of letters of several bytes."""
    rnd = random.Random(8)
    texts = ["".join(rnd.choices("abé𝄞", k=n)) for n in (0, 7, 64, 500)]
    pats = [texts[3][i : i + n] for i, n in ((0, 20), (5, 20), (5, 20), (60, 9), (480, 20), (100, 41), (7, 3))]
    ids = pa.array(range(len(pats)))
    monkeypatch.setattr(scan, "PAIRS", 3)
    differ = lambda a, b: sum(x != y for x, y in zip(a, b, strict=True))
    for z in (None, 0, 1, 3):
        some = [i for i, x in enumerate(pats) if len(x) > (z or 0)]
        held = scan.Patterns(ids.take(pa.array(some)), [pats[i] for i in some], z)
        for t in texts:
            want = sorted((i, j, differ(t[j : j + len(pats[k])], pats[k])) for i, k in enumerate(some) for j in range(len(t) - len(pats[k]) + 1) if differ(t[j : j + len(pats[k])], pats[k]) <= (z or 0))
            got = [(a, b, 0 if d is None else c) for begin in range(0, len(t), 13) for w, x, d in held.found(t, begin, min(len(t), begin + 13)) for a, b, c in zip(w.tolist(), x.tolist(), (w if d is None else d).tolist(), strict=True)]
            assert sorted(got) == want


def test_first_hits_of_copies(spark):
    """Copies and near copies: equal suffixes are one row of what is compared, and the order is that of whole suffixes."""
    rnd = random.Random(2)
    base = "".join(rnd.choices("abc", k=300))
    texts = [base] * 5 + [base[:250] + "z"] * 3 + ["x" + base, base[100:], "ab"]
    s = spark.createDataFrame(list(enumerate(texts)), "seq_id long, seq string")
    p = spark.createDataFrame([(i, base[i : i + 3]) for i in range(0, 290, 29)] + [(500, "ab")], "read_id long, pattern string")
    hits = tables.written(match.locate(s, p), "hits")
    of = {}
    for r in hits.collect():
        of.setdefault(r.read_id, []).append((r.seq_id, r.pos))
    for k in (1, 2, 7):
        want = []
        for i, h in of.items():
            h = sorted(h)
            h.sort(key=lambda x: texts[x[0]][x[1] :], reverse=True)
            want += [(i, *x, n + 1) for n, x in enumerate(h[:k])]
        got = match.first_hits(s, hits, k, 8).select("read_id", "seq_id", "pos", "nth").collect()
        assert sorted(map(tuple, got)) == sorted(want)


def test_located_at_places(spark):
    """Hits at given places alone are the hits at all places, less the others; patterns over IN_PLACE characters, too."""
    rnd = random.Random(5)
    texts = ["".join(rnd.choices("abé", k=n)) for n in (30, 0, 2, 90)] + [None, "é" * 700, "é" * 650]
    places = [[0, 3, 29, 29], [0], [], list(range(0, 90, 2)), [0], [0, 100, 101, 699], None]
    pats = ["a", "é", "ab", texts[3][20:33], "é" * 600, "é" * 513]
    s = spark.createDataFrame(list(zip(range(len(texts)), texts, places, strict=True)), "seq_id long, seq string, places array<long>")
    p = spark.createDataFrame(list(enumerate(pats)), "read_id long, pattern string")
    want = sorted((k, i, j) for k, x in enumerate(pats) for i, t in enumerate(texts) for j in set(places[i] or []) if (t or "").startswith(x, j))
    assert {w[0] for w in want} == set(range(len(pats)))
    assert sorted((r.read_id, r.seq_id, r.pos) for r in match.locate(s, p, at="places").collect()) == want


def test_reads_of_copies_leave_the_search_once(spark, tmp_path, monkeypatch):
    """Reads of copies stand in every copy: what the search hands on grows with the reads, not with their square."""
    from seqloom.plans.queries import QUERIES

    rnd = random.Random(9)
    texts = ["".join(rnd.choices("ab é", k=90))] * 60 + ["x" * 60] * 20 + ["x" * 59, "", None, "".join(rnd.choices("ab é", k=70))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    made, locate = [], match.locate
    monkeypatch.setattr(match, "locate", lambda *a, **k: made.append(locate(*a, **k)) or made[-1])
    assert [tuple(r) for r in QUERIES["simulated_alignment"](spark, str(tmp_path)).collect()] == [(81, 81)]
    assert 0 < made[0].count() <= 81


def test_short_texts_in_line(monkeypatch):
    """Texts that are scanned together: no hit over their ends, places and context are their own, long beginnings may be shared."""
    rnd = random.Random(4)
    base = "".join(rnd.choices("abé", k=400))
    texts = [base[:70], "", base[70:75], base[75:200], None, base, "", base[:90] + "x" + base[91:], base[390:]] * 2
    pats = [base[60:90], base[68:72], base[:80], base[:90] + "y", base[:90] + "x", base[20:41], base[20:40] + "y", base[20:70] + "y", base[20:80], "é"]
    places = [rnd.sample(range(-5, 410), 60) for _ in texts]
    b = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts), pa.array(places)], names=["seq_id", "seq", "places"])
    differ = lambda x, y: sum(u != v for u, v in zip(x, y, strict=True))
    for stretch in (1, 100, 1000, 1 << 18):
        monkeypatch.setattr(scan, "STRETCH", stretch)
        for z, before, after, at in ((None, 4, 7, None), (None, 0, 0, "places"), (0, 0, 0, None), (1, 0, 0, None)):
            some = [k for k, p in enumerate(pats) if len(p) > (z or 0)]

            class Held:
                value = scan.Patterns(pa.array(some), [pats[k] for k in some], z)

            want = [(k, i, j, t[max(0, j - before) : j], t[j : j + after], differ(t[j : j + len(pats[k])], pats[k])) for k in some for i, t in enumerate(x or "" for x in texts) for j in range(len(t) - len(pats[k]) + 1) if not at or j in places[i]]
            want = sorted((w[:3] + tuple(x for x, n in ((w[3], before), (w[4], after)) if n) + ((w[5],) if z is not None else ())) for w in want if w[5] <= (z or 0))
            names = ["read_id", "seq_id", "pos", *(["left"] if before else []), *(["right"] if after else []), *(["mismatches"] if z is not None else [])]
            got = [tuple(r.values()) for o in scan.scan(Held, names, before, after, at)(iter([b])) for r in o.to_pylist()]
            assert want and sorted(got) == want
