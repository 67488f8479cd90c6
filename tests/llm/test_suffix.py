import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from cases import DOCS_SCHEMA, docs
from pyspark.sql import functions as F

from seqloom.llm import suffix


def brute(texts, least):
    seen = Counter(t[i : i + least] for t in texts for i in range(len(t) - least + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - least + 1):
            if seen[t[i : i + least]] > 1:
                gone[i : i + least] = b"\1" * least
        kept = bytes(b for b, x in zip(t, gone, strict=True) if not x)
        out.append((len(t), len(t) - len(kept), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest()))
    return out


def passages(texts, ids, least):
    """Words in strings of `least` words that stand in a text of another id, too."""
    words, where = [re.findall(rb"[^\x20\x09-\x0D]+", t) for t in texts], defaultdict(set)
    for w, d in zip(words, ids, strict=True):
        for i in range(len(w) - least + 1):
            where[tuple(w[i : i + least])].add(d)
    out = []
    for w in words:
        hit = set()
        for i in range(len(w) - least + 1):
            if len(where[tuple(w[i : i + least])]) > 1:
                hit.update(range(i, i + least))
        out.append(len(hit))
    return out


def corpus():
    rnd = random.Random(10)
    base = ["".join(rnd.choice("abcé ") for _ in range(rnd.randint(0, 300))) for _ in range(12)]
    texts = ["".join(rnd.choice(base)[rnd.randint(0, 40) :] for _ in range(rnd.randint(0, 4))) for _ in range(80)]
    return [*texts, "a" * 500, "ab" * 300, None, "", "a" * 100 + base[0], texts[0], "q" * 39, "z " * 200, "z " * 150 + "end"]


def rows(found):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest(), r.n_passage_words, r.kept_sha256) for r in found.collect())


def want(texts, ids, least, passage):
    texts = [(t or "").encode() for t in texts]
    return sorted((str(i), *b, p, b[3]) for i, b, p in zip(ids, brute(texts, least), passages(texts, ids, passage), strict=True))


@pytest.mark.parametrize(("least", "gram", "passage", "passage_gram", "batches"), [(40, 20, 9, 3, 4), (64, 8, 20, 1, 3), (30, 29, 5, 5, 1)])
def test_brute_force(spark, least, gram, passage, passage_gram, batches):
    texts = corpus()
    ids = [*range(len(texts) - 2), 0, None]
    got = suffix.deduplicated(spark.createDataFrame(docs(texts, ids), DOCS_SCHEMA), suffix.units(least, gram, passage, passage_gram), batches)
    assert rows(got) == want(texts, ids, least, passage)


def planted():
    """Passages of 399, 400 and 401 bytes and of 50, 51 and 52 words, each in two texts, and in a third one with a byte changed."""
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=rnd.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(400)[: n - 1] + "." for n in (399, 400, 401)] + [prose(n) for n in (50, 51, 52)]
    texts = [prose(80) for _ in range(5)]
    for i, s in enumerate(shared):
        texts += [f"{prose(70)} .{'' if i < 3 else ' '}{s}{'|' if i < 3 else ' '}{prose(70)}", f"{prose(90)} - {s} / {prose(10)}", f"{prose(30)} {s[:100]}#{s[101:]} {prose(40)}"]
    return texts + [texts[0], None, "short"]


def test_brute_force_at_production_sizes(spark):
    texts = planted()
    ids = list(range(len(texts)))
    got = rows(suffix.deduplicated(spark.createDataFrame(docs(texts, ids), DOCS_SCHEMA)))
    assert got == want(texts, ids, suffix.LEAST, suffix.PASSAGE)
    assert {r[2] for r in got} >= {0, 400, 401} and 399 not in {r[2] for r in got}
    assert {r[5] for r in got} >= {0, 51, 52} and 50 not in {r[5] for r in got}


def test_long_texts_in_stretches():
    rnd = random.Random(11)
    data = bytes(rnd.choices(b"abcdefgh ", k=5000))
    for numbers in (suffix.byte_numbers, suffix.word_numbers):
        n, of = numbers(data)
        whole = [tuple(int(x) for x in r) for a in suffix.anchors(n, of, 60, 20) for r in zip(*a, strict=True)]
        parts = [tuple(int(x) for x in r) for a in suffix.anchors(n, of, 60, 20, stretch=170) for r in zip(*a, strict=True)]
        covered = lambda rows: [p for _, _, lo, hi in rows for p in range(lo, hi + 1)]
        assert covered(whole) == covered(parts) == list(range(n - 59))
        assert {r[0] for r in whole} == {r[0] for r in parts}


def test_words_have_the_same_number_wherever_they_stand():
    long = b"x" * 10_000
    data = b" \t" + b" ".join([b"one", long, b"two", b"one\n" * 900, long, b"two"]) + b"\x0b"
    n, of = suffix.word_numbers(data)
    m, parts = suffix.word_numbers(data, stretch=64)
    found = of(0, n).tolist()
    assert n == m == 905 and found == parts(0, m).tolist()
    assert len(set(found)) == 3 and found[1] == found[-2] and found[2] == found[-1] and set(found[3:903]) == {found[0]}


def test_a_kept_family_takes_another_batch(spark, tmp_path):
    """Adding b to the family of a, opened again, equals a run over both; matches come from the scans."""
    texts = corpus()
    of = suffix.units(40, 20, 9, 3)
    all_docs = suffix.keyed(spark.createDataFrame(docs(texts), DOCS_SCHEMA))
    a, b = all_docs.where("doc_id % 3 > 0"), all_docs.where("doc_id % 3 = 0")
    family = suffix.IndexFamily(spark, f"file://{tmp_path}/family", of)
    family.add(suffix.indexable(a, of))
    first = {r.key for r in family.matches().collect()}
    family.close(drop_files=False)
    family = suffix.IndexFamily.open(spark, f"file://{tmp_path}/family", of)
    new = {r.key for r in family.add(suffix.indexable(b, of)).collect()}
    counts = Counter(r.key for r in family.anchors().collect())
    assert first | new == {k for k, n in counts.items() if n > 1} and new - first
    assert {r.key: r.n for r in family.array().collect()} == counts
    spans = suffix.spans_of(family, suffix.indexable(all_docs, of))
    assert rows(suffix.without(all_docs, spans, of)) == want(texts, range(len(texts)), 40, 9)


def test_levels_merge_geometrically(spark, tmp_path):
    of = suffix.units(10, 5, 4, 2)
    family, sizes = suffix.IndexFamily(spark, f"file://{tmp_path}/family", of), []
    rnd = random.Random(3)
    for i in range(6):
        text = "".join(rnd.choices("ab ", k=60)) + "the same twenty words "
        family.add(spark.createDataFrame([(i, i, text)], "d long, t long, text string"))
        sizes.append([s for s, _ in family.levels])
    assert sizes == [[1], [2], [2, 1], [4], [4, 1], [4, 2]]
    assert {r.key: r.n for r in family.array().collect()} == Counter(r.key for r in family.anchors().collect())


def test_scans_and_merges_of_levels_do_not_shuffle(spark, tmp_path):
    family = suffix.IndexFamily(spark, f"file://{tmp_path}/family", suffix.units(10, 5, 4, 2))
    for i in range(3):
        family.add(spark.createDataFrame([(i, i, "some text of a batch " * (i + 2))], "d long, t long, text string"))
    (_, a), (_, b) = family.levels
    for how in ("left_semi", "full"):
        plan = family._level(a).hint("merge").join(family._level(b), "key", how)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan


def test_strings_at_edges_are_compared_a_slice_after_the_other(spark, monkeypatch):
    """No exchange of single strings takes those of all keys, and the slices together take them all, with the same result."""
    texts, of, taken = corpus(), suffix.units(40, 20, 9, 3), []
    written = suffix.written

    def spied(df, what, *by):
        out = written(df, what, *by)
        if what == "edges":
            taken.append({r.key: r.n for r in out[0].groupBy("key").agg(F.sum(F.size("h")).alias("n")).collect()})
        if what in ("repeated-strings", "string-runs"):
            taken.append((what, df._jdf.queryExecution().executedPlan().toString()))
        return out

    monkeypatch.setattr(suffix, "written", spied)
    got = suffix.deduplicated(spark.createDataFrame(docs(texts), DOCS_SCHEMA), of)
    assert rows(got) == want(texts, range(len(texts)), 40, 9)
    strings, *plans = taken
    assert [what for what, _ in plans] == ["repeated-strings", "string-runs"] * suffix.SLICES
    for j, (_, plan) in enumerate(plans):
        # every read of the edges keeps to the folder of its slice
        scans = re.findall(r"PartitionFilters: \[[^\]]*\(slice#\d+L? = (\d+)\)\]", plan)
        assert scans and set(scans) == {str(j // 2)}
    sizes = [sum(n for k, n in strings.items() if k % suffix.SLICES == i) for i in range(suffix.SLICES)]
    assert sum(sizes) == sum(strings.values()) and 0 < max(sizes) < 0.6 * sum(sizes)
