import hashlib
import random
import re

from cases import DOCS_SCHEMA, docs

from seqloom.llm import decontam


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))


def brute(texts, items):
    out = []
    for t in texts:
        w, hit, ids = words(t), set(), set()
        for i, x in items:
            v = words(x)
            for s in range(max(1, len(v) - 12)) if v and i is not None else ():
                win = v[s : s + 13]
                for p in range(len(w) - len(win) + 1):
                    if w[p : p + len(win)] == win:
                        hit |= set(range(p, p + len(win)))
                        ids.add(str(i))
        out.append((len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def test_brute_force(spark):
    rnd = random.Random(4)
    line = lambda n: " ".join(rnd.choice(["the", "Of", "a", "b1", "É", "é", "zz", "q-r"]) for _ in range(n))
    items = [(i, line(rnd.choice([1, 2, 3, 5, 12, 13, 14, 30]))) for i in range(14)] + [(50, None), (51, "--"), (None, "the of"), (60, "the"), (61, "THE")]
    items.append(items[5])
    texts = [None, "", "...", "the"] + [" ".join([line(rnd.randint(0, 30)), rnd.choice(items)[1] or "", line(rnd.randint(0, 40))]) for _ in range(60)]
    texts += [texts[-1], line(3000)]
    got = decontam.decontamination_report(spark.createDataFrame(docs(texts), DOCS_SCHEMA), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, *tuple(r)[1:]) for r in got) == sorted((i, *b) for i, b in enumerate(brute(texts, items)))


def test_blocks_give_the_same(spark):
    d = spark.createDataFrame(docs(["a b c d e f g h i j k l m n o", "x y a b c d e f g h i j k l m n o z", "no"]), DOCS_SCHEMA)
    i = spark.createDataFrame([(1, "a b c d e f g h i j k l m n o"), (2, "x y")], "item_id long, text string")
    one, many = (sorted(map(str, decontam.contamination(d, i, block=b).drop("rid").collect())) for b in (1000, 1))
    assert one == many


def test_repeated_rows_and_native(spark):
    d = spark.createDataFrame(docs(["a b", "a b", None], [7, 7, None]), DOCS_SCHEMA)
    i = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    r = decontam.decontamination_report(d, i)
    assert sorted((x.doc_id is None, x.n_hit) for x in r.collect()) == [(False, 2), (False, 2), (True, 0)]
    assert "Python" not in r._jdf.queryExecution().toString()
