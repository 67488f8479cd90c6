import random

from pyspark.sql import functions as F

from seqloom import tables
from seqloom.operators.kmers import chunks, kmers, seeds
from seqloom.streaming.search import seed_stream


def test_global_order(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.randint(0, 50), rnd.randint(0, 9)) for i in range(500)]
    d = spark.createDataFrame(rows, "i long, k long, v long").repartition(5)
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    assert {r.i: r.rk for r in tables.ranked(d, "k", "i").collect()} == {r[0]: n for n, r in enumerate(order)}
    total, want = 0, {}
    for i, _, v in order:
        want[i] = total
        total += v
    assert {r.i: r.before for r in tables.running_total(d, "v", "k", "i").collect()} == want
    none = d.limit(0)
    assert tables.ranked(none, "k").count() == 0 and tables.running_total(none, "v", "k").count() == 0


def test_blocks_hold_every_row_once(spark):
    d = spark.range(1000).select(F.col("id").cast("string").alias("k"))
    for parts in (tables.blocks(d, "k", 300), tables.blocks(d, "k", 10_000, F.length("k"), 500)):
        assert len(parts) > 1 and sorted(int(r.k) for p in parts for r in p.collect()) == list(range(1000))
    assert len(tables.blocks(d, "k", 1000)) == 1 and len(tables.blocks(d.limit(0), "k", 10)) == 1


def test_blocks_split_a_hot_key(spark):
    d = spark.range(1000).select(F.lit("one").alias("k"), "id", F.when(F.col("id") == 7, 400).otherwise(1).alias("size"))
    parts = tables.blocks(d, "k", 100)
    assert [p.count() for p in parts] == [100] * 10 and sorted(r.id for p in parts for r in p.collect()) == list(range(1000))
    parts = tables.blocks(d, "k", 5000, F.col("size"), 200)
    sums = [p.agg(F.sum("size")).first()[0] or 0 for p in parts]
    assert sum(sums) == 1399 and all(s <= 200 + 400 for s in sums) and sum(p.count() for p in parts) == 1000


def test_as_of(spark):
    rnd = random.Random(5)
    # dense, sparse and repeated places, several letters, nulls
    left = [(i, rnd.choice([rnd.randint(-5, 60), 10_000 * rnd.randint(0, 9), 30]), rnd.choice(["a", "b", None])) for i in range(300)] + [(900, None, "a")]
    starts = [(k, s, c) for k, (s, c) in enumerate({(rnd.choice([rnd.randint(0, 50), 7_000 * rnd.randint(0, 9)]), rnd.choice("abc")) for _ in range(80)})]
    lf = spark.createDataFrame(left, "i long, x long, c string").repartition(6)
    rt = spark.createDataFrame(starts, "k long, s long, c string").repartition(3)
    for strict in (False, True):
        ok = lambda s, x: x is not None and (s < x if strict else s <= x)  # noqa: E731, B023
        best = lambda x, c: max((s for _, s, d in starts if d == c and ok(s, x)), default=None)  # noqa: E731, B023
        got = {r.i: r.s for r in tables.as_of(lf, rt, "x", "s", strict, "c", "left").collect()}
        assert got == {i: best(x, c) for i, x, c in left}
        some = tables.as_of(lf, rt, "x", "s", strict, "c")
        assert some.columns == ["i", "x", "c", "k", "s"] and {r.i: r.s for r in some.collect()} == {i: s for i, s in got.items() if s is not None}
        every = {r.i: r.s for r in tables.as_of(lf.drop("c"), rt.select("s").distinct(), "x", "s", strict, how="left").collect()}
        assert every == {i: max((s for _, s, _ in starts if ok(s, x)), default=None) for i, x, _ in left}
    assert tables.as_of(lf, rt.limit(0), "x", "s", by="c").count() == 0 and tables.as_of(lf.limit(0), rt, "x", "s", by="c", how="left").count() == 0


def test_substrings(spark):
    texts = ["", "a", "ab", "é" * 10 + "xyz", "abcdefghij" * 7, None]
    s = spark.createDataFrame(list(enumerate(texts)), "seq_id long, seq string")
    want = sorted((i, p, t[p : p + 3]) for i, t in enumerate(texts) if t for p in range(len(t) - 2))
    assert sorted(map(tuple, kmers(s, 3).collect())) == want
    for r in chunks(s, 2, (16, 4)).collect():
        t = texts[r.seq_id]
        assert r.chunk == t[r.base : r.base + 4 + 2][: r.own + 2] or r.chunk == t[r.base : r.base + 6]
    q = seeds(spark.createDataFrame([(1, "abcdefg")], "read_id long, seq string"), 3, 1)
    assert sorted((r.off, r.seed) for r in q.collect()) == [(0, "abc"), (2, "cde"), (4, "efg")]


def test_seed_stream(spark, tmp_path):
    spark.createDataFrame([(1, "ANAX"), (2, "ZZZZ")], "read_id long, pattern string").write.parquet(str(tmp_path / "in"))
    index = kmers(spark.createDataFrame([(0, "BANANA")], "seq_id long, seq string"), 3)
    found = seed_stream(spark.readStream.schema("read_id long, pattern string").parquet(str(tmp_path / "in")), index, 3)
    q = found.writeStream.format("memory").queryName("seed_hits").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.read_id, r.pos) for r in spark.table("seed_hits").collect()) == [(1, 1), (1, 3)]
