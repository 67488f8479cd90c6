"""Clusters and tiles against a fold in order."""

import random

import pytest
from pyspark.sql import functions as F

from seqloom.operators import mosaic


def folded(rows):
    out, now = [], None
    for pos, refs in sorted(rows):
        both = now[3] & set(refs) if now else set()
        if both:
            now = (now[0], pos, now[2] + 1, both)
        else:
            out += [now] if now else []
            now = (pos, pos, 1, set(refs))
    return [(i, a, z, n, sorted(r)) for i, (a, z, n, r) in enumerate([*out, now])]


def cases():
    rnd = random.Random(8)
    yield [(p, rnd.sample("ABCDE", rnd.randint(1, 3))) for p in rnd.sample(range(500), 90)]
    yield [(p, ["Z", *rnd.sample("ABC", 1)]) for p in range(150)]  # one reference in all sets
    yield [(p, [["A"], ["B"], []][p % 3]) for p in range(40)]
    yield [(5, ["A", "A"])]


@pytest.mark.parametrize("rows", list(cases()))
def test_clusters(spark, rows):
    d = spark.createDataFrame(rows, "pos long, refs array<string>")
    got = mosaic.clusters(d)
    assert sorted((r.cluster, r.first_pos, r.last_pos, r.n_pos, r.refs) for r in got.collect()) == folded(rows)


def test_keys_and_plans(spark):
    a, b = list(cases())[:2]
    d = spark.createDataFrame([("a", *x) for x in a] + [(None, *x) for x in b], "chrom string, pos long, refs array<string>")
    got = mosaic.clusters(d, "chrom").collect()
    for key, rows in (("a", a), (None, b)):
        assert sorted((r.cluster, r.first_pos, r.last_pos, r.n_pos, r.refs) for r in got if r.chrom == key) == folded(rows)
    tiles = mosaic.tiles(mosaic.clusters(d.where("chrom = 'a'").drop("chrom")), "A", 3, 600)
    plan = tiles._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "NestedLoop" not in plan
    spans = sorted((r.a, r.b) for r in tiles.collect())
    assert spans[0][0] == 1 and spans[-1][1] == 600 and all(y[0] == x[1] + 1 for x, y in zip(spans, spans[1:], strict=False))
    assert mosaic.clusters(d.limit(0)).collect() == [] and mosaic.tiles(mosaic.clusters(d.limit(0)), "A", 3, 600).collect() == []
    assert mosaic.tiles(mosaic.clusters(d.where("chrom = 'a'").drop("chrom").withColumn("refs", F.array().cast("array<string>"))), "A", 3, 600).collect() == []
